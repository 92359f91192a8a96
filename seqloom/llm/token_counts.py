"""Edit-aware token counts: a segment tree of token counts over each document's pre-token runs.

A leaf is a run of about LEAF characters that starts at a single space between two non-space characters, where a byte-level
pre-tokeniser always starts a new pre-token; so the document's count is the sum of the leaves' counts. Inner nodes hold
characters and tokens below them. An edit (start, end, new text; code points) descends by characters to the leaves that it
touches, joins to them the neighbours whose boundary the edit may have moved, encodes only those again and updates the sums on
the path to the root.

Defined results: a null text is empty and has 0 tokens; edits outside the text are cut to it; repeated rows, and documents with a null or one doc_id,
are counted each; very long texts are taken whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string as schema

from . import common, tokens

LEAF = 256


def leaves(text: str, size: int = LEAF) -> list[str]:
    """Runs of the text; each but the first starts with a space that follows a non-space and precedes one."""
    out, start, n = [], 0, len(text)
    while n - start > size:
        at = text.find(" ", start + size)
        while at != -1 and (at + 1 >= n or text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at == -1:
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


class Tree:
    """Leaves as strings; sums[0] of characters and sums[1] of tokens, as a heap."""

    def __init__(self, leaf: list[str], n_tokens: np.ndarray, enc: tokens.Encoder):
        self.enc, self.encoded, self.leaf = enc, 0, leaf
        self.width = 1 << max(0, len(self.leaf) - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.width), np.int64)
        self.sums[0, self.width : self.width + len(self.leaf)] = [len(x) for x in self.leaf]
        self.sums[1, self.width : self.width + len(self.leaf)] = n_tokens
        w = self.width
        while w > 1:
            w //= 2
            self.sums[:, w : 2 * w] = self.sums[:, 2 * w : 4 * w : 2] + self.sums[:, 2 * w + 1 : 4 * w : 2]

    @classmethod
    def of(cls, text: str, enc: tokens.Encoder, size: int = LEAF) -> Tree:
        leaf = leaves(text, size)
        return cls(leaf, enc.counts(leaf), enc)

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def n_chars(self) -> int:
        return int(self.sums[0, 1])

    @property
    def text(self) -> str:
        return "".join(self.leaf)

    def locate(self, at: int) -> tuple[int, int]:
        """Leaf of a character, and the character's place there; the end belongs to the last leaf that has text."""
        node, chars = 1, self.sums[0]
        at = min(max(at, 0), self.n_chars)
        if at == self.n_chars and at:
            leaf, rest = self.locate(at - 1)
            return leaf, rest + 1
        while node < self.width:
            node *= 2
            if at >= chars[node]:
                at -= int(chars[node])
                node += 1
        return min(node - self.width, len(self.leaf) - 1), at

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from start to end."""
        a, at = self.locate(start)
        b, to = self.locate(max(start, end))
        if b < a:
            b, to = a, at
        joined = self.leaf[a][:at] + new + self.leaf[b][to:]
        low, high = a, b
        # towards the left: leaf `low` must still start at a safe place
        while low > 0 and not (len(joined) > 1 and joined[0] == " " and not joined[1].isspace() and self._last(low - 1)):
            low -= 1
            joined = self.leaf[low] + joined
        while high + 1 < len(self.leaf) and not (joined and not joined[-1].isspace() and len(self.leaf[high + 1]) > 1):
            high += 1
            joined += self.leaf[high]
        self.leaf[low] = joined
        for i in range(low + 1, high + 1):
            self.leaf[i] = ""
        self.encoded += len(joined)
        for i in range(low, high + 1):
            self._set(i, len(self.leaf[i]), len(self.enc.whole(joined)) if i == low else 0)

    def _last(self, i: int) -> bool:
        """Leaf i ends with a non-space (so a leaf may start after it)."""
        return bool(self.leaf[i]) and not self.leaf[i][-1].isspace()

    def _set(self, i: int, chars: int, n: int) -> None:
        node = self.width + i
        change = np.array([chars, n]) - self.sums[:, node]
        while node:
            self.sums[:, node] += change
            node //= 2


def own_edits(text: str) -> list[tuple[int, int, str]]:
    """The edits of the query: a word put in at a third, 16 characters out at half, the last 8 replaced."""
    n = len(text)
    return [(n // 3, n // 3, " inserted"), (n // 2, n // 2 + 16, ""), (n - 16, n - 8, ".\nNew end")]


def count(docs: DataFrame, edits=own_edits, path: str | None = None) -> DataFrame:
    """Per document: characters and tokens before and after the edits, leaves, and characters that were encoded again."""

    def make():
        enc = tokens.encoder(path)

        def work(batch):
            rows, texts = [], common.texts(batch)
            for part in tokens.blocks(texts):
                rows += some(texts[part])
            names = ("n_chars", "n_tokens", "n_leaves", "edited_chars", "edited_tokens", "encoded_again")
            return {"doc_id": batch.column("doc_id")} | {k: [r[i] for r in rows] for i, k in enumerate(names)}

        def some(texts):
            rows, split = [], [leaves(t or "") for t in texts]
            n, at = enc.counts([x for s in split for x in s]), 0
            for text, leaf in zip(texts, split):
                tree = Tree(leaf, n[at : at + len(leaf)], enc)
                at += len(leaf)
                row = [tree.n_chars, tree.n_tokens, len(tree.leaf)]
                for e in edits(text or ""):
                    tree.edit(*e)
                rows.append([*row, tree.n_chars, tree.n_tokens, tree.encoded])
            return rows

        return work

    return common.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema("doc_id long, n_chars long, n_tokens long, n_leaves long, edited_chars long, edited_tokens long, encoded_again long"))
