"""Whole-text encoding with the tokenizers library, piece by piece.

A byte-level BPE pre-tokeniser always starts a new pre-token at a single space between two non-space characters, makes a single line end
between two such a pre-token of its own, and one of a point or comma that follows a letter and precedes white space or the end. So a
text may be cut there, each different piece encoded once, and the ids joined: the ids equal those of the whole text. Texts of a block are
laid end to end; pieces are found, hashed (64 bits) and numbered with numpy, and only pieces that the cache lacks become strings. These
are encoded in one call, a line each: the line end's id marks where a piece's ids end. A hash only finds a piece: the cache keeps each
piece's bytes, and every piece of a text is compared with them. The cache is bounded and lives as long as the worker. A text is encoded
whole if a piece of it is empty or starts or ends with white space (where the rule doesn't hold), or if another piece has its hash.
"""

from __future__ import annotations

import os

import numpy as np

from . import common

VOCABULARY = "byte_bpe_50k.json"
CACHE, LONG_PIECE = 900_000, 64
#: Mixed into the hash of a text's first piece, and of a piece after a line end.
FIRST, AFTER_LINE = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    def __init__(self, path: str | None = None, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path or default_path()), cache
        line = self.tokenizer.encode("a\n b", add_special_tokens=False)
        self.line = line.ids[1] if len(line.ids) == 3 else None
        self.mark = np.zeros(256, np.uint32)  # ids of a point and a comma after a letter
        for c in b".,":
            self.mark[c] = self.tokenizer.encode("a" + chr(c), add_special_tokens=False).ids[-1]
        self._clear()

    def _clear(self) -> None:
        # hashes and their slots: sorted arrays, the second ones short and merged into the first now and then (a dict takes ten times the memory)
        self.keys, self.slots = [np.zeros(0, np.uint64)] * 2, [np.zeros(0, np.int32)] * 2
        self.n = 0
        # of each slot: place and number of its ids (-1: unsafe), its kind, place and number of its piece's bytes
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.kind, self.at, self.length = np.zeros(1 << 16, np.int8), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0
        self.bytes, self.held = np.zeros(1 << 20, np.uint8), 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the hashes, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        for own, slots in zip(self.keys, self.slots):
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                out = np.where(own[at] == keys, slots[at], out)
        return out

    def _add(self, keys: np.ndarray, pieces: list[bytes], kinds: np.ndarray) -> None:
        """Slots for new pieces; their hashes are ascending."""
        order, ids, size = self._fill([p.decode() for p in pieces], kinds.tolist())
        k, n = self.n, len(keys)
        data, length = np.frombuffer(b"".join([pieces[i] for i in order]), np.uint8), np.fromiter((len(pieces[i]) for i in order), np.int64, n)
        while k + n > len(self.size):
            self.start, self.size, self.kind, self.at, self.length = (np.resize(x, 2 * len(x)) for x in (self.start, self.size, self.kind, self.at, self.length))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while self.held + len(data) > len(self.bytes):
            self.bytes = np.resize(self.bytes, 2 * len(self.bytes))
        whole, new = np.maximum(size, 0), slice(k, k + n)
        self.flat[self.used : self.used + len(ids)], self.bytes[self.held : self.held + len(data)] = ids, data
        self.size[new], self.start[new] = size, self.used + np.cumsum(whole) - whole
        self.kind[new], self.length[new], self.at[new] = kinds[order], length, self.held + np.cumsum(length) - length
        self.n, self.used, self.held = k + n, self.used + len(ids), self.held + len(data)
        slots = np.empty(n, np.int32)
        slots[order] = np.arange(k, k + n)
        for level, most in ((1, 1 << 16), (0, 1 << 62)):
            at = np.searchsorted(self.keys[level], keys)
            keys, slots = np.insert(self.keys[level], at, keys), np.insert(self.slots[level], at, slots)
            if len(keys) <= most:
                self.keys[level], self.slots[level] = keys, slots
                break
            self.keys[level], self.slots[level] = keys[:0], slots[:0]

    def _others(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Marks the pieces that aren't the one of their slot."""
        n = end - start
        bad = (self.kind[slot] != kind) | (self.length[slot] != n)
        n = np.where(bad, 0, n)
        ends = np.cumsum(n)
        place = np.arange(int(ends[-1]))
        wrong = np.flatnonzero(data[np.repeat(start - (ends - n), n) + place] != self.bytes[np.repeat(self.at[slot] - (ends - n), n) + place])
        bad[np.searchsorted(ends, wrong, "right")] = True
        return bad

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _fill(self, pieces: list[str], kinds: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the pieces, and in that order their ids end to end and how many each has (-1: unsafe).

        kinds: 0 after a space, 1 first of its text, 2 after a line end (which belongs to it).
        """
        lines, others, ids, size = [], [], [], []
        for i, (p, kind) in enumerate(zip(pieces, kinds)):
            if kind == 0 and self.line is not None and 0 < len(p) <= LONG_PIECE and p.isprintable() and p[-1] != " " and p[0] != " ":
                lines.append(i)
                continue
            others.append(i)
            if kind == 1 and not p:
                size.append(0)
            elif not p or p[-1].isspace() or (kind != 1 and p[0].isspace()):
                size.append(-1)
            else:
                own = self.whole(" " + p if kind == 0 else p)
                ids.append(np.append(np.uint32(self.line or 0), own) if kind == 2 else own)
                size.append(len(ids[-1]))
        order, size = np.array(lines + others, np.int64), np.array(size, np.int32)
        if lines:
            joined = self.whole("".join(f" {pieces[i]}\n" for i in lines) + " a")
            ends = np.flatnonzero(joined == self.line)
            if len(ends) == len(lines):
                first, n = np.delete(joined[: ends[-1] + 1], ends), np.diff(ends, prepend=-1) - 1
            else:  # a piece has the line's id itself: one at a time
                own = [self.whole(" " + pieces[i]) for i in lines]
                first, n = np.concatenate(own), np.array(list(map(len, own)))
            ids, size = [first, *ids], np.concatenate((n.astype(np.int32), size))
        return order, np.concatenate([np.zeros(0, np.uint32), *ids]), size

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and how many each has; null is empty."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        raw = [(t or "").encode() for t in texts]
        joined = b" ".join(raw) + b" "
        data, length = np.frombuffer(joined, np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))
        begin = np.cumsum(length + 1) - length - 1
        end = np.flatnonzero((data == 32) | (data == 10)) if self.line is not None else np.flatnonzero(data == 32)
        start = np.concatenate(([0], end[:-1] + 1))
        first = np.searchsorted(start, begin)  # the first piece of each text
        kind = np.zeros(len(start), np.int8)
        kind[1:] = 2 * (data[end[:-1]] == 10)
        kind[first] = 1
        # a piece's last point or comma is set aside where a letter stands before it
        last, before = data[np.maximum(end - 1, 0)], data[np.maximum(end - 2, 0)]
        marked = (end - start >= 2) & ((last == 46) | (last == 44)) & _LETTER[before]
        end = end - marked
        h = common.span_hashes(data, start, end)
        h[kind == 1] ^= FIRST
        h[kind == 2] ^= AFTER_LINE
        u, at, back = np.unique(h, return_index=True, return_inverse=True)
        if self.n > self.cache:
            self._clear()
        slots = self._find(u)
        miss = np.flatnonzero(slots < 0)
        if len(miss):
            where = at[miss]
            self._add(u[miss], [joined[a:b] for a, b in zip(start[where].tolist(), end[where].tolist())], kind[where])
            slots[miss] = self._find(u[miss])
        slot = slots[back]
        size = self.size[slot].astype(np.int64)
        owner = np.searchsorted(first, np.arange(len(start)), "right") - 1
        unsafe = (size < 0) | self._others(data, start, end, kind, slot)
        if unsafe.any():
            return self._mixed(texts, np.unique(owner[unsafe]))
        whole = size + marked
        ends = np.cumsum(whole)
        at = np.repeat(self.start[slot] - (ends - whole), whole) + np.arange(int(ends[-1]))
        at[ends[marked] - 1] = 0
        ids = self.flat[at]
        ids[ends[marked] - 1] = self.mark[last[marked]]
        return ids, np.bincount(owner, whole, len(texts)).astype(np.int64)

    def _mixed(self, texts: list, unsafe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bad = set(unsafe.tolist())
        ids, n = self.encode_flat([t for i, t in enumerate(texts) if i not in bad])
        parts, counts, at, k = [], [], 0, 0
        for i, t in enumerate(texts):
            if i in bad:
                parts.append(self.whole(t))
            else:
                parts.append(ids[at : at + n[k]])
                at, k = at + int(n[k]), k + 1
            counts.append(len(parts[-1]))
        return np.concatenate(parts), np.array(counts, np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, n = self.encode_flat(texts)
        ends = np.cumsum(n)
        return [ids[e - k : e] for e, k in zip(ends.tolist(), n.tolist())]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        return self.encode_flat(texts)[1]


_encoders: dict = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder a process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def blocks(texts: list, most: int = 1_000_000):
    """Slices of the list that hold about `most` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
