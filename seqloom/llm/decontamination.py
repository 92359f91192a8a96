"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased. The automaton over word numbers
accepts every run of words of every item. Document words are streamed through it and the longest matching length is
tracked; where it reaches the window, the window is hit, and the state tells which items hold it. An item shorter than
the window counts as one window of its own length.

The automaton is kept in flat arrays (about 40 bytes a state). Items of more than BLOCK_CHARS characters in all are taken in blocks, one
automaton each, which are broadcast. A task takes a group of texts through all blocks, holding one automaton at a time if there are several,
so memory is bounded whatever the benchmark's size, the texts are read once, and spans, coverage and cuts are of all items together.

Defined results: null or wordless texts have no words and no hits; items without words never match; without items nothing is hit; repeated
documents are treated alike; repeated items each count; null ids of items count as an item `None`. Very long texts are taken whole. Extra
columns, whatever their names, pass through remove(). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string as schema

from . import common

WINDOW, BLOCK_CHARS, MAX_COVERAGE = 10, 4_000_000, 0.5
#: Bytes of texts that go through several blocks together.
GROUP_BYTES = 32_000_000
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(common.WORD_BYTES).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window.

    Arrays by state: link, length, word and target of its first transition (the root's are in root, by word), at (the state of the last
    `window` words) and above (the nearest state on the way to the root that ends a short item). Further transitions are in keys
    (state << 32 | word, ascending) and targets; the items of windows in owners, from places[k] on for the state held[k].
    """

    VIEWS = ("link", "length", "word", "target", "root", "at", "above", "keys", "targets", "held", "places", "owners")

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab, self.names = window, {}, []
        nxt: list = [None]  # a state's transitions: None, word << 32 | target, or a dict if there are several
        link, length, low = array("i", [-1]), array("i", [0]), (1 << 32) - 1

        def get(v: int, c: int) -> int:
            e = nxt[v]
            if e is None:
                return -1
            if type(e) is int:
                return e & low if e >> 32 == c else -1
            return e.get(c, -1)

        def put(v: int, c: int, to: int) -> None:
            e = nxt[v]
            if e is None or (type(e) is int and e >> 32 == c):
                nxt[v] = c << 32 | to
            elif type(e) is int:
                nxt[v] = {e >> 32: e & low, c: to}
            else:
                e[c] = to

        def state(transitions, up: int, n: int) -> int:
            nxt.append(transitions)
            link.append(up)
            length.append(n)
            return len(nxt) - 1

        def split(p: int, q: int, c: int) -> int:
            clone = state(dict(nxt[q]) if type(nxt[q]) is dict else nxt[q], link[q], length[p] + 1)
            link[q] = clone
            while p != -1 and get(p, c) == q:
                put(p, c, clone)
                p = link[p]
            return clone

        def extend(last: int, c: int) -> int:
            q = get(last, c)
            if q >= 0:
                return q if length[q] == length[last] + 1 else split(last, q, c)
            new, p = state(None, 0, length[last] + 1), last
            while p != -1 and (q := get(p, c)) < 0:
                put(p, c, new)
                p = link[p]
            if p != -1:
                link[new] = q if length[q] == length[p] + 1 else split(p, q, c)
            return new

        paths = []
        for item, ws in items:
            if ws:
                ids, last = array("i", [self.vocab.setdefault(w, len(self.vocab)) for w in ws]), 0
                for c in ids:
                    last = extend(last, c)
                self.names.append(item)
                paths.append(ids)
        n = len(nxt)
        ends, at, above, short = [], array("i", [0]) * n, array("i", [0]) * n, {}
        for k, ids in enumerate(paths):  # the state of each beginning of an item, now that all are split
            v, own = 0, array("i")
            for c in ids:
                v = get(v, c)
                own.append(v)
            ends.append(own)
            if len(ids) < window:
                short.setdefault(v, []).append(k)
        for v in np.argsort(np.array(length), kind="stable")[1:].tolist():
            u = link[v]
            at[v] = v if length[u] < window else at[u]
            above[v] = u if u in short else above[u]
        pairs = {(at[v], k) for k, own in enumerate(ends) for v in own[window - 1 :]}
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        word, target, more = array("i", [-1]) * n, array("i", [0]) * n, []
        for v in range(1, n):
            e = nxt[v]
            if type(e) is dict:
                (c, to), *others = e.items()
                more += [(v << 32 | c, to) for c, to in others]
                e = c << 32 | to
            if e is not None:
                word[v], target[v] = e >> 32, e & low
        more.sort()
        self.root = np.array([get(0, c) for c in range(len(self.vocab))], np.int32)
        self.link, self.length, self.word, self.target, self.at, self.above = (np.array(x, np.int32) for x in (link, length, word, target, at, above))
        self.keys, self.targets = np.array([k for k, _ in more], np.int64), np.array([t for _, t in more], np.int32)
        self.held, begin = np.unique(pairs[:, 0], return_index=True)
        self.places, self.owners = np.append(begin, len(pairs)), pairs[:, 1].astype(np.int32)
        self.short = short
        self.least = min([window, *(length[v] for v in short)])

    def find(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Covered word ranges (ascending, disjoint, end exclusive) and the items with occurring windows."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        if not self.vocab or len(ws) < self.least:
            return spans, found
        ids = np.fromiter(map(self.vocab.get, ws, repeat(-1)), np.int64, len(ws))
        # only runs of known words can match
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        edge = edge.reshape(-1, 2)
        edge = edge[edge[:, 1] - edge[:, 0] >= self.least]
        if len(edge):
            view = {name: memoryview(getattr(self, name)) for name in self.VIEWS}  # faster than arrays, one number at a time
            for a, b in edge.tolist():
                self._stream(ids[a:b].tolist(), a, spans, found, **view)
        return spans, {self.names[k] for k in found}

    def _stream(self, ids: list[int], base: int, spans: list, found: set, link, length, word, target, root, at, above, keys, targets, held, places, owners) -> None:
        window, short, more = self.window, self.short, len(keys)
        v = run = 0
        for i, c in enumerate(ids):
            while v:
                if word[v] == c:
                    v, run = target[v], run + 1
                    break
                key = v << 32 | c
                k = bisect_left(keys, key) if more else 0
                if k < more and keys[k] == key:
                    v, run = targets[k], run + 1
                    break
                v = link[v]
                run = length[v]
            else:  # every known word leaves the root
                v, run = root[c], 1
            hit = 0
            if run >= window:
                hit = window
                k = bisect_left(held, at[v])
                found.update(owners[places[k] : places[k + 1]])
            u = v if v in short and run == length[v] else above[v]
            while u:
                hit = max(hit, length[u])
                found.update(short[u])
                u = above[u]
            if hit:
                a, b = base + i + 1 - hit, base + i + 1
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, b))


def automata(benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS):
    """One automaton for each block of items; a block holds about block_chars characters at most."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield Automaton([(r.item_id, words(r.text.encode())) for r in part.collect()], window)


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list = []
    for a, b in sorted(map(tuple, spans)):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Shared:
    """The automata of all blocks as broadcasts; a worker holds one at a time if there are several."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int, block_chars: int):
        sc = docs.sparkSession.sparkContext
        self.blocks = [sc.broadcast(machine) for machine in automata(benchmark, window, block_chars)]

    def find(self, texts: list[bytes | None]) -> list[tuple[int, list, set]]:
        """Number of words, covered ranges and items of each text, over all blocks."""
        ws = [words(t) for t in texts]
        out: list = [(len(w), [], set()) for w in ws]
        for block in self.blocks:
            machine = block.value
            for r, w in enumerate(ws):
                spans, found = machine.find(w)
                if found:
                    out[r] = (len(w), _merged([*out[r][1], *spans]) if out[r][1] else spans, out[r][2] | found)
            if len(self.blocks) > 1:
                del machine
                block.__dict__.pop("_value", None)
        return out

    def groups(self, batches):
        """The batches, put together if there are several blocks."""
        group: list = []
        for batch in batches:
            if len(self.blocks) < 2:
                yield batch
                continue
            group.append(batch)
            if sum(b.nbytes for b in group) >= GROUP_BYTES:
                yield pa.concat_batches(group)
                group = []
        if group:
            yield pa.concat_batches(group)


FOUND = "n_words long, spans array<struct<a:int,b:int>>, items array<string>"


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, covered word ranges, and the ids of matching items as strings."""
    shared = Shared(docs, benchmark, window, block_chars)
    source = docs.select("doc_id", "text")
    kind = schema(f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {FOUND}")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for batch in shared.groups(batches):
            rows = shared.find(common.raw(batch))
            cols = [batch.column("doc_id"), [n for n, _, _ in rows], [[{"a": a, "b": b} for a, b in spans] for _, spans, _ in rows], [sorted(map(str, items)) for _, _, items in rows]]
            yield pa.RecordBatch.from_arrays([c if i == 0 else pa.array(c, f.type) for i, (c, f) in enumerate(zip(cols, arrow))], schema=arrow)

    return source.mapInArrow(run, kind)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The contract's digest columns."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["b"] - s["a"]))
    return find(docs, benchmark, window).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the ranges; a space stands for each range."""
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return " ".join([*out, text[last:]])


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents without their hit spans; those with more than max_coverage of their words hit go. n_chars follows the text.

    What a cut joins can hit again, so a text is cut until nothing is hit; each cut shortens it.
    """
    shared, names = Shared(docs, benchmark, window, block_chars), docs.columns

    def run(batches):
        for batch in shared.groups(batches):
            new = batch.column(names.index("text")).to_pylist()
            keep, waiting, first = [True] * len(new), range(len(new)), True
            while waiting:
                again = []
                for r, (n, spans, _) in zip(waiting, shared.find([new[r].encode() if new[r] else None for r in waiting])):
                    if first:
                        keep[r] = sum(b - a for a, b in spans) <= max_coverage * n
                    if spans and keep[r]:
                        new[r] = cut(new[r], spans)
                        again.append(r)
                waiting, first = again, False
            yield _with_texts(batch, new, names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _with_texts(batch: pa.RecordBatch, new: list, names: list[str]) -> pa.RecordBatch:
    """The batch with new texts; names: what its columns are called in the documents."""
    cols = [pa.array(new, f.type) if name == "text" else batch.column(i) for i, (name, f) in enumerate(zip(names, batch.schema))]
    for i, (name, f) in enumerate(zip(names, batch.schema)):
        if name == "n_chars":
            old = batch.column(i).to_pylist()
            cols[i] = pa.array([len(t) if t is not None else o for t, o in zip(new, old)], f.type)
    return pa.RecordBatch.from_arrays(cols, schema=batch.schema)


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_aggregate(list_slice(w, i, i + least(len(w), 10) - 1), 'string_agg', ' ') AS k
        FROM bw, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
hits AS (SELECT d.doc_id, d.i, d.n, win.item_id FROM (
           SELECT doc_id, i, n, list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ') AS k
           FROM dw, sizes, unnest(generate_series(1, len(w) - n + 1)) AS g(i)) d JOIN win ON win.n = d.n AND win.k = d.k),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(cover.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(cover.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""
