"""Vector best-fit packing of token pieces into sequences.

Each bin has three residual capacities: tokens, documents, attention cost (the sum of squared piece lengths). Pieces go in
descending length; under every constraint a piece goes to the tightest bin: the one with the smallest dot product of the piece
and the residual, each dimension weighted and in parts of its capacity ("dot"), or the smallest norm of what would remain ("norm").

Pieces of one length are alike, and so are bins with one residual, so the packing runs on the histogram of lengths: bins are
kept as ranges with a common residual, and a step places as many pieces of a length as a range has bins. The driver sees a count
for each length (1,024 rows); the plan, a table of (length, ranks) to (bins, offset), is bounded by lengths and ranges, not by
documents. Each piece then finds its place from its rank within its length.

Defined results: a null text is empty and packs as its end id alone; repeated rows are packed each, as are documents with a null or one doc_id; a
document over the capacity is cut into whole-capacity pieces, the first piece taking the rest, however long it is; of bins with one value the first opened
is filled first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY, END_ID = 1024, 2
WEIGHTS = (1.0, 0.05, 0.25)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, local long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """A row for each piece, with its task (part) and its rank among the task's pieces of that length (local)."""

    def run(batches):
        from pyspark import TaskContext

        enc, part, end, seen = tokens.encoder(path), TaskContext.get().partitionId(), np.array([end_id], "<u4"), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts, doc_ids, rows = common.texts(batch), batch.column("doc_id").to_pylist(), []
            for block in tokens.blocks(texts):
                for doc_id, value in zip(doc_ids[block], enc.encode(texts[block])):
                    value = np.concatenate((value, end)).astype("<u4", copy=False)
                    n, at, piece = len(value), 0, 0
                    data = memoryview(value.view(np.uint8))
                    while at < n:
                        k = min(capacity, (n - at - 1) % capacity + 1)  # the first piece takes the rest
                        rows.append((doc_id, piece, at, k, zlib.crc32(data[4 * at : 4 * (at + k)]), part, int(seen[k])))
                        seen[k] += 1
                        at, piece = at + k, piece + 1
            types = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, score: str = "dot", weights=WEIGHTS) -> np.ndarray:
    """Rows (length, first rank, count, first bin, offset), ascending: where the pieces of each length go.

    counts: pieces of each length. Constraints: tokens of a bin <= capacity, documents <= max_docs, cost <= max_cost.
    """
    max_docs, max_cost = max_docs or capacity, max_cost or capacity * capacity
    if any(n * n > max_cost or n > capacity for n in counts):
        raise ValueError("a piece alone exceeds a capacity")
    full = np.array([capacity, max_docs, max_cost], np.int64)
    w = np.array(weights)
    room, first, many = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out, bins = [], 0
    for n in sorted(counts, reverse=True):
        need, left, rank = np.array([n, 1, n * n], np.int64), int(counts[n]), 0
        after: list[tuple[np.ndarray, int, int]] = []

        def put(free: np.ndarray, bin_: int, copies: int, size: int) -> None:
            """size pieces into each of the bins."""
            nonlocal left, rank
            for j in range(size):
                out.append((n, rank, copies, bin_, capacity - int(free[0]) + j * n))
                rank += copies
            left -= copies * size
            after.append((free - size * need, bin_, copies))

        ok = np.flatnonzero((room >= need).all(1))
        if len(ok):
            remain = room[ok] / full
            value = (remain * (need / full) * w).sum(1) if score == "dot" else (((room[ok] - need) / full) ** 2 * w).sum(1)
            for i in ok[np.lexsort((first[ok], value))].tolist():
                # a bin that took a piece is tighter than before, so best-fit fills it before the next
                each = int((room[i] // need).min())
                whole, rest = divmod(min(left, int(many[i]) * each), each)
                for copies, size in ((whole, each), (1 if rest else 0, rest)):
                    if copies:
                        put(room[i], int(first[i]), copies, size)
                        first[i] += copies
                        many[i] -= copies
                if not left:
                    break
        if left:
            each = int((full // need).min())
            whole, rest = divmod(left, each)
            for copies, size in ((whole, each), (1 if rest else 0, rest)):
                if copies:
                    put(full, bins, copies, size)
                    bins += copies
        room = np.concatenate([room, np.array([x[0] for x in after], np.int64).reshape(-1, 3)])
        first, many = np.concatenate([first, np.array([x[1] for x in after], np.int64)]), np.concatenate([many, np.array([x[2] for x in after], np.int64)])
        keep = (many > 0) & (room > 0).all(1)
        room, first, many = room[keep], first[keep], many[keep]
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, score: str = "dot", path: str | None = None) -> DataFrame:
    """A row for each piece with its sequence and its place there."""
    spark = docs.sparkSession
    pieces = common.stage(cut_pieces(docs, capacity, path), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = by_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("b"))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = plan(counts, capacity, max_docs, max_cost, score)
    shared = spark.sparkContext.broadcast(places)
    ranked = pieces.join(before.withColumn("b", F.coalesce("b", F.lit(0))), ["length", "part"])

    def run(batches):
        table = shared.value
        key = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("local").to_numpy() + batch.column("b").to_numpy()
            at = np.searchsorted(key, (length << 44) + rank, "right") - 1
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in PACKED.split(", ")])

    return ranked.mapInArrow(run, PACKED)
