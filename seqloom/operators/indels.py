"""Mapping with insertions and deletions after the seed.

Per seed hit and reference, one banded edit-distance table gives for every read span the least (edits, gaps); the best span is chosen by edits,
gaps, distance of span and length, span, name. Operations are read back from the table, insertion first, then match, then deletion. All
pairs of a batch share one table in numpy (probe.gapped).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import mapping, probe


def align_all(windows: list[str], refs: list[str], k: int, m: int):
    """Places of the pairs that are within m edits, and of those edits, gaps, spans and operations."""
    out: list[tuple] = []
    for size in sorted(set(map(len, refs))):
        own = np.array([i for i, r in enumerate(refs) if len(r) == size])
        text = np.zeros((len(own), size + m), np.uint8)
        for row, i in enumerate(own.tolist()):
            w = windows[i][: size + m].upper().encode()
            text[row, : len(w)] = np.frombuffer(w, np.uint8)
        ref = np.frombuffer("".join(refs[i] for i in own.tolist()).encode(), np.uint8).reshape(len(own), size)
        seed = np.where(text[:, :k] == ord("U"), ord("T"), text[:, :k])
        head = (seed != ref[:, :k]).sum(1).astype(np.int32)
        keep, ed, gaps, span, ops = probe.gapped(text, np.array([len(windows[i]) for i in own.tolist()]), ref, k, m, head)
        out += zip(own[keep].tolist(), ed.tolist(), gaps.tolist(), span.tolist(), ops)
    return sorted(out)


def align(read: str, ref: str, k: int, m: int) -> tuple[int, int, int, str] | None:
    """(edits, gaps, read span, operations) of the best alignment of ref at the read's start; the first k bases aren't gapped."""
    found = align_all([read], [ref], k, m)
    return found[0][1:] if found else None


def joined(reads: DataFrame, refs: DataFrame, opt: mapping.Options) -> DataFrame:
    """mapping.matches with indels, for dictionaries that are too large to be broadcast: a join on the seed, then tables in Arrow batches."""
    m, k = opt.max_mm, opt.k
    lo, hi = refs.agg(F.min("ref_len"), F.max("ref_len")).first()
    seeds = mapping.seed_table(refs, opt)
    hits = mapping.seed_hits(reads, seeds, k, (hi or k) + m).where(F.col("pos") + max(0, (lo or 0) - m) <= F.col("read_len"))
    packed = seeds.select("seed", "nb", "name", "ref", "ref_len", "is_rc")
    # an alignment within m edits has a prefix within m edits: the built-in distance prunes before Python; U in the seed is T
    window = F.concat(F.translate(F.substring(F.upper("window"), 1, k), "U", "T"), F.substring(F.upper("window"), F.lit(k + 1), F.greatest(F.col("ref_len") - k, F.lit(0))))
    names = [x.split()[0] for x in mapping.FOUND.split(", ")]
    both = hits.join(packed, "seed").where(F.levenshtein(window, "ref", 2 * m) >= 0).select("read_id", "read_len", "pos", "name", "ref", "ref_len", "is_rc", "nb", "window")

    def run(batches):
        for batch in batches:
            found = align_all(*(batch.column(c).to_pylist() for c in ("window", "ref")), k, m)
            at, *values = zip(*found) if found else [()] * 5
            some = batch.take(pa.array(at, pa.int64()))
            new = dict(zip(("ed", "gaps", "span"), (pa.array(v, pa.int32()) for v in values))) | {"ops": pa.array(values[3], pa.string())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else some.column(c) for c in names], names=names)

    return both.mapInArrow(run, mapping.FOUND)


def mapped(reads: DataFrame, refs: DataFrame, opt: mapping.Options) -> DataFrame:
    """The best reference at each start, gaps allowed: the columns of mapping.mapped."""
    from dataclasses import replace

    return mapping.mapped(reads, refs, replace(opt, indel=True))


def cigar_of(ops: str, left: int, right: int, soft: bool = False) -> str:
    from itertools import groupby

    clip = "S" if soft else "H"
    runs = "".join(f"{len(list(g))}{c}" for c, g in groupby(ops))
    return f"{left}{clip}" * bool(left) + runs + f"{right}{clip}" * bool(right)


def md_of(ops: str, read: str, ref: str) -> str:
    out, run, i, q, gap = [], 0, 0, 0, False
    for c in ops:
        if c == "I":
            q += 1
            continue
        if c == "D":
            out.append(ref[i] if gap else f"{run}^{ref[i]}")
            run, gap, i = 0, True, i + 1
            continue
        if read[q].upper() == ref[i]:
            run += 1
        else:
            out.append(f"{run}{ref[i]}")
            run = 0
        gap, i, q = False, i + 1, q + 1
    return "".join(out) + str(run)
