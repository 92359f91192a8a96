"""Seeded mapping of reads to references: an approximate substring join.

Reads are scanned once for places whose k-mer begins a reference (or is one substitution from doing so), by a numpy pass
over Arrow batches with a table of 4^k flags. A dictionary that is small (BROADCAST_SEEDS, BROADCAST_BASES; counted first) is broadcast in
arrays, and the pass extends its hits itself, so that only matches become rows, with what SAM rows need of their reads. A larger one is joined on
the seed by a shuffle that adaptive execution may split, with the Hamming distance as bit counts. What follows is relational: the best reference
for each start, collapsing, and counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import dna
from seqloom.operators import probe

#: Entries of the seed table and bases of references that may be broadcast; more are joined by a shuffle on the seed.
BROADCAST_SEEDS, BROADCAST_BASES = 2_000_000, 32_000_000


@dataclass(frozen=True)
class Options:
    k: int = 8
    seed_mm: int = 0
    max_mm: int | None = None
    exclude_multihit: bool = False
    indel: bool = False  #: insertions and deletions after the seed count as edits too

    def __post_init__(self):
        if not 4 <= self.k <= 12:
            raise ValueError("k must be from 4 to 12")
        if self.seed_mm not in (0, 1):
            raise ValueError("seed_mm must be 0 or 1")
        m = self.seed_mm if self.max_mm is None else min(5, max(0, self.max_mm))
        if m < self.seed_mm:
            raise ValueError("max_mm must not be below seed_mm")
        object.__setattr__(self, "max_mm", m)


def seed_table(refs: DataFrame, opt: Options) -> DataFrame:
    """Each reference under its seed and, with seed_mm 1, under the seeds one substitution away; nb orders the attempts (0: exact)."""
    seed = F.substring("ref", 1, opt.k)
    base = refs.withColumn("seed", dna.kmer_code(seed)).withColumn("nb", F.lit(0))
    if not opt.seed_mm:
        return base
    place, alt = F.explode(F.sequence(F.lit(0), F.lit(opt.k - 1))).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("b")
    near = base.select("*", place).select("*", alt)
    own = F.expr(f"cast(shiftright(seed, cast(({opt.k - 1} - p) * 2 as int)) & 3 as int)")
    near = near.withColumn("own", own).where("own != b")
    # a read k-mer tries its own substitutions in order of place and base, and the base that it tries is the reference's
    near = near.withColumn("seed", F.expr(f"seed + shiftleft(cast(b - own as bigint), cast(({opt.k - 1} - p) * 2 as int))")).withColumn("nb", F.col("p") * 4 + F.col("own") + 1)
    return base.unionByName(near.select(*base.columns))


def seed_hits(reads: DataFrame, seeds: DataFrame, k: int, extend: int) -> DataFrame:
    """read_id, read_len, pos, seed, window (at most `extend` bases) of every seed hit of reads (read_id, seq)."""
    # bitmaps of 32,768 seeds each: at most 4^k / 8 bytes come to the driver
    maps = seeds.select((F.col("seed") + 1).alias("v")).groupBy(F.bitmap_bucket_number("v").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))
    flags = np.zeros(-(-(4**k) // 32768) * 4096, np.uint8)
    for r in maps.collect():
        flags[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.bits, np.uint8)
    shared = reads.sparkSession.sparkContext.broadcast(flags)

    def run(batches):
        on = np.unpackbits(shared.value, bitorder="little").astype(bool)
        for batch in batches:
            data, begin = probe.flat(batch.column("seq"))
            size = np.diff(begin)
            for at, read, codes in probe.seed_places(data, begin, on, k):
                for i in range(0, len(at), probe.ROWS):
                    a, r, c = (x[i : i + probe.ROWS] for x in (at, read, codes))
                    cols = [batch.column("read_id").take(pa.array(r)), pa.array(size[r].astype(np.int32)), pa.array((a - begin[r]).astype(np.int32)), pa.array(c), probe.parts(data, a, np.minimum(extend, begin[r + 1] - a))]
                    yield pa.RecordBatch.from_arrays(cols, names=["read_id", "read_len", "pos", "seed", "window"])

    return reads.select(F.col("read_id").cast("long").alias("read_id"), "seq").mapInArrow(run, "read_id long, read_len int, pos int, seed long, window string")


def spread(reads: DataFrame) -> DataFrame:
    """One large file gives few tasks; deal its rows to as many as the session shuffles to."""
    n = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reads.repartition(n) if reads.rdd.getNumPartitions() < n else reads


def dictionary(refs: DataFrame, opt: Options) -> probe.Dictionary | None:
    """The references in arrays if they are few enough to be broadcast."""
    size = refs.agg(F.count(F.lit(1)).alias("n"), F.max("ref_len").alias("hi")).first()
    entries = size.n * (3 * opt.k * opt.seed_mm + 1)
    if entries > BROADCAST_SEEDS or size.n * (size.hi or 0) > BROADCAST_BASES:
        return None
    return probe.Dictionary(refs.select("name", "ref", "ref_len", "is_rc").orderBy("name", "ref").toArrow(), opt.k, opt.seed_mm)


FOUND = "read_id long, read_len int, pos int, name string, ref string, ref_len int, is_rc boolean, nb int, ed int, gaps int, span int, ops string, window string"
#: What SAM rows need of a read: its name, and sequence and quality of the match (or all of them); quality null if it is shorter than the sequence.
CARRIED = "read_name string, seq_part string, qual_part string"


def matches(reads: DataFrame, refs: DataFrame, opt: Options, carry: str = "") -> DataFrame:
    """All references within max_mm at each start of each read: the columns of FOUND.

    carry: "part" or "all" adds CARRIED, with the matched part or the whole of sequence and quality; reads then have name and qual.
    ops are null without opt.indel. Of several alignments of a reference at a start the best one counts.
    """
    small = dictionary(refs, opt)
    if small is not None:
        return _probed(reads, small, opt, carry)
    found = _joined(reads, refs, opt)
    if not carry:
        return found
    own = reads.select(F.col("read_id").cast("long").alias("read_id"), F.col("name").alias("read_name"), "seq", "qual")
    part = lambda c: F.substring(c, F.lit(1), F.length("seq")) if carry == "all" else F.substring(c, F.col("pos") + 1, F.col("span"))
    both = found.join(own, "read_id")
    whole = F.length("qual") >= F.length("seq")
    return both.select(*found.columns, "read_name", part("seq").alias("seq_part"), F.when(whole, part("qual")).alias("qual_part"))


def extended(data: np.ndarray, begin: np.ndarray, at: np.ndarray, read: np.ndarray, row: np.ndarray, lexicon: probe.Dictionary, opt: Options):
    """Which pairs of place and reference are within max_mm, and their edits, gaps, spans and operations (None without indels)."""
    left, m = begin[read + 1] - at, opt.max_mm
    if not opt.indel:
        fit = np.flatnonzero(left >= lexicon.length[row])
        ed = probe.hamming(data, at[fit], row[fit], lexicon.bases, lexicon.length)
        # the seed counts U as T
        ed -= _lenient(data, at[fit], row[fit], lexicon)
        keep = ed <= m
        return fit[keep], ed[keep], np.zeros(int(keep.sum()), np.int64), lexicon.length[row[fit][keep]], None
    out = [[], [], [], [], []]
    fit = left + m >= lexicon.lo
    for size in np.unique(lexicon.length[row[fit]]).tolist():
        own = np.flatnonzero(fit & (lexicon.length[row] == size))
        place = at[own, None] + np.arange(size + m)
        inside = place < begin[read[own] + 1, None]
        windows = np.where(inside, probe.UPPER[data[np.minimum(place, len(data) - 1)]], 0)
        ref = lexicon.bases[row[own], :size]
        first = np.where(windows[:, : lexicon.k] == ord("U"), ord("T"), windows[:, : lexicon.k])
        head = (first != ref[:, : lexicon.k]).sum(1).astype(np.int32)
        keep, ed, gaps, span, ops = probe.gapped(windows, left[own], ref, lexicon.k, m, head)
        for x, y in zip(out, (own[keep], ed, gaps, span, np.array(ops, object))):
            x.append(y)
    empty = np.zeros(0, np.int64)
    own, ed, gaps, span, ops = (np.concatenate([empty if i < 4 else empty.astype(object), *x]) for i, x in enumerate(out))
    order = np.argsort(own, kind="stable")
    return own[order].astype(np.int64), ed[order], gaps[order], span[order], ops[order]


def _lenient(data: np.ndarray, at: np.ndarray, row: np.ndarray, lexicon: probe.Dictionary) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    if (data == ord("U")).any() or (data == ord("u")).any():
        for i in range(lexicon.k):
            out += (probe.UPPER[data[at + i]] == ord("U")) & (lexicon.bases[row, i] == ord("T"))
    return out


def _probed(reads: DataFrame, lexicon: probe.Dictionary, opt: Options, carry: str, missed: bool = False) -> DataFrame:
    """matches() by the scan itself; missed: the rows of reads (read_id, name, seq, qual) without any match instead."""
    shared = reads.sparkSession.sparkContext.broadcast(lexicon)
    own = ["name", "qual"] if carry or missed else []

    def run(batches):
        lex = shared.value
        on = lex.flags()
        for batch in batches:
            data, begin = probe.flat(batch.column("seq"))
            size = np.diff(begin)
            hit = np.zeros(batch.num_rows, bool)
            for at, read, codes in probe.seed_places(data, begin, on, lex.k):
                for a, r, row, order in lex.pairs(at, read, codes):
                    keep, ed, gaps, span, ops = extended(data, begin, a, r, row, lex, opt)
                    if missed:
                        hit[r[keep]] = True
                    elif len(keep):
                        yield rows_of(batch, data, begin, size, a[keep], r[keep], row[keep], order[keep], ed, gaps, span, ops, lex)
            if missed:
                yield batch.filter(pa.array(~hit))

    def rows_of(batch, data, begin, size, a, r, row, order, ed, gaps, span, ops, lex):
        of, ref = pa.array(r), pa.array(row)
        reach = np.minimum(lex.hi + (opt.max_mm if opt.indel else 0), begin[r + 1] - a)
        cols = [batch.column("read_id").take(of), pa.array(size[r].astype(np.int32)), pa.array((a - begin[r]).astype(np.int32))]
        cols += [lex.refs.column(c).combine_chunks().take(ref).cast(t) for c, t in (("name", pa.string()), ("ref", pa.string()), ("ref_len", pa.int32()), ("is_rc", pa.bool_()))]
        cols += [pa.array(x.astype(np.int32)) for x in (order, ed, gaps, span)]
        cols += [pa.nulls(len(a), pa.string()) if ops is None else pa.array(ops.tolist(), pa.string()), probe.parts(data, a, reach)]
        if carry:
            qual, q = probe.flat(batch.column("qual"))
            whole = (np.diff(q) >= size)[r] & batch.column("qual").is_valid().to_numpy(zero_copy_only=False)[r]
            cols.append(batch.column("name").take(of))
            start, n = (begin[r], size[r]) if carry == "all" else (a, span)
            cols.append(probe.parts(data, start, n))
            part = probe.parts(qual, q[r] + (start - begin[r]), np.where(whole, n, 0))
            cols.append(pa.array(part.to_pylist(), pa.string(), mask=~whole))
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in kind.split(", ")])

    source = reads.select(F.col("read_id").cast("long").alias("read_id"), "seq", *own)
    kind = FOUND + (", " + CARRIED if carry else "")
    return source.mapInArrow(run, source.schema if missed else kind)


def _joined(reads: DataFrame, refs: DataFrame, opt: Options) -> DataFrame:
    """matches() by a join on the seed."""
    if opt.indel:
        from seqloom.operators import indels

        return indels.joined(reads, refs, opt)
    seeds = seed_table(refs, opt)
    lo, hi = refs.agg(F.min("ref_len"), F.max("ref_len")).first()
    hits = seed_hits(reads, seeds, opt.k, hi).where(F.col("pos") + lo <= F.col("read_len"))
    blocks = range(len(range(0, hi, dna.BLOCK)))
    # the seed counts U as T
    window = F.concat(F.translate(F.substring(F.upper("window"), 1, opt.k), "U", "T"), F.substring("window", opt.k + 1, hi))
    hits = hits.select("*", *[c.alias(f"w{i}") for i, c in enumerate(dna.one_hot(window, hi))])
    packed = seeds.select("*", *[c.alias(f"r{i}") for i, c in enumerate(dna.one_hot(F.col("ref"), hi))])
    ed = F.col("ref_len") - dna.matches([F.col(f"w{i}") for i in blocks], [F.col(f"r{i}") for i in blocks])
    both = hits.join(packed, "seed").withColumns({"ed": ed, "gaps": F.lit(0), "span": F.col("ref_len"), "ops": F.lit(None).cast("string")})
    return both.where((F.col("ed") <= opt.max_mm) & (F.col("pos") + F.col("ref_len") <= F.col("read_len"))).select(*[x.split()[0] for x in FOUND.split(", ")])


def deviation() -> Column:
    return F.abs(F.col("span") - F.col("ref_len"))


def best_per_start(found: DataFrame) -> DataFrame:
    """One reference for each start: exact seed before neighbours in their order, then fewest edits, fewest gaps, nearest span, shorter span, name."""
    key = F.struct("nb", "ed", "gaps", deviation().alias("dev"), "span", "name")
    row = F.struct(*[c for c in found.columns if c not in ("read_id", "pos", "nb")])
    return found.groupBy("read_id", "pos").agg(F.min_by(row, key).alias("r")).select("read_id", "pos", "r.*")


def collapsed(best: DataFrame, max_mm: int) -> DataFrame:
    """Starts of one reference in a read that lie within max_mm - 1 of a kept one become one: the better (edits, gaps, span), else the first.

    The order of starts matters, as a better start moves what later ones are compared with. A start beyond the last kept one is beyond all
    kept before it, so only the last is looked at: one pass over sorted rows, whatever a read's number of hits.
    """
    w = max_mm - 1
    if w < 1:
        return best
    with_gaps = "gaps" in best.columns
    rows = best.withColumns({"_gaps": F.col("gaps") if with_gaps else F.lit(0), "_dev": deviation() if with_gaps else F.lit(0)})
    rows = rows.repartition("read_id", "name").sortWithinPartitions("read_id", "name", "pos")

    def run(batches):
        own, kept = None, None  # read and name; the last kept record: its rank, its place and its row
        for batch in batches:
            out: list[pa.RecordBatch | int] = []
            for i, (read_id, name, pos, *rank) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("read_id", "name", "pos", "ed", "_gaps", "_dev")))):
                if own == (read_id, name) and pos - kept[1] <= w:
                    if rank < kept[0]:
                        kept = (rank, pos, i)
                    continue
                if kept is not None:
                    out.append(kept[2])
                own, kept = (read_id, name), (rank, pos, i)
            for x in out:
                if isinstance(x, pa.RecordBatch):
                    yield x
            yield batch.take(pa.array([x for x in out if isinstance(x, int)], pa.int64()))
            if kept is not None and isinstance(kept[2], int):
                kept = (*kept[:2], batch.slice(kept[2], 1))
        if kept is not None:
            yield kept[2]

    return rows.mapInArrow(run, rows.schema).select(*best.columns)


def hit_names(best: DataFrame, exclude_multihit: bool = False) -> DataFrame:
    """Distinct read_id and name; reads with several names go with exclude_multihit."""
    names = best.select("read_id", "name").distinct()
    if exclude_multihit:
        single = names.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), F.first("name").alias("name")).where("n = 1")
        names = single.select("read_id", "name")
    return names


def counts(names: DataFrame, refs: DataFrame, collapse_rc: bool = True) -> DataFrame:
    """key, count: reads of each reference name, zeros kept; `x/rc` adds to x. Sort with ordered()."""
    own = names.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    key = dna.base_name(F.col("name")) if collapse_rc else F.col("name")
    every = refs.select("name").distinct()
    return every.join(own, "name", "left").groupBy(key.alias("key")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("count"))


def ordered(counted: DataFrame, topk: int = 0) -> DataFrame:
    """Largest count first, then key; topk 0 keeps all."""
    out = counted.orderBy(F.col("count").desc(), "key")
    return out.limit(topk) if topk else out


def summary(names: DataFrame, n_reads: DataFrame) -> DataFrame:
    """n_reads, assignments and their percentage of the reads, which may pass 100."""
    total = names.agg(F.count(F.lit(1)).alias("assignments"))
    return n_reads.join(total).select("n_reads", "assignments", F.when(F.col("n_reads") > 0, 100.0 * F.col("assignments") / F.col("n_reads")).otherwise(0.0).alias("percent"))


def mapped(reads: DataFrame, refs: DataFrame, opt: Options, carry: str = "") -> DataFrame:
    """The best reference at each start: the columns of FOUND but nb, and CARRIED with carry."""
    return best_per_start(matches(reads, refs, opt, carry))


def missed(reads: DataFrame, refs: DataFrame, opt: Options) -> DataFrame:
    """read_id, name, seq, qual of the reads without a match."""
    small = dictionary(refs, opt)
    if small is not None:
        return _probed(reads, small, opt, "", missed=True).select("read_id", "name", "seq", "qual")
    hit = _joined(reads, refs, opt).select("read_id").distinct()
    return reads.join(hit, "read_id", "left_anti").select("read_id", "name", "seq", "qual")


def with_nh(alignments: DataFrame) -> DataFrame:
    return alignments.withColumn("nh", F.count(F.lit(1)).over(Window.partitionBy("read_id")).cast("int"))
