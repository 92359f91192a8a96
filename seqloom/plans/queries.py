"""Registered queries of the mapping engine over the driver's tables, and their oracle SQL.

The tables have no sequences, so letters stand for bases: reads are the texts of documents with each letter as the base of its place in
the alphabet modulo 4, odd ones turned round; references are 20-mers of whole benchmark texts, one every 40 letters. All rows and whole texts are
used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import dna
from seqloom.operators import anchored, anchors, indels, mapping, prototype, reference_set, sam, statistics

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASES = "".join("ACGT"[i % 26 % 4] for i in range(52))
EVERY, SIZE, K = 40, 20, 8


def as_dna(text) -> F.Column:
    return F.translate(F.regexp_replace(text, "[^A-Za-z]", ""), LETTERS, BASES)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    seq = as_dna(F.coalesce("text", F.lit("")))
    seq = F.when(F.col("doc_id") % 2 == 1, dna.reverse_complement(seq)).otherwise(seq)
    df = mapping.spread(docs).select(F.col("doc_id").alias("read_id"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("name"), seq.alias("seq"))
    return df.withColumn("qual", F.when(F.col("read_id") % 7 != 0, F.repeat(F.lit("I"), F.length("seq"))))


def raw_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", as_dna("text").alias("d"))
    last = F.length("d") - (SIZE - 1)
    each = items.where(last >= 1).select("item_id", "d", F.explode(F.sequence(F.lit(1), last, F.lit(EVERY))).alias("o"))
    return each.select(F.format_string("b%d_%d", "item_id", "o").alias("name"), F.col("d").substr(F.col("o"), F.lit(SIZE)).alias("seq"), (F.col("item_id") * 10_000_000 + F.col("o")).cast("long").alias("ord"))


def refs(spark: SparkSession, sf_dir: str, add_rc: bool = True) -> DataFrame:
    return reference_set.build(raw_refs(spark, sf_dir), K, add_rc)


def _counts(opt: mapping.Options, add_rc: bool = True, topk: int = 0, collapse_rc: bool = True):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = refs(spark, sf_dir, add_rc)
        names = mapping.hit_names(mapping.mapped(reads(spark, sf_dir), r, opt), opt.exclude_multihit)
        out = mapping.counts(names, r, collapse_rc)
        return mapping.ordered(out, topk) if topk else out

    return query


def ref_dup_policy(spark, sf_dir):
    doubled = raw_refs(spark, sf_dir)
    doubled = doubled.unionByName(doubled.withColumn("name", F.concat("name", F.lit("_again"))).withColumn("ord", F.col("ord") + 10**9))
    return reference_set.build(doubled, K, True, "ignore").select("name", "ref", "is_rc")


def seed_scan(seed_mm):
    def query(spark, sf_dir):
        r = refs(spark, sf_dir)
        seeds = mapping.seed_table(r, mapping.Options(K, seed_mm))
        return mapping.seed_hits(reads(spark, sf_dir), seeds, K, SIZE).groupBy("read_id").agg(F.count(F.lit(1)).alias("n_hits"), F.min("pos").alias("first_pos"), F.sum(F.col("seed")).cast("long").alias("seed_sum"))

    return query


def best_per_start(m, seed_mm):
    def query(spark, sf_dir):
        out = mapping.mapped(reads(spark, sf_dir), refs(spark, sf_dir), mapping.Options(K, seed_mm, m))
        return out.select("read_id", "pos", "name", "ed")

    return query


def multihit_nh(spark, sf_dir):
    return mapping.with_nh(mapping.mapped(reads(spark, sf_dir), refs(spark, sf_dir), mapping.Options(K, 0, 1))).select("read_id", "pos", "name", "nh")


def collapsed(spark, sf_dir, m):
    return mapping.collapsed(mapping.mapped(reads(spark, sf_dir), refs(spark, sf_dir), mapping.Options(K, 0, m)), m)


def nearby_collapse(spark, sf_dir):
    return collapsed(spark, sf_dir, 5).select("read_id", "name", "pos", "ed")


def sam_mapped(soft):
    def query(spark, sf_dir):
        best = mapping.mapped(reads(spark, sf_dir), refs(spark, sf_dir), mapping.Options(K, 0, 1), "all" if soft else "part")
        return sam.mapped(mapping.with_nh(best), soft=soft)

    return query


def sam_unmapped(spark, sf_dir):
    return sam.unmapped(mapping.missed(reads(spark, sf_dir), refs(spark, sf_dir), mapping.Options(K, 0, 0)))


def total_hits(spark, sf_dir):
    r = reads(spark, sf_dir)
    names = mapping.hit_names(mapping.mapped(r, refs(spark, sf_dir), mapping.Options(K, 0, 3)))
    return mapping.summary(names, r.agg(F.count(F.lit(1)).alias("n_reads")))


def sam_names_and_qualities(spark, sf_dir):
    """Rows of unmapped reads, some of whose names end with /rc and some of whose qualities have another length."""
    r = reads(spark, sf_dir).withColumn("name", F.when(F.col("read_id") % 5 == 0, F.concat("name", F.lit("/rc"))).otherwise(F.col("name")))
    r = r.withColumn("qual", F.when(F.col("read_id") % 11 == 0, F.lit("I")).otherwise(F.col("qual")))
    return sam.unmapped(mapping.missed(r, refs(spark, sf_dir), mapping.Options(K, 0, 3)))


def sam_all(spark, sf_dir):
    """Mapped and unmapped rows, as the count command writes them; multihits stay, whatever the counts leave out."""
    r, d, opt = reads(spark, sf_dir), refs(spark, sf_dir), mapping.Options(K, 0, 1, exclude_multihit=True)
    return sam.mapped(mapping.with_nh(mapping.mapped(r, d, opt, "part"))).select("read_id", "line").unionByName(sam.unmapped(mapping.missed(r, d, opt)))


def exact_counts(spark, sf_dir):
    """Counts of rows without errors by reference, as a table of alignments is summarised."""
    return collapsed(spark, sf_dir, 3).where("ed = 0").groupBy(dna.base_name(F.col("name")).alias("key")).agg(F.count(F.lit(1)).alias("count"))


def mapping_stats(spark, sf_dir):
    """Reads, mapped, exactly mapped and multimapped reads."""
    by_read = collapsed(spark, sf_dir, 3).groupBy("read_id").agg(F.min("ed").alias("ed"), F.count_distinct("name").alias("n"))
    out = by_read.agg(F.count(F.lit(1)).alias("mapped"), F.count_if(F.col("ed") == 0).alias("exact"), F.count_if(F.col("n") > 1).alias("multimapped"))
    return reads(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_reads")).join(out)


def alignment_table(spark, sf_dir):
    """All SAM rows as a table; a read's rows after the first are marked secondary, as aligners do, and one read in nine lacks a proper pair."""
    rows = sam_all(spark, sf_dir).select("read_id", "line", *statistics.fields(F.col("line")))
    left = F.coalesce(F.regexp_extract("cigar", "^([0-9]+)H", 1).try_cast("int"), F.lit(0))
    place = F.row_number().over(Window.partitionBy("read_id").orderBy(left))
    flag = F.col("flag") + F.when(F.col("place") > 1, 256).otherwise(0) + F.when(F.col("read_id") % 9 != 0, 2).otherwise(0)
    return rows.withColumn("place", place).withColumn("flag", flag).withColumn("ord", F.col("read_id"))


def alignment_stats(spark, sf_dir):
    d = refs(spark, sf_dir).select(dna.base_name(F.col("name")).alias("name"), "ref_len")
    return statistics.summary(alignment_table(spark, sf_dir), d)


def alignment_counts(spark, sf_dir):
    d = refs(spark, sf_dir).select(dna.base_name(F.col("name")).alias("name"))
    return statistics.counts(alignment_table(spark, sf_dir), d)


def prototype_counts(spark, sf_dir):
    raw = raw_refs(spark, sf_dir)
    return prototype.counts(prototype.names(reads(spark, sf_dir), raw), raw)


def prototype_cache(spark, sf_dir):
    """The reads of each reference, joined by semicolons."""
    raw, r = raw_refs(spark, sf_dir), reads(spark, sf_dir)
    return prototype.cache(prototype.names(r, raw), r, raw)


A5, A3 = "GATTACA", "CCTGAAC"


def anchored_reads(spark, sf_dir):
    """Reads with a reference between anchors put in after ten bases; every third one has another base in its place read_id mod 20."""
    r, d = reads(spark, sf_dir), refs(spark, sf_dir)
    d = d.select((F.row_number().over(Window.orderBy("name")) - 1).alias("i"), "ref")
    n = d.count()
    both = r.join(F.broadcast(d), F.pmod("read_id", F.lit(n)) == F.col("i"))
    at = (F.pmod("read_id", F.lit(SIZE)) + 1).cast("int")
    other = F.translate(F.substring("ref", at, F.lit(1)), "ACGT", "CGTA")
    insert = F.when(F.col("read_id") % 3 == 0, F.concat(F.substring("ref", F.lit(1), at - 1), other, F.substring("ref", at + 1, F.lit(SIZE)))).otherwise(F.col("ref"))
    seq = F.concat(F.substring("seq", 1, 10), F.lit(A5), insert, F.lit(A3), F.col("seq").substr(F.lit(11), F.length("seq")))
    return both.select("read_id", "name", seq.alias("seq"), F.lit(None).cast("string").alias("qual"))


def count_with_anchors(spark, sf_dir):
    d = refs(spark, sf_dir)
    found = anchored.mapped(anchored_reads(spark, sf_dir), d, anchors.Anchors(A5, A3), mapping.Options(K, 0, 1))
    return mapping.counts(found.names, d)


def cut_check_rc(spark, sf_dir):
    return anchors.cut(reads(spark, sf_dir), anchors.Anchors("ACACATT", "", 0, 20, 20), check_rc=True).select("read_id", "seq", "from_rc")


TWO = anchors.Anchors("ACA", "CAG", 0, 20, 20)


def anchor_windows(opt):
    def query(spark, sf_dir):
        out = anchors.extracted(reads(spark, sf_dir), opt)
        return out.where(F.col("orientation").isNotNull()).select("read_id", "orientation", "insert_start", "insert_len")

    return query


def cut(what):
    def query(spark, sf_dir):
        r = reads(spark, sf_dir)
        trimmed = anchors.cut(r, TWO)
        return {"trim": lambda: trimmed.select("read_id", "seq", "qual"), "counts": lambda: anchors.insert_counts(trimmed), "stats": lambda: anchors.cut_stats(r, trimmed)}[what]()

    return query


def map_indel(spark, sf_dir):
    return indels.mapped(reads(spark, sf_dir), refs(spark, sf_dir), mapping.Options(K, 0, 2, indel=True)).select("read_id", "pos", "name", "ed", "gaps", "span", "ops")


QUERIES = {
    "ref_build": lambda s, d: refs(s, d).select("name", "ref", "ref_len", "is_rc"),
    "ref_dup_policy": ref_dup_policy,
    "ref_lengths": lambda s, d: reference_set.lengths(raw_refs(s, d), K),
    "seed_scan_exact": seed_scan(0),
    "seed_scan_mm1": seed_scan(1),
    "map_exact_count": _counts(mapping.Options(K, 0, 0)),
    "map_sub_count_m1": _counts(mapping.Options(K, 0, 1)),
    "map_sub_count_m3": _counts(mapping.Options(K, 0, 3)),
    "map_seed_mm1_count": _counts(mapping.Options(K, 1, 2)),
    "map_no_rc": _counts(mapping.Options(K, 0, 1), add_rc=False),
    "map_names_not_collapsed": _counts(mapping.Options(K, 0, 1), collapse_rc=False),
    "map_exclude_multihit": _counts(mapping.Options(K, 0, 3, exclude_multihit=True)),
    "counts_topk": _counts(mapping.Options(K, 0, 0), topk=10),
    "map_best_per_start": best_per_start(3, 0),
    "map_best_per_start_mm1": best_per_start(2, 1),
    "map_nearby_collapse": nearby_collapse,
    "map_multihit_nh": multihit_nh,
    "map_indel": map_indel,
    "sam_header": lambda s, d: sam.header(refs(s, d)).select("sn", "ln"),
    "sam_mapped": sam_mapped(False),
    "sam_mapped_soft": sam_mapped(True),
    "sam_unmapped": sam_unmapped,
    "sam_names_and_qualities": sam_names_and_qualities,
    "sam_all": sam_all,
    "alignment_stats": alignment_stats,
    "alignment_counts": alignment_counts,
    "prototype_counts": prototype_counts,
    "prototype_cache": prototype_cache,
    "count_with_anchors": count_with_anchors,
    "cut_check_rc": cut_check_rc,
    "total_hits_summary": total_hits,
    "exact_nm0_counts": exact_counts,
    "mapping_stats": mapping_stats,
    "anchor_two_sided_exact": anchor_windows(TWO),
    "anchor_5only": anchor_windows(anchors.Anchors("ACACA", "", 0, 20, 20)),
    "anchor_3only": anchor_windows(anchors.Anchors("", "CAGCA", 0, 20, 20)),
    "anchor_approx": anchor_windows(anchors.Anchors("ACACATTG", "CAGCATAG", 1, 10, 40)),
    "cut_trim": cut("trim"),
    "cut_counts": cut("counts"),
    "cut_stats": cut("stats"),
    "za_tag": lambda s, d: anchors.tags(reads(s, d), TWO),
    "prefix_lookup": lambda s, d: reference_set.starting_with(refs(s, d), refs(s, d).select(F.substring("ref", 1, 6).alias("prefix")).distinct()),
    "exact_lookup": lambda s, d: reference_set.lookup(refs(s, d).select("name", "ref"), raw_refs(s, d).select("seq").distinct()),
}

# ---- oracle SQL

_DNA = f"translate(regexp_replace({{}}, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{BASES}')"
_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
_BASE = f"""
WITH d0 AS (SELECT doc_id AS read_id, {_DNA.format("coalesce(text, '')")} AS s FROM documents),
reads AS (SELECT read_id, 'r' || read_id AS name, CASE WHEN read_id % 2 = 1 THEN {_RC.format("s")} ELSE s END AS seq FROM d0),
bd AS (SELECT item_id, {_DNA.format("text")} AS d FROM benchmark),
raw AS (SELECT printf('b%d_%d', item_id, o) AS name, substr(d, o, {SIZE}) AS seq, item_id * 10000000 + o AS ord FROM bd, unnest(generate_series(1, length(d) - {SIZE - 1}, {EVERY})) AS t(o)),
cand AS (SELECT name, seq AS ref, 2 * ord AS ord, false AS is_rc FROM raw UNION ALL SELECT name || '/rc', {_RC.format("seq")}, 2 * ord + 1, true FROM raw),
refs AS (SELECT name, ref, length(ref) AS ref_len, is_rc, ord FROM cand QUALIFY row_number() OVER (PARTITION BY ref ORDER BY ord) = 1)
"""
_MAP = (
    _BASE
    + f""",
kset AS (SELECT DISTINCT substr(ref, 1, {K}) AS kmer FROM refs{{where}}),
tiles AS (SELECT read_id, length(seq) AS n, t, substr(seq, t + 1, {128 + SIZE - 1}) AS s FROM reads, unnest(generate_series(0, greatest(length(seq) - {SIZE}, 0), 128)) AS g(t) WHERE length(seq) >= {SIZE}),
win AS (SELECT read_id, n, t + i AS pos, substr(s, i + 1, {SIZE}) AS w FROM tiles, unnest(generate_series(0, 127)) AS g(i) WHERE t + i + {SIZE} <= n),
found AS (SELECT win.read_id, win.pos, refs.name, refs.ref, hamming(win.w, refs.ref) AS ed, win.w FROM win JOIN refs ON substr(win.w, 1, {K}) = substr(refs.ref, 1, {K}) WHERE hamming(win.w, refs.ref) <= {{m}}{{rc}}),
best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY read_id, pos ORDER BY ed, name) = 1),
names AS (SELECT DISTINCT read_id, name FROM best)
"""
)


def _map(m: int, rc: bool = True) -> str:
    return _MAP.format(m=m, where="" if rc else " WHERE NOT is_rc", rc="" if rc else " AND NOT refs.is_rc")


_COUNT = """SELECT regexp_replace(r.name, '/rc$', '') AS key, CAST(sum(coalesce(n.n, 0)) AS BIGINT) AS count
FROM (SELECT DISTINCT name FROM refs{rc}) r LEFT JOIN (SELECT name, count(*) AS n FROM {names} GROUP BY name) n USING (name) GROUP BY 1"""


def _count(m: int, rc: bool = True, names: str = "names") -> str:
    return _map(m, rc) + _COUNT.format(rc="" if rc else " WHERE NOT is_rc", names=names)


_ANCHOR = (
    _BASE
    + """,
atiles AS (SELECT read_id, length(seq) AS n, t, substr(seq, t + 1, 127 + {size}) AS s FROM {reads}, unnest(generate_series(0, length(seq), 128)) AS g(t)),
pos AS (SELECT read_id, n, t + i AS p, substr(s, i + 1, {size}) AS w FROM atiles, unnest(generate_series(0, 127)) AS g(i) WHERE t + i + {size} <= n)
"""
)
_PLACES = _ANCHOR[len(_BASE) :]


def _one_side(anchor: str, five: bool) -> str:
    n = len(anchor)
    # of the first eight places, the first with room for the insert
    start = f"p + {n}" if five else f"p - {SIZE}"
    room = f"p + {n} + {SIZE} <= n" if five else f"p >= {SIZE}"
    return _ANCHOR.format(size=n, reads="reads") + f""", hits AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY p) AS k FROM pos WHERE w = '{anchor}')
SELECT read_id, 'FWD' AS orientation, CAST(min({start}) AS INTEGER) AS insert_start, {SIZE} AS insert_len FROM hits WHERE k <= 8 AND {room} GROUP BY read_id"""


def _rc(s: str) -> str:
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def _windows(a5: str, a3: str, of: str = "reads") -> str:
    """CTEs of the windows of two anchors of one length around an insert of SIZE."""
    n = len(a5)
    return _PLACES.format(size=n, reads=of) + f""", st AS (SELECT read_id, o, p, n FROM (SELECT read_id, n, p, o, row_number() OVER (PARTITION BY read_id, o ORDER BY p) AS k FROM pos JOIN (VALUES (0, '{a5}'), (1, '{_rc(a3)}')) a(o, a) ON w = a) WHERE k <= 8),
en AS (SELECT read_id, o, p FROM pos JOIN (VALUES (0, '{a3}'), (1, '{_rc(a5)}')) a(o, a) ON w = a),
pairs AS (SELECT read_id, o, s, e, n FROM (SELECT st.read_id, st.o, st.p AS s, en.p AS e, st.n, row_number() OVER (PARTITION BY st.read_id, st.o, st.p ORDER BY en.p) AS k FROM st JOIN en ON st.read_id = en.read_id AND st.o = en.o AND en.p >= st.p + {n} AND en.p <= st.p + {n + SIZE}) WHERE e - s - {n} = {SIZE} AND k <= 8),
win AS (SELECT read_id, CASE o WHEN 0 THEN 'FWD' ELSE 'RC' END AS orientation, CAST(s + {n} AS INTEGER) AS insert_start, {SIZE} AS insert_len FROM pairs QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY s, o) = 1)"""


_TWO = _BASE + _windows("ACA", "CAG") + """,
trimmed AS (SELECT read_id, substr(seq, insert_start + 1, 20) AS seq, repeat('I', 20) AS qual FROM win JOIN reads USING (read_id) WHERE read_id % 7 <> 0)
"""

#: Nearby starts as a fold over the sorted starts of a read and name; only the last kept start matters, as starts ascend.
_COLLAPSED = """, ranked AS (SELECT read_id, name, pos, ed, row_number() OVER (PARTITION BY read_id, name ORDER BY pos) AS k FROM best),
fold AS (SELECT read_id, name, k, pos AS p, ed AS e, 1 AS slot FROM ranked WHERE k = 1 UNION ALL
 SELECT r.read_id, r.name, r.k, CASE WHEN r.pos - f.p <= {w} AND r.ed >= f.e THEN f.p ELSE r.pos END, CASE WHEN r.pos - f.p <= {w} AND r.ed >= f.e THEN f.e ELSE r.ed END, f.slot + CASE WHEN r.pos - f.p <= {w} THEN 0 ELSE 1 END
 FROM fold f JOIN ranked r ON r.read_id = f.read_id AND r.name = f.name AND r.k = f.k + 1),
kept AS (SELECT read_id, name, arg_max(p, k) AS pos, arg_max(e, k) AS ed FROM fold GROUP BY read_id, name, slot)
"""


def _folded(m: int) -> str:
    return _map(m).replace("WITH d0", "WITH RECURSIVE d0", 1) + _COLLAPSED.format(w=m - 1)


#: Seeds one substitution from a reference's, with the order in which a read k-mer tries them.
_NEAR = (
    _BASE
    + f""",
seeds AS (SELECT name, ref, substr(ref, 1, {K}) AS seed, 0 AS nb FROM refs UNION ALL
 SELECT name, ref, substr(ref, 1, p) || b || substr(ref, p + 2, {K - 1} - p), p * 4 + strpos('ACGT', substr(ref, p + 1, 1)) FROM refs, unnest(generate_series(0, {K - 1})) AS t(p), (VALUES ('A'), ('C'), ('G'), ('T')) u(b) WHERE b <> substr(ref, p + 1, 1)),
tiles AS (SELECT read_id, length(seq) AS n, t, substr(seq, t + 1, {128 + SIZE - 1}) AS s FROM reads, unnest(generate_series(0, length(seq), 128)) AS g(t)),
win AS (SELECT read_id, n, t + i AS pos, substr(s, i + 1, {{size}}) AS w FROM tiles, unnest(generate_series(0, 127)) AS g(i) WHERE t + i + {{size}} <= n)
"""
)
_NEAR_MAP = _NEAR.format(size=SIZE) + f""",
found AS (SELECT win.read_id, win.pos, name, nb, hamming(w, ref) AS ed FROM win JOIN seeds ON substr(w, 1, {K}) = seed WHERE hamming(w, ref) <= 2),
best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY read_id, pos ORDER BY nb, ed, name) = 1),
names AS (SELECT DISTINCT read_id, name FROM best)
"""
_CODE = " + ".join(f"(strpos('ACGT', substr(w, {i + 1}, 1)) - 1) * {4 ** (K - 1 - i)}" for i in range(K))


def _scan(seeds: str) -> str:
    return _NEAR.format(size=K) + f"SELECT read_id, count(*) AS n_hits, CAST(min(pos) AS INTEGER) AS first_pos, CAST(sum({_CODE}) AS BIGINT) AS seed_sum FROM win WHERE w IN (SELECT seed FROM seeds{seeds}) GROUP BY read_id"


_SAM = _map(1) + """, nh AS (SELECT *, count(*) OVER (PARTITION BY read_id) AS nh FROM best),
md AS (SELECT read_id, pos, string_agg(CASE WHEN substr(w, i, 1) = substr(ref, i, 1) THEN '' ELSE (i - 1 - coalesce(prev, 0))::VARCHAR || substr(ref, i, 1) END, '' ORDER BY i) AS body, max(CASE WHEN substr(w, i, 1) <> substr(ref, i, 1) THEN i ELSE 0 END) AS last
 FROM (SELECT *, max(CASE WHEN substr(w, i, 1) <> substr(ref, i, 1) THEN i END) OVER (PARTITION BY read_id, pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM nh, unnest(generate_series(1, 20)) AS g(i)) GROUP BY read_id, pos)
SELECT read_id, CAST(pos AS INTEGER) AS pos, concat_ws(chr(9), 'r' || read_id, CASE WHEN ends_with(nh.name, '/rc') THEN '16' ELSE '0' END, regexp_replace(nh.name, '/rc$', ''), '1', '255',
 CASE WHEN pos > 0 THEN pos || '{c}' ELSE '' END || '20M' || CASE WHEN length(seq) - pos - 20 > 0 THEN (length(seq) - pos - 20) || '{c}' ELSE '' END, '*', '0', '0', {seq},
 CASE WHEN read_id % 7 <> 0 THEN repeat('I', {len}) ELSE '*' END, 'NM:i:' || ed, CASE WHEN nh > 1 THEN 'NH:i:' || nh END, 'MD:Z:' || body || (20 - last)) AS line
FROM nh JOIN md USING (read_id, pos) JOIN reads USING (read_id)"""

ORACLES = {
    "ref_build": _BASE + "SELECT name, ref, CAST(ref_len AS INTEGER) AS ref_len, is_rc FROM refs",
    "ref_dup_policy": _BASE + "SELECT name, ref, is_rc FROM refs",
    "ref_lengths": _BASE + "SELECT CAST(min(length(seq)) AS INTEGER) AS min_len, CAST(max(length(seq)) AS INTEGER) AS max_len, count(*) AS n_rows FROM raw",
    "seed_scan_exact": _scan(" WHERE nb = 0"),
    "seed_scan_mm1": _scan(""),
    "map_seed_mm1_count": _NEAR_MAP + _COUNT.format(rc="", names="names"),
    "map_best_per_start_mm1": _NEAR_MAP + "SELECT read_id, CAST(pos AS INTEGER) AS pos, name, CAST(ed AS INTEGER) AS ed FROM best",
    "map_nearby_collapse": _folded(5) + "SELECT read_id, name, CAST(pos AS INTEGER) AS pos, CAST(ed AS INTEGER) AS ed FROM kept",
    "map_exact_count": _count(0),
    "map_sub_count_m1": _count(1),
    "map_sub_count_m3": _count(3),
    "map_no_rc": _count(1, False),
    "map_names_not_collapsed": _map(1) + "SELECT r.name AS key, CAST(coalesce(n.n, 0) AS BIGINT) AS count FROM (SELECT DISTINCT name FROM refs) r LEFT JOIN (SELECT name, count(*) AS n FROM names GROUP BY name) n USING (name)",
    "map_exclude_multihit": _map(3) + ", single AS (SELECT read_id, min(name) AS name FROM names GROUP BY read_id HAVING count(*) = 1) " + _COUNT.format(rc="", names="single"),
    "counts_topk": _count(0) + " ORDER BY count DESC, key LIMIT 10",
    "map_best_per_start": _map(3) + "SELECT read_id, CAST(pos AS INTEGER) AS pos, name, CAST(ed AS INTEGER) AS ed FROM best",
    "map_multihit_nh": _map(1) + "SELECT read_id, CAST(pos AS INTEGER) AS pos, name, CAST(count(*) OVER (PARTITION BY read_id) AS INTEGER) AS nh FROM best",
    "sam_header": _BASE + "SELECT regexp_replace(name, '/rc$', '') AS sn, CAST(arg_min(ref_len, ref) AS INTEGER) AS ln FROM refs GROUP BY 1",
    "sam_mapped": _SAM.format(c="H", seq="substr(seq, pos + 1, 20)", len="20"),
    "sam_mapped_soft": _SAM.format(c="S", seq="seq", len="length(seq)"),
    "sam_unmapped": _map(0) + "SELECT read_id, concat_ws(chr(9), name, '4', '*', '0', '0', '*', '*', '0', '0', seq, CASE WHEN read_id % 7 <> 0 THEN repeat('I', length(seq)) ELSE '*' END) AS line FROM reads WHERE read_id NOT IN (SELECT read_id FROM best)",
    "total_hits_summary": _map(3) + "SELECT n_reads, assignments, 100.0::DOUBLE * assignments / n_reads AS percent FROM (SELECT count(*) AS n_reads FROM reads), (SELECT count(*) AS assignments FROM names)",
    "exact_nm0_counts": _folded(3) + "SELECT regexp_replace(name, '/rc$', '') AS key, count(*) AS count FROM kept WHERE ed = 0 GROUP BY 1",
    "mapping_stats": _folded(3) + ", r AS (SELECT read_id, min(ed) AS ed, count(DISTINCT name) AS n FROM kept GROUP BY read_id) SELECT (SELECT count(*) FROM reads) AS n_reads, count(*) AS mapped, count(*) FILTER (ed = 0) AS exact, count(*) FILTER (n > 1) AS multimapped FROM r",
    "sam_names_and_qualities": _map(3) + "SELECT read_id, concat_ws(chr(9), name, '4', '*', '0', '0', '*', '*', '0', '0', seq, CASE WHEN read_id % 11 = 0 THEN CASE WHEN length(seq) = 1 THEN 'I' ELSE '*' END WHEN read_id % 7 <> 0 THEN repeat('I', length(seq)) ELSE '*' END) AS line FROM reads WHERE read_id NOT IN (SELECT read_id FROM best)",
    "sam_all": f"SELECT read_id, line FROM ({_SAM.format(c='H', seq='substr(seq, pos + 1, 20)', len='20')}) UNION ALL SELECT * FROM (" + _map(1) + "SELECT read_id, concat_ws(chr(9), name, '4', '*', '0', '0', '*', '*', '0', '0', seq, CASE WHEN read_id % 7 <> 0 THEN repeat('I', length(seq)) ELSE '*' END) FROM reads WHERE read_id NOT IN (SELECT read_id FROM best))",
    "alignment_stats": _map(1) + """, rows AS (SELECT read_id, name, pos, ed FROM best QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY pos) = 1),
n AS (SELECT (SELECT count(*) FROM best) + (SELECT count(*) FROM reads WHERE read_id NOT IN (SELECT read_id FROM best)) AS alignment_count, (SELECT count(*) FROM best) - (SELECT count(*) FROM rows) AS multimapped, (SELECT count(*) FROM reads) AS read,
 (SELECT count(*) FROM reads WHERE read_id NOT IN (SELECT read_id FROM best)) AS unmapped_mate, (SELECT count(*) FROM rows WHERE read_id % 9 = 0) AS not_proper_pair, (SELECT count(*) FROM rows WHERE ed = 0) AS exact_match, (SELECT count(*) FROM rows) AS mapped)
SELECT alignment_count, multimapped, read, unmapped_mate, not_proper_pair, exact_match, mapped, read AS unpaired, 100.0::DOUBLE * mapped / read AS mapped_percent, CASE WHEN mapped > 0 THEN 100.0::DOUBLE * exact_match / mapped ELSE 0 END AS exact_match_percent FROM n""",
    "alignment_counts": _map(1) + """, rows AS (SELECT regexp_replace(name, '/rc$', '') AS name FROM best QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY pos) = 1)
SELECT r.key, CAST(coalesce(n.n, 0) AS BIGINT) AS count FROM (SELECT DISTINCT regexp_replace(name, '/rc$', '') AS key FROM refs) r LEFT JOIN (SELECT name AS key, count(*) AS n FROM rows GROUP BY name) n USING (key)""",
    "prototype_counts": _map(0) + "SELECT r.name AS key, r.ref, CAST((SELECT count(*) FROM names WHERE names.name IN (r.name, r.name || '/rc')) AS BIGINT) AS count FROM refs r WHERE NOT is_rc",
    "prototype_cache": _map(0) + "SELECT r.name AS seq_id, coalesce(string_agg(DISTINCT 'r' || n.read_id, ';' ORDER BY 'r' || n.read_id), '') AS ref_id FROM refs r LEFT JOIN names n ON n.name IN (r.name, r.name || '/rc') WHERE NOT is_rc GROUP BY r.name",
    "count_with_anchors": _map(1).replace(",\nkset AS", f""",
numbered AS (SELECT row_number() OVER (ORDER BY name) - 1 AS i, ref FROM refs),
put AS (SELECT read_id, substr(seq, 1, 10) || '{A5}' || CASE WHEN read_id % 3 = 0 THEN substr(ref, 1, read_id % {SIZE}) || translate(substr(ref, read_id % {SIZE} + 1, 1), 'ACGT', 'CGTA') || substr(ref, read_id % {SIZE} + 2) ELSE ref END || '{A3}' || substr(seq, 11) AS seq
 FROM reads JOIN numbered ON read_id % (SELECT count(*) FROM numbered) = i),
kset AS""", 1).replace("FROM reads, unnest(generate_series(0, greatest", "FROM put, unnest(generate_series(0, greatest") + _windows(A5, A3, "put").replace("win AS", "awin AS") + f""",
good AS (SELECT awin.* FROM awin JOIN best ON best.read_id = awin.read_id AND best.pos = insert_start),
counted AS (SELECT DISTINCT best.read_id, best.name FROM best JOIN good ON best.read_id = good.read_id WHERE best.pos = insert_start OR best.pos + {SIZE} <= insert_start OR best.pos >= insert_start + {SIZE})
""" + _COUNT.format(rc="", names="counted"),
    "cut_check_rc": _BASE + f""", turned AS (SELECT read_id, {_RC.format("seq")} AS seq FROM reads),
fwd AS (SELECT read_id, strpos(seq, 'ACACATT') AS p, seq FROM reads WHERE read_id % 7 <> 0), hit AS (SELECT read_id, substr(seq, p + 7, 20) AS seq, false AS from_rc FROM fwd WHERE p > 0 AND p + 26 <= length(seq)),
back AS (SELECT read_id, strpos(seq, 'ACACATT') AS p, seq FROM turned WHERE read_id % 7 <> 0 AND read_id NOT IN (SELECT read_id FROM hit))
SELECT * FROM hit UNION ALL SELECT read_id, substr(seq, p + 7, 20), true FROM back WHERE p > 0 AND p + 26 <= length(seq)""",
    "anchor_two_sided_exact": _TWO + "SELECT * FROM win",
    "anchor_5only": _one_side("ACACA", True),
    "anchor_3only": _one_side("CAGCA", False),
    "cut_trim": _TWO + "SELECT * FROM trimmed",
    "cut_counts": _TWO + "SELECT seq AS sequence, count(*) AS count FROM trimmed GROUP BY 1",
    "cut_stats": _TWO + "SELECT total, kept, total - kept AS discarded, CAST(0 AS BIGINT) AS kept_revcomp FROM (SELECT count(*) AS total FROM reads), (SELECT count(*) AS kept FROM trimmed)",
    "prefix_lookup": _BASE + "SELECT substr(ref, 1, 6) AS prefix, name, ref FROM refs",
    "exact_lookup": _BASE + "SELECT name, ref FROM refs WHERE ref IN (SELECT seq FROM raw)",
}
