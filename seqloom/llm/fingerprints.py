"""Document fingerprints by one-permutation MinHash, in DataFrame expressions only.

Every shingle (five consecutive words; a shorter text is one) is hashed once. The top bits of the hash choose one of BINS bins, each
bin keeps its least hash. An empty bin takes the value of a filled one chosen by hashing (bin, attempt), optimal densification; after
ATTEMPTS misses it takes the filled bin with the least hash of (bin, filled bin), a choice by hashing too. The low BITS bits of each bin are kept, packed as hexadecimal digits. The likeness
of two fingerprints is the share m of agreeing bins, with the bias of chance agreements taken out: (m - c) / (1 - c), c = 2^-BITS.

How: a row's hashes and one sentinel for each bin (its largest value) are sorted together; the first of each bin is then its minimum,
or the sentinel if it is empty. So no row is exploded and a fingerprint needs no shuffle.

Defined results: a null text is empty; a text without words has the fingerprint of all-zero bins; the likeness of two texts without words is 1,
of one such and another 0. Equal texts have equal fingerprints. Documents with a null doc_id come first; those with one doc_id follow each other in
order of text, repeated rows in any order. Very long texts are taken whole. Other columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS, BIN_BITS, BITS, ATTEMPTS = 5, 8, 8, 32
BINS = 1 << BIN_BITS
LOW = (1 << (63 - BIN_BITS)) - 1  # bits of a hash below its bin number
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def look_at(t: int) -> np.ndarray:
    """The bin that attempt t of each empty bin tries: a hash of bin and attempt."""
    return common.splitmix(np.arange(BINS, dtype=np.uint64) + np.uint64(t * BINS)) % np.uint64(BINS)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out: the packed fingerprint in hexadecimal digits, empty for a text without words.

    Each step is a projection of its own whose columns the next step uses more than once, so that none is computed twice.
    """
    kept = [c for c in df.columns if c != out]
    step = df.withColumn("_w", F.transform(F.filter(F.split(F.lower(F.col(text)), NOT_WORD), lambda w: w != ""), lambda w: F.xxhash64(w)))
    # nulls past the end don't change a hash: a text of fewer words has one shingle of them all
    shingle = lambda w, i: F.xxhash64(w, *[F.get("_w", i + k) for k in range(1, WORDS)]).bitwiseAND(common.MAX63)
    hashes = F.slice(F.transform("_w", shingle), F.lit(1), F.greatest(F.size("_w") - (WORDS - 1), F.lit(1)))
    sentinels = F.expr("array(-1L," + ",".join(f"{b << 63 - BIN_BITS | LOW}L" for b in range(BINS)) + ")")
    step = step.select(*kept, (F.size("_w") > 0).alias("_some"), F.sort_array(F.concat(hashes, sentinels)).alias("_h"))
    # the first of each bin has another bin number than the one before it; -1 stands before the first
    first = F.filter("_h", lambda h, i: F.shiftrightunsigned(h.bitwiseXOR(F.get("_h", i - 1)), 63 - BIN_BITS) != 0)
    step = step.select(*kept, "_some", F.transform(first, lambda h: F.nullif(h.bitwiseAND(LOW), F.lit(LOW))).alias("_b"))
    # the filled bins and their values
    step = step.withColumn("_f", F.filter(F.transform("_b", lambda h, i: F.struct(i.alias("i"), h.alias("h"))), lambda x: x["h"].isNotNull()))
    # where attempt t of each bin looks: constants, folded when the query is planned
    looks = [F.expr("array(" + ",".join(str(int(x)) for x in look_at(t)) + ")") for t in range(ATTEMPTS)]

    def filled(own: Column, i: Column) -> Column:
        tried = [F.get("_b", F.get(look, i)) for look in looks]
        rest = F.array_min(F.transform("_f", lambda x: F.struct(F.xxhash64(i, x["i"]).alias("k"), x["h"].alias("h"))))["h"]
        return F.get(digits, F.coalesce(own, *tried, rest).bitwiseAND((1 << BITS) - 1).cast("int"))

    digits = F.expr("array(" + ",".join(f"'{k:0{BITS // 4}x}'" for k in range(1 << BITS)) + ")")
    return step.select(*kept, F.when(F.col("_some"), F.array_join(F.transform("_b", filled), "")).otherwise(F.lit("")).alias(out))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints."""
    size = BITS // 4
    same = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0), lambda acc, g: acc + (F.substring(a, g * size + 1, F.lit(size)) == F.substring(b, g * size + 1, F.lit(size))).cast("int"))
    match, chance = same / F.lit(float(BINS)), 2.0**-BITS
    value = F.least(F.greatest((match - chance) / (1 - chance), F.lit(0.0)), F.lit(1.0))
    return F.when((F.col(a) == "") | (F.col(b) == ""), (F.col(a) == F.col(b)).cast("double")).otherwise(value)


def as_text(a: str) -> Column:
    """BITS / 4 hexadecimal digits for each bin; a text without words has zeros."""
    return F.when(F.col(a) == "", F.lit("0" * (BINS * BITS // 4))).otherwise(F.col(a))


def with_next(df: DataFrame, source: DataFrame, n_buckets: int) -> DataFrame:
    """Adds next_text and next_fp of the next row in ascending doc_id order (after the last: the first).

    Rows are dealt by ranges of doc_id of about equal size and sorted there; what follows a range's last row is the first row of the next
    range, one row for each range, fetched from source (doc_id, text) by a join. No row order is made in one task.
    """
    cuts = common.id_ranges(source, n_buckets)
    ranged = df.withColumn("_r", common.in_range("doc_id", cuts))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    w = Window.partitionBy("_r").orderBy(*order)
    lead = ranged.withColumns({"_next": F.lead(F.struct("text", "fp")).over(w)})
    # one row for each range: few, whatever the table's size (n_buckets at most)
    least = [(r._r, r.d) for r in source.withColumn("_r", common.in_range("doc_id", cuts)).groupBy("_r").agg(F.min("doc_id").alias("d"), F.count_if(F.col("doc_id").isNull()).alias("z")).select("_r", F.when(F.col("z") > 0, None).otherwise(F.col("d")).alias("d")).orderBy("_r").collect()]
    after = [(r, least[(i + 1) % len(least)][1]) for i, (r, _) in enumerate(least)]
    if not after:
        return lead.select(*df.columns, F.col("_next.text").alias("next_text"), F.col("_next.fp").alias("next_fp"))
    spark = df.sparkSession
    of = F.broadcast(spark.createDataFrame(after, "_r int, _d long"))
    firsts = source.join(of, source["doc_id"].eqNullSafe(of["_d"])).groupBy("_r").agg(F.min("text").alias("text"))
    firsts = with_fingerprint(firsts, "text", "fp").select("_r", F.struct("text", "fp").alias("_first"))
    return lead.join(firsts, "_r", "left").select(*df.columns, F.coalesce("_next.text", "_first.text").alias("next_text"), F.coalesce("_next.fp", "_first.fp").alias("next_fp"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's columns: fingerprints of texts and of their edited texts, and likenesses."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(with_fingerprint(source, "text", "fp"), source, 8 * tasks)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = near.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fp", "next_fp", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    done = with_fingerprint(edited, "edited", "edited_fp")
    return done.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text("fp").alias("fingerprint"),
        as_text("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
    )
