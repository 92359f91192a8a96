"""The prototype's results: exact places of references by seeds of ten bases, a table of counts and the reads of each reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import dna
from seqloom.operators import mapping, reference_set

SEED = 10
#: Reads of one row of the cache; a reference of more reads has several rows.
READS = 100_000


def names(reads: DataFrame, raw: DataFrame) -> DataFrame:
    """Distinct read_id and name (`x/rc` for the reverse complement of x) of exact places; raw: name, seq, ord."""
    refs = reference_set.build(raw, SEED, True, "ignore")
    return mapping.hit_names(mapping.mapped(reads, refs, mapping.Options(SEED)))


def counts(hits: DataFrame, raw: DataFrame) -> DataFrame:
    """key, ref, count: reads of each forward reference, those of its reverse complement added, zeros kept."""
    refs = reference_set.build(raw, SEED, True, "ignore")
    own = refs.where(~F.col("is_rc")).select(F.col("name").alias("key"), "ref")
    return own.join(mapping.counts(hits, refs), "key").select("key", "ref", "count")


def cache(hits: DataFrame, reads: DataFrame, raw: DataFrame) -> DataFrame:
    """seq_id, ref_id: each forward reference and the names of its reads, in order, joined by semicolons; READS of them in a row on average at most."""
    refs = reference_set.build(raw, SEED, True, "ignore").where(~F.col("is_rc")).select(F.col("name").alias("seq_id"))
    own = hits.select("read_id", dna.base_name(F.col("name")).alias("seq_id")).distinct().join(reads.select("read_id", F.col("name").alias("read_name")), "read_id")
    blocks = own.groupBy("seq_id").agg(F.ceil(F.count(F.lit(1)) / READS).alias("blocks"))
    dealt = own.join(blocks, "seq_id").groupBy("seq_id", F.pmod(F.xxhash64("read_name"), F.col("blocks")).alias("block"))
    rows = dealt.agg(F.concat_ws(";", F.sort_array(F.collect_set("read_name"))).alias("ref_id"))
    return refs.join(rows, "seq_id", "left").select("seq_id", F.coalesce("ref_id", F.lit("")).alias("ref_id"))
