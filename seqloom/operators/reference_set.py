"""The reference dictionary: normalised sequences and their reverse complements, one row a distinct sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import dna

POLICIES = ("error", "warn", "ignore")


class DuplicateReference(ValueError):
    """A sequence occurs twice under the policy `error`."""


def candidates(refs: DataFrame, k: int = 8, add_rc: bool = True) -> DataFrame:
    """name, ref, ref_len, is_rc, ord of every row that may enter. refs: name, seq, ord (order in the file)."""
    long_enough = refs.where(F.length("seq") >= k).select("name", dna.normalized(F.col("seq")).alias("ref"), (2 * F.col("ord")).alias("ord"), F.lit(False).alias("is_rc"))
    forward = long_enough.where(dna.only_acgt(F.col("ref")))
    out = forward
    if add_rc:
        reverse = forward.select(F.concat("name", F.lit("/rc")).alias("name"), dna.reverse_complement(F.col("ref")).alias("ref"), (F.col("ord") + 1).alias("ord"), F.lit(True).alias("is_rc"))
        out = forward.unionByName(reverse)
    return out.select("name", "ref", F.length("ref").alias("ref_len"), "is_rc", "ord")


def build(refs: DataFrame, k: int = 8, add_rc: bool = True, policy: str = "warn") -> DataFrame:
    """The dictionary: of equal sequences the first in order stays. Under `error` any duplicate stops."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    rows = candidates(refs, k, add_rc)
    if policy == "error" and not rows.groupBy("ref").count().where("count > 1").isEmpty():
        raise DuplicateReference("a reference sequence occurs twice")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("ref").orderBy("ord"))).where("_n = 1").drop("_n")


def lengths(refs: DataFrame, k: int = 8) -> DataFrame:
    """min_len and max_len of the rows long enough, before any other check, and n_rows."""
    return refs.where(F.length("seq") >= k).agg(F.min(F.length("seq")).alias("min_len"), F.max(F.length("seq")).alias("max_len"), F.count(F.lit(1)).alias("n_rows"))


def lookup(refs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Point lookup: rows of the dictionary with exactly these sequences (column seq)."""
    return wanted.join(refs, wanted["seq"] == refs["ref"]).drop("seq")


def starting_with(refs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Prefix lookup, as an equi-join for each prefix length that occurs (column prefix)."""
    sizes = [r.n for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect()]
    parts = [refs.join(prefixes.where(F.length("prefix") == n), F.substring("ref", 1, n) == F.col("prefix")) for n in sizes]
    out = parts[0] if parts else refs.withColumn("prefix", F.lit("")).limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("prefix", "name", "ref")
