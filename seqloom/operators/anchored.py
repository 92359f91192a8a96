"""Counting with anchors: only the part between the anchors decides whether a read is mapped; what lies before and after it adds hits."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import anchors, mapping


@dataclass(frozen=True)
class Anchored:
    names: DataFrame  #: distinct read_id and name, to be counted
    alignments: DataFrame  #: of the inserts, with places on the whole read and its tag in `tag`
    tagged: DataFrame  #: read_id, tag of every read


def expected_length(sizes: DataFrame) -> int:
    """Of a row with min_len and max_len, as reference_set.lengths gives it."""
    row = sizes.first()
    if row.min_len is None or row.min_len != row.max_len:
        raise ValueError("with anchors all references must have one length")
    return row.min_len


def mapped(reads: DataFrame, refs: DataFrame, find: anchors.Anchors, opt: mapping.Options, sizes: DataFrame | None = None) -> Anchored:
    """sizes: reference_set.lengths of all references given, also of those that the dictionary leaves out; by default that of the dictionary."""
    size = expected_length(refs.agg(F.min("ref_len").alias("min_len"), F.max("ref_len").alias("max_len")) if sizes is None else sizes)
    find = replace(find, min_len=size, max_len=size)
    found = anchors.extracted(reads, find).where(F.col("orientation").isNotNull()).select("read_id", "seq", "insert_start", "insert_len")
    tagged = anchors.tags(reads, find).select("read_id", "tag")
    after = F.col("insert_start") + F.col("insert_len")
    inserts = found.select("read_id", F.substring("seq", F.col("insert_start") + 1, F.col("insert_len")).alias("seq"))
    best = mapping.collapsed(mapping.mapped(inserts, refs, opt), opt.max_mm)
    hit = best.select("read_id").distinct()
    head = found.select("read_id", F.substring("seq", F.lit(1), F.col("insert_start")).alias("seq"))
    tail = found.select("read_id", F.substring("seq", after + 1, F.length("seq")).alias("seq"))
    names = best.select("read_id", "name")
    for rest in (head, tail):
        rest = rest.where(F.length("seq") >= size).join(hit, "read_id", "left_semi")
        names = names.unionByName(mapping.mapped(rest, refs, opt).select("read_id", "name"))
    shifted = best.join(found.select("read_id", "insert_start"), "read_id").withColumn("pos", F.col("pos") + F.col("insert_start")).drop("insert_start").join(tagged, "read_id")
    return Anchored(mapping.hit_names(names, opt.exclude_multihit), shifted, tagged)
