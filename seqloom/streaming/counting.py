"""Counting over a stream of reads: the stateless mapping of each micro-batch, with counts added up by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators import mapping


def start(reads: DataFrame, refs: DataFrame, opt: mapping.Options, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's counts under path/batch=<id>; a replayed batch replaces its own folder, so counts are exact."""

    def batch(df: DataFrame, number: int) -> None:
        names = mapping.hit_names(mapping.mapped(df, refs, opt), opt.exclude_multihit)
        mapping.counts(names, refs).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("key").agg(F.sum("count").alias("count"))
