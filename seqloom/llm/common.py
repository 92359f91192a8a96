"""Helpers shared by the training-data operators: table access, the shared folder, bounded samples, doc_id ranges."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX63 = (1 << 63) - 1
#: Most rows of one Arrow batch that goes to Python, and bytes after which a batch ends (a longer row is a batch of its own).
ARROW_ROWS, ARROW_BYTES = 500, 32_000_000
#: Most label values of a bounded sample; of more, the most frequent ones.
LABELS = 64

_LOWER = bytes(range(256)).lower()
#: For bytes.translate: A-Z to a-z; what is no ASCII letter, digit or part of a non-ASCII character becomes a space.
WORD_BYTES = bytes(_LOWER[b] if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Arrow batches of the session are bounded from here on, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir of the session. Unset, a temporary one serves a local master (tests); a cluster must set it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        # the setting can't be changed in a running session, so the folder is kept here
        root = _own_roots.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="seqloom-")
        _own_roots[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


_own_roots: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, removed when the driver ends."""
    path = f"{shared_root(spark)}/seqloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    path = new_folder(df.sparkSession, name) + "/t"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a staged table that nothing reads any more; other tables stay as they are."""
    if path := getattr(df, "_staged", None):
        p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free(spark: SparkSession) -> None:
    """Shuffle files that nothing refers to any more go: Spark removes them after the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held(remainder: int, modulus: int, doc_id: str = "doc_id") -> F.Column:
    """crc32 of doc_id as text has that remainder; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def hashed(seed: int, *cols: str) -> F.Column:
    """A uniform number below 2^63 from the columns."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]).bitwiseAND(MAX63)


def bounded_sample(df: DataFrame, label: str, per_class: int, key: str = "doc_id", seed: int = 17) -> tuple[DataFrame, dict]:
    """About per_class rows of each value of label (of the LABELS most frequent ones), by a hash of key, and the share of each value that was taken.

    Only a count for each of these values comes to the driver. The same rows come whatever the partitioning.
    """
    top = df.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(LABELS)
    counts = {r[0]: r[1] for r in top.collect()}
    share = {k: min(1.0, per_class / n) for k, n in counts.items()}
    keep = F.lit(False)
    for k, s in share.items():
        keep = keep | ((F.col(label) == F.lit(k)) & (hashed(seed, key) <= min(MAX63, int(s * (1 << 63)))))
    return df.where(keep), share


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema) -> DataFrame:
    """mapInArrow with a function made once a task; it turns a batch into columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type, from_pandas=False) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list:
    return batch.column(column).to_pylist()


def raw(batch: pa.RecordBatch, column: str = "text") -> list:
    """UTF-8 bytes of the texts, None for null."""
    return batch.column(column).cast(pa.large_binary() if pa.types.is_large_string(batch.column(column).type) else pa.binary()).to_pylist()


def id_ranges(df: DataFrame, n: int, key: str = "doc_id") -> list[int]:
    """At most n - 1 ascending cuts that deal the keys into ranges of about as many rows."""
    if n < 2:
        return []
    row = df.select(F.percentile_approx(F.col(key), [i / n for i in range(1, n)], 10_000).alias("q")).first()
    return sorted(set(row.q or []))


def in_range(key: str, cuts: list[int]) -> F.Column:
    """Number of the range of a key: how many cuts are at or below it; null keys go to range 0."""
    if not cuts:
        return F.lit(0)
    # binary search over literals: log2(cuts) comparisons a row, in generated code
    def search(lo: int, hi: int) -> F.Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) >= F.lit(cuts[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(cuts)) if len(cuts) <= 64 else F.coalesce(F.expr(_nested(key, cuts)), F.lit(0))


def _nested(key: str, cuts: list[int]) -> str:
    """Two levels of the search: blocks of 64 cuts, so that no expression is deep."""
    blocks = [cuts[i : i + 64] for i in range(0, len(cuts), 64)]
    parts = [f"(CASE WHEN {key} >= {b[0]}L THEN " + (f"aggregate(array({','.join(f'{c}L' for c in b)}), 0, (a, c) -> a + IF({key} >= c, 1, 0))" if len(b) > 1 else "1") + " ELSE 0 END)" for b in blocks]
    return " + ".join(parts)


def splitmix(x: np.ndarray) -> np.ndarray:
    """Mixes 64-bit numbers (the public splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))




_MULT = 0x9FB21C651E98DF25
_powers = _inverse = np.ones(1, np.uint64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, from prefix sums of a polynomial modulo 2^64; the multiplier is odd, so it has an inverse."""
    global _powers, _inverse
    if len(_powers) <= len(data):
        size = max(len(data) + 1, min(2 * len(_powers), 1 << 20), 1 << 16)
        _powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, np.uint64(_MULT)))))
        _inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, np.uint64(pow(_MULT, -1, 1 << 64))))))
    total = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)])))
    return splitmix((total[end] - total[start]) * _inverse[start])
