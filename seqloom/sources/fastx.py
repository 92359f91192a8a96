"""FASTA and FASTQ files (plain or .gz) as DataFrames, and writers of FASTQ, counts, SAM and tables of hits.

Files are read by Spark's text source, so any store that Spark reads will do. The source is told that a line ends before each `>` or `@` that
begins a line; so a row is a record, and a plain file is split among as many tasks as its size asks for (a gzip file can't be split and is one
task). A `@` may also begin a line of qualities. Its record then comes in several rows; rows are put together until there are as many qualities as
bases. Only where a split of a file falls into such a record do its parts meet in no task; these few parts are found by a second pass and
joined by file and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import dna


class BadQuality(ValueError):
    """A record whose quality has another length than its sequence."""


def mark(spark: SparkSession, path: str) -> str:
    """What records begin with: `>` or `@`, by the first line that isn't empty."""
    first = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1).alias("c")).head(1)
    return ">" if first and first[0].c == ">" else "@"


def parse(record: str) -> tuple[str, str, str | None, bool]:
    """Header, sequence, quality (None if there is none) and whether the quality is complete, of a record without its first character."""
    lines = record.replace("\r", "").split("\n")
    seq, i = [], 1
    while i < len(lines) and not lines[i].startswith("+"):
        seq.append("".join(lines[i].split()))
        i += 1
    s = "".join(seq)
    if i == len(lines):
        return lines[0], s, None, False
    qual = "".join(lines[i + 1 :])
    return lines[0], s, qual, len(qual) >= len(s)


def records(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, qual (null if there is none) and ord, ascending in order of the files, of every record."""
    sign = mark(spark, path)
    rows = spark.read.option("lineSep", "\n" + sign).text(path).withColumn("ord", F.monotonically_increasing_id())
    rows = rows.select("value", "ord", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    if sign == ">":
        rows = rows.where(F.regexp_replace("value", r"\s", "") != "")
        value = F.when(F.startswith("value", F.lit(">")) & (F.col("begin") == 0), F.substring("value", F.lit(2), F.length("value"))).otherwise(F.col("value"))
        value = F.regexp_replace(value, r"^\s*>", "")
        head, body = F.regexp_extract(value, r"^([^\r\n]*)", 1), F.regexp_replace(F.regexp_replace(value, r"^[^\r\n]*", ""), r"\s", "")
        return rows.select(dna.first_word(head).alias("name"), body.alias("seq"), F.lit(None).cast("string").alias("qual"), "ord")

    def run(batches):
        import pyarrow as pa

        key, text, number, fresh = None, None, 0, False
        for batch in batches:
            out: list = []

            def close():
                """The record that was being put together; cut off by the end of its part of the file, it is a fragment."""
                nonlocal text
                if text is not None:
                    head, seq, qual, whole = parse(text)
                    out.append((head, seq, qual, number, None, None, None) if whole else (None, None, None, number, key[0], key[1], text))
                text = None

            for value, order, file, begin in zip(*(batch.column(c).to_pylist() for c in ("value", "ord", "file", "begin"))):
                if (file, begin) != key:
                    close()
                    key, fresh = (file, begin), True
                    value = value.lstrip("\r\n").removeprefix("@") if begin == 0 else value
                if text is not None and not parse(text)[3]:
                    text += "\n@" + value
                    continue
                close()
                first, fresh = fresh, False
                if first and begin and parse(value)[2] is None:  # what is left of a record that began in the part before
                    out.append((None, None, None, order, file, begin, value))
                    continue
                if not value.strip():
                    continue
                text, number = value, order
                if parse(value)[3]:
                    close()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
        out = []
        if text is not None:
            head, seq, qual, whole = parse(text)
            out.append((head, seq, qual, number, None, None, None) if whole else (None, None, None, number, key[0], key[1], text))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    import pyarrow as pa

    names, types = ["name", "seq", "qual", "ord", "file", "begin", "part"], [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    found = rows.mapInArrow(run, "name string, seq string, qual string, ord long, file string, begin long, part string")

    def join(key, part):
        """Fragments of one file, in order: each that has a header, with those after it until its quality is complete."""
        import pandas as pd

        out, text, number = [], None, 0
        for order, value in part.sort_values(["begin", "ord"])[["ord", "part"]].itertuples(index=False):
            if text is not None and not parse(text)[3]:
                text += "\n@" + value
            else:
                if text is not None:
                    out.append((*parse(text)[:3], number))
                text, number = value, order
        out.append((*parse(text)[:3], number))
        return pd.DataFrame(out, columns=["name", "seq", "qual", "ord"])

    whole = found.where(F.col("part").isNull()).select("name", "seq", "qual", "ord")
    if all(f.endswith(".gz") for f in rows.inputFiles()):  # never split
        return whole.withColumn("name", dna.first_word(F.col("name")))
    cut = found.where(F.col("part").isNotNull()).groupBy("file").applyInPandas(join, "name string, seq string, qual string, ord long")  # at most a few for each split of a file
    return whole.unionByName(cut).withColumn("name", dna.first_word(F.col("name")))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, seq, ord (order in the file) of every record of FASTA or FASTQ references; sequence lines are joined."""
    return records(spark, path).select("name", "seq", "ord")


def fastq(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """read_id, name, seq, qual of every record. strict: a quality of another length stops the query, else qual is null."""
    out = records(spark, path).select(F.col("ord").alias("read_id"), "name", "seq", "qual")
    bad = F.col("qual").isNotNull() & (F.length("qual") != F.length("seq"))
    if strict:
        return out.withColumn("qual", F.when(bad, F.raise_error(F.lit("a quality has another length than its sequence"))).otherwise(F.col("qual")))
    return out.withColumn("qual", F.when(~bad, F.col("qual")))


def write_fastq(reads: DataFrame, path: str, gzip: bool = False) -> None:
    """name, seq, qual as four lines each."""
    line = F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"))
    reads.select(line.alias("value")).write.option("compression", "gzip" if gzip else "none").text(path)


def write_counts(counted: DataFrame, path: str) -> None:
    """A single CSV with a header; rows must be ordered already. Counts have a row for each reference, so one file holds them."""
    counted.coalesce(1).write.option("header", True).csv(path)


def write_hits(counted: DataFrame, path: str) -> None:
    """Tab-separated name, sequence and number of reads of each reference (prototype.counts), largest number first."""
    rows = counted.orderBy(F.desc("count"), "key")
    rows.select(F.col("key").alias("Sequence_Name"), F.col("ref").alias("Sequence"), F.col("count").alias("Read_Count")).coalesce(1).write.option("header", True).option("sep", "\t").csv(path)


def write_cache(rows: DataFrame, path: str) -> None:
    """CSV of each reference and its reads (prototype.cache)."""
    rows.select(F.col("seq_id").alias("Seq_Id"), F.col("ref_id").alias("Ref_Id")).write.option("header", True).option("emptyValue", "").csv(path)


def write_sam(header: DataFrame, rows: DataFrame, path: str) -> None:
    """Folders `header` and `rows` of text; concatenated they are a SAM file. Row order is free, as the header says."""
    header.coalesce(1).select("line").write.text(f"{path}/header")
    rows.select("line").write.text(f"{path}/rows")
