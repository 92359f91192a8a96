"""Alignment tables: a scan of SAM rows, and the statistics and counts of their primary rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of the FLAG field.
PROPER, UNMAPPED, MATE_UNMAPPED, SECONDARY, SUPPLEMENTARY = 0x2, 0x4, 0x8, 0x100, 0x800


def fields(line: Column) -> list[Column]:
    """qname, flag, rname, pos, cigar, nm, md of a SAM row."""
    part = F.split(line, "\t")
    tag = lambda name, kind: F.regexp_extract(line, rf"\t{name}:{kind}:([^\t]*)", 1)
    return [
        F.get(part, F.lit(0)).alias("qname"), F.get(part, F.lit(1)).cast("int").alias("flag"), F.get(part, F.lit(2)).alias("rname"), F.get(part, F.lit(3)).cast("long").alias("pos"),
        F.get(part, F.lit(5)).alias("cigar"), F.nullif(tag("NM", "i"), F.lit("")).cast("int").alias("nm"), F.nullif(tag("MD", "Z"), F.lit("")).alias("md"),
    ]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The rows of SAM text files, header lines left out, with ord, their order in the files."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where(~F.startswith("value", F.lit("@")) & (F.col("value") != ""))
    return lines.select(*fields(F.col("value")), "ord")


def is_set(bits: int) -> Column:
    return F.col("flag").bitwiseAND(bits) != 0


def primary(alignments: DataFrame) -> DataFrame:
    """Without secondary and supplementary rows."""
    return alignments.where(~is_set(SECONDARY | SUPPLEMENTARY))


def expanded(cigar: Column) -> Column:
    """A letter for each base of a CIGAR, clips left out: 2M1I is MMI."""
    runs = F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNP=X])"), 1)
    return F.array_join(F.transform(runs, lambda x: F.repeat(F.substring(x, -1, 1), F.regexp_extract(x, "^[0-9]+", 0).cast("int"))), "")


def expanded_md(md: Column) -> Column:
    """A letter for each reference base of an MD text: M for a match, X for another base, D for a deleted one."""
    items = F.regexp_extract_all(md, F.lit(r"([0-9]+|\^[A-Z]+|[A-Z])"), 1)
    one = lambda x: F.when(x.rlike("^[0-9]"), F.repeat(F.lit("M"), x.cast("int"))).when(F.startswith(x, F.lit("^")), F.repeat(F.lit("D"), F.length(x) - 1)).otherwise("X")
    return F.array_join(F.transform(items, one), "")


def adjusted(cigar: Column, md: Column, first: Column, last: Column) -> Column:
    """The operations of a stretch of the reference, from base first (0: where the alignment starts) to before last: an I for each insertion, else the MD letter.

    Insertions in the stretch, or up to a base after it, lengthen it by one each.
    """
    start = F.struct(F.lit(0).alias("c"), last.cast("int").alias("end"), F.lit("").alias("out"), F.lit(0).alias("i"))
    letters = expanded_md(md)

    def step(acc, op):
        inside, insert = (acc["c"] <= acc["end"] + 1) & (op != ""), op == "I"
        one = F.when(insert, F.lit("I")).otherwise(F.substring(letters, acc["i"] + 1, F.lit(1)))
        more = F.struct((acc["c"] + 1).alias("c"), (acc["end"] + insert.cast("int")).alias("end"), F.concat(acc["out"], one).alias("out"), (acc["i"] + (~insert).cast("int")).alias("i"))
        return F.when(inside, more).otherwise(F.struct((acc["end"] + 2).alias("c"), acc["end"].alias("end"), acc["out"].alias("out"), acc["i"].alias("i")))

    return F.aggregate(F.split(expanded(cigar), ""), start, step, lambda acc: F.substring(acc["out"], first.cast("int") + 1, F.greatest(acc["end"] - first.cast("int"), F.lit(0))))


def gap_of(operations: Column) -> list[Column]:
    """max_gap and total of expanded operations: the longest run of edits that a match ends (1 at least if there is any edit, else 0), and the edits."""
    total = F.length(F.regexp_replace(operations, "M", ""))
    longest = F.array_max(F.transform(F.regexp_extract_all(operations, F.lit("([^M]+)M"), 1), F.length))
    return [F.when(total == 0, 0).otherwise(F.greatest(F.lit(1), F.coalesce(longest, F.lit(1)))).cast("int").alias("max_gap"), total.cast("int").alias("total")]


def _firsts(alignments: DataFrame) -> DataFrame:
    """Primary rows with n, their number among those of a read; the second row of a pair does not count, nor every other one after it."""
    return primary(alignments).withColumn("n", F.row_number().over(Window.partitionBy("qname").orderBy("ord"))).where("n % 2 = 1")


def _mapped() -> Column:
    return ~is_set(UNMAPPED | MATE_UNMAPPED)


def summary(alignments: DataFrame, refs: DataFrame) -> DataFrame:
    """One row of statistics of alignments (see fields, and ord). refs: name, ref_len.

    Reads with an unmapped mate and unmapped reads count as unmapped_mate. exact_match: the whole reference is one match run without a mismatch.
    """
    sizes = refs.select(F.col("name").alias("rname"), "ref_len").dropDuplicates(["rname"])
    rows = _firsts(alignments).join(sizes, "rname", "left")
    exact = F.array_contains(F.regexp_extract_all("cigar", F.lit("([0-9]+M)"), 1), F.concat(F.col("ref_len").cast("string"), F.lit("M"))) & (F.col("md") == F.col("ref_len").cast("string"))
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    read = rows.agg(
        F.count(F.lit(1)).alias("read"), count(~_mapped(), "unmapped_mate"), count(_mapped() & ~is_set(PROPER), "not_proper_pair"), count(_mapped() & exact, "exact_match"),
    )
    every = alignments.agg(F.count(F.lit(1)).alias("alignment_count"), count(is_set(SECONDARY | SUPPLEMENTARY), "multimapped"))
    odd = primary(alignments).groupBy("qname").agg((F.count(F.lit(1)) % 2).alias("odd")).agg(F.coalesce(F.sum("odd"), F.lit(0)).cast("long").alias("unpaired"))
    out = read.join(every).join(odd).withColumn("mapped", F.col("read") - F.col("unmapped_mate"))
    share = lambda a, b, name: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b)).otherwise(0.0).alias(name)
    return out.select("alignment_count", "multimapped", "read", "unmapped_mate", "not_proper_pair", "exact_match", "mapped", "unpaired", share("mapped", "read", "mapped_percent"), share("exact_match", "mapped", "exact_match_percent"))


def counts(alignments: DataFrame, refs: DataFrame) -> DataFrame:
    """key, count: reads whose first primary row is mapped to each reference, zeros kept."""
    own = _firsts(alignments).where(_mapped()).groupBy(F.col("rname").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return refs.select(F.col("name").alias("key")).distinct().join(own, "key", "left").select("key", F.coalesce("n", F.lit(0).cast("long")).alias("count"))


def exact_counts(alignments: DataFrame) -> DataFrame:
    """key, count: primary mapped rows without an edit by reference."""
    return primary(alignments).where((F.col("nm") == 0) & ~is_set(UNMAPPED)).groupBy(F.col("rname").alias("key")).agg(F.count(F.lit(1)).alias("count"))


def write(stats: DataFrame, sample: str, path: str) -> None:
    """A CSV of name and value of each statistic, headed by the sample's name."""
    row = stats.first().asDict()
    stats.sparkSession.createDataFrame([(k, str(v)) for k, v in row.items()], f"Statistics string, `{sample}` string").coalesce(1).write.option("header", True).csv(path)
