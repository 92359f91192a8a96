"""SAM text of alignments: header, mapped and unmapped rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import dna

VERSION = "@HD\tVN:1.6\tSO:unknown"


def header(refs: DataFrame) -> DataFrame:
    """sn, ln, ref: a row for each base name, the length of its first sequence in string order; sort by ref for output."""
    name = dna.base_name(F.col("name"))
    return refs.groupBy(name.alias("sn")).agg(F.min_by("ref_len", "ref").alias("ln"), F.min("ref").alias("ref"))


def header_lines(refs: DataFrame) -> DataFrame:
    """line: the header in order."""
    rows = header(refs).select(F.lit(1).alias("o"), "ref", F.format_string("@SQ\tSN:%s\tLN:%d", "sn", "ln").alias("line"))
    top = refs.sparkSession.createDataFrame([(0, "", VERSION)], "o int, ref string, line string")
    return top.union(rows).orderBy("o", "ref").select("line")


def runs(ops: Column) -> Column:
    """Operations as numbers of equal ones: MMMIM is 3M1I1M."""
    return F.array_join(F.transform(F.regexp_extract_all(ops, F.lit("(M+|I+|D+)"), 1), lambda x: F.concat(F.length(x).cast("string"), F.substring(x, 1, 1))), "")


def gapped_md(part: Column, ref: Column, ops: Column) -> Column:
    """MD of operations: match runs, the reference base at each mismatch, deleted bases after ^ (adjacent ones after one)."""
    start = F.struct(F.lit(0).alias("run"), F.lit("").alias("out"), F.lit(0).alias("i"), F.lit(0).alias("q"), F.lit(False).alias("gap"))

    def step(acc, op):
        base = F.substring(ref, acc["i"] + 1, F.lit(1))
        same = F.substring(F.upper(part), acc["q"] + 1, F.lit(1)) == base
        made = lambda run, out, i, q, gap: F.struct(run.alias("run"), out.alias("out"), (acc["i"] + i).alias("i"), (acc["q"] + q).alias("q"), F.lit(gap).alias("gap"))
        zero, shown = F.lit(0), F.concat(acc["out"], acc["run"].cast("string"))
        return (
            F.when(op == "I", F.struct(acc["run"].alias("run"), acc["out"].alias("out"), acc["i"].alias("i"), (acc["q"] + 1).alias("q"), acc["gap"].alias("gap")))
            .when((op == "D") & acc["gap"], made(zero, F.concat(acc["out"], base), 1, 0, True)).when(op == "D", made(zero, F.concat(shown, F.lit("^"), base), 1, 0, True))
            .when(same, made(acc["run"] + 1, acc["out"], 1, 1, False)).otherwise(made(zero, F.concat(shown, base), 1, 1, False))
        )

    return F.aggregate(F.split(ops, ""), start, step, lambda acc: F.concat(acc["out"], acc["run"].cast("string")))


def mapped(alignments: DataFrame, reads: DataFrame | None = None, soft: bool = False, tag: Column | None = None) -> DataFrame:
    """read_id, pos, line of alignments (with nh).

    Alignments that carry their read's name, sequence and quality (mapping.CARRIED; all of them with soft) need no reads; others are joined to
    reads (read_id, name, seq, qual).
    """
    df = alignments.withColumnRenamed("name", "ref_name")
    if "span" not in df.columns:
        df = df.withColumns({"span": F.col("ref_len"), "ops": F.lit(None).cast("string")})
    n = F.col("read_len")
    if "read_name" not in df.columns:
        df = df.drop("read_len").join(reads.select("read_id", F.col("name").alias("read_name"), "seq", "qual"), "read_id")
        n = F.length("seq")
        part = lambda c: F.substring(c, F.lit(1), n) if soft else F.substring(c, F.col("pos") + 1, F.col("span"))
        df = df.withColumns({"seq_part": part(F.col("seq")), "qual_part": F.when(F.length("qual") >= n, part(F.col("qual")))})
    own = F.substring("seq_part", F.col("pos") + 1, F.col("span")) if soft else F.col("seq_part")
    clip = F.lit("S" if soft else "H")
    cut = lambda size: F.when(size > 0, F.concat(size.cast("string"), clip)).otherwise("")
    cigar = F.concat(cut(F.col("pos")), runs(F.col("ops")), cut(n - F.col("pos") - F.col("span")))
    plain = F.col("ops").isNull()
    fields = [
        dna.base_name(F.col("read_name")), F.when(dna.is_reverse(F.col("ref_name")), "16").otherwise("0"), dna.base_name(F.col("ref_name")), F.lit("1"), F.lit("255"),
        F.when(plain, dna.cigar(n, F.col("pos"), F.col("span"), soft)).otherwise(cigar), F.lit("*"), F.lit("0"), F.lit("0"), F.col("seq_part"),
        F.coalesce("qual_part", F.lit("*")), F.concat(F.lit("NM:i:"), F.col("ed").cast("string")),
        F.when(F.col("nh") > 1, F.concat(F.lit("NH:i:"), F.col("nh").cast("string"))),
        F.concat(F.lit("MD:Z:"), F.when(plain, dna.md(own, F.col("ref"))).otherwise(gapped_md(own, F.col("ref"), F.col("ops")))),
    ]
    return df.select("read_id", "pos", F.concat_ws("\t", *fields, *([tag] if tag is not None else [])).alias("line"))


def unmapped(reads: DataFrame, names: DataFrame | None = None, tag: Column | None = None) -> DataFrame:
    """read_id, line of the reads without a hit in names; of all given reads if there is no names (see mapping.missed)."""
    rest = reads if names is None else reads.join(names.select("read_id").distinct(), "read_id", "left_anti")
    qual = F.when(F.length("qual") == F.length("seq"), F.col("qual")).otherwise("*")
    fields = [dna.base_name(F.col("name")), *map(F.lit, ("4", "*", "0", "0", "*", "*", "0", "0")), F.col("seq"), qual]
    return rest.select("read_id", F.concat_ws("\t", *fields, *([tag] if tag is not None else [])).alias("line"))
