"""Sequence functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases of one 60-bit block: four bits a base, one of which is set (A, C, G, T); any other character has none.
BLOCK = 15


def normalized(seq: Column) -> Column:
    """Upper case, U as T, anything but A, C, G, T as N."""
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGT]", "N")


def only_acgt(seq: Column) -> Column:
    return seq.rlike("^[ACGT]+$")


def reverse_complement(seq: Column) -> Column:
    """Of any sequence; what is not ACGT becomes N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"), "ACGT", "TGCA"))


def read_reverse_complement(seq: Column) -> Column:
    """As reads are turned for trimming: U counts as T, so it becomes A; other letters become N."""
    return F.reverse(F.translate(normalized(seq), "ACGT", "TGCA"))


def kmer_code(kmer: Column) -> Column:
    """Big-endian two bits a base; null if a character is ambiguous."""
    plain = F.translate(F.upper(kmer), "U", "T")
    return F.when(only_acgt(plain), F.conv(F.translate(plain, "ACGT", "0123"), 4, 10).cast("long"))


def kmer_base(code: Column, i: int, k: int) -> Column:
    """Base i (from 0) of a coded k-mer."""
    return F.substring(F.lit("ACGT"), F.shiftright(code, 2 * (k - 1 - i)).bitwiseAND(3).cast("int") + 1, F.lit(1))


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, "/rc$", "")


def is_reverse(name: Column) -> Column:
    return F.endswith(name, F.lit("/rc"))


def first_word(header: Column) -> Column:
    """Name of a record: to the first white space, 255 characters at most."""
    return F.substring(F.regexp_extract(header, r"^\S*", 0), 1, 255)


def one_hot(seq: Column, length: int) -> list[Column]:
    """The sequence's blocks of BLOCK bases, for matches()."""
    hexa = F.rpad(F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"), "ACGTN", "12480"), -(-length // BLOCK) * BLOCK, "0")
    return [F.conv(F.substring(hexa, 1 + i, BLOCK), 16, 10).cast("long") for i in range(0, length, BLOCK)]


def matches(a: list[Column], b: list[Column]) -> Column:
    """How many places have the same base."""
    return sum((F.bit_count(x.bitwiseAND(y)).cast("int") for x, y in zip(a, b)), F.lit(0))


def cigar(read_len: Column, start: Column, span: Column, soft: bool = False) -> Column:
    """Of an alignment without gaps."""
    clip = "S" if soft else "H"
    left, right = start, read_len - start - span
    part = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit(clip))).otherwise("")
    return F.concat(part(left), span.cast("string"), F.lit("M"), part(right))


def md(read_part: Column, ref: Column) -> Column:
    """Match runs and the reference base at each mismatch, of two sequences of one length."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.length(ref)), F.struct(F.lit(0).alias("run"), F.lit("").alias("out")),
        lambda acc, i: F.when(F.substring(F.upper(read_part), i, F.lit(1)) == F.substring(ref, i, F.lit(1)), F.struct((acc["run"] + 1).alias("run"), acc["out"].alias("out")))
        .otherwise(F.struct(F.lit(0).alias("run"), F.concat(acc["out"], acc["run"].cast("string"), F.substring(ref, i, F.lit(1))).alias("out"))),
        lambda acc: F.concat(acc["out"], acc["run"].cast("string")),
    )
    return step
