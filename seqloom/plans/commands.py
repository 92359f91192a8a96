"""The two commands, count and cut; without a command, count. Outputs are folders that Spark writes."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqloom.operators import anchored, anchors, mapping, reference_set, sam
from seqloom.sources import fastx
from seqloom.sources.shipping import ship


def positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("must be a positive integer")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqloom")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("count", help="count reads of each reference")
    c.add_argument("-i", "--input", required=True, help="FASTQ or FASTA reads, .gz too")
    c.add_argument("-r", "--reference", required=True, help="FASTA or FASTQ references")
    c.add_argument("-o", "--output", default="counts.csv")
    c.add_argument("-s", "--sam")
    c.add_argument("--soft-clip", action="store_true")
    c.add_argument("--no-sam-unmapped", action="store_true")
    c.add_argument("-k", "--kmer", type=int, default=8)
    c.add_argument("--seed-mm", type=int, default=0, choices=(0, 1))
    c.add_argument("--indel", action="store_true", help="insertions and deletions count as edits too")
    c.add_argument("--exclude-multihit", action="store_true")
    c.add_argument("--no-rc", action="store_true")
    c.add_argument("-a", "--anchors", help="A...B, A... or ...B")
    c.add_argument("--anchor-error", type=int, default=0, choices=range(6))
    c.add_argument("-m", "--mismatch", type=int)
    c.add_argument("-d", "--dup-policy", default="error", choices=reference_set.POLICIES)
    t = sub.add_parser("cut", help="trim reads to the part between anchors")
    t.add_argument("-i", "--input", required=True)
    t.add_argument("-o", "--output", help="FASTQ; compressed if it ends with .gz")
    t.add_argument("-c", "--count", help="CSV of the inserts' counts")
    t.add_argument("-a", "--anchors", required=True)
    t.add_argument("--anchor-error", type=int, default=0, choices=range(6))
    t.add_argument("-m", "--min", type=positive, default=1)
    t.add_argument("-M", "--max", type=positive, default=1 << 31)
    t.add_argument("--check-rc", action="store_true")
    for p in (c, t):
        p.add_argument("-t", "--threads", help="has no effect: the session decides")
        p.add_argument("-v", action="count", default=0)
    return top


def main(argv: list[str] | None = None) -> None:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0].startswith("-") and argv[0] not in ("-h", "--help"):
        argv = ["count", *argv]
    top = parser()
    a = top.parse_args(argv)
    spark = ship(SparkSession.builder.getOrCreate())
    if a.command == "cut":
        if not a.output and not a.count:
            top.error("cut needs -o and/or -c")
        if a.min > a.max:
            top.error("--min must not be above --max")
        return cut(a, spark)
    return count(a, spark)


def say(text: str) -> None:
    print(text, file=sys.stderr)


def cut(a: argparse.Namespace, spark: SparkSession) -> None:
    reads = fastx.fastq(spark, a.input, strict=False)
    trimmed = anchors.cut(reads, anchors.Anchors.parse(a.anchors, max_error=a.anchor_error, min_len=a.min, max_len=a.max), a.check_rc)
    if a.output:
        fastx.write_fastq(trimmed, a.output, a.output.endswith(".gz"))
    if a.count:
        fastx.write_counts(anchors.insert_counts(trimmed).orderBy(F.desc("count"), "sequence"), a.count)
    s = anchors.cut_stats(reads, trimmed).first()
    say(f"cut summary: total={s.total} kept={s.kept} discarded={s.discarded} kept_revcomp={s.kept_revcomp}")


def count(a: argparse.Namespace, spark: SparkSession) -> None:
    opt = mapping.Options(a.kmer, a.seed_mm, a.mismatch, a.exclude_multihit, a.indel)
    raw = fastx.fasta(spark, a.reference)
    refs = reference_set.build(raw, a.kmer, not a.no_rc, a.dup_policy)
    reads = fastx.fastq(spark, a.input)
    say(f"Inserted {refs.count()} sequences (forward & reverse count)")
    if a.anchors:
        found = anchored.mapped(reads, refs, anchors.Anchors.parse(a.anchors, max_error=a.anchor_error), opt, reference_set.lengths(raw, a.kmer))
        names = found.names
    else:
        best = mapping.collapsed(mapping.mapped(reads, refs, opt, ("all" if a.soft_clip else "part") if a.sam else ""), opt.max_mm)
        names = mapping.hit_names(best, opt.exclude_multihit)
    fastx.write_counts(mapping.ordered(mapping.counts(names, refs)), a.output)
    s = mapping.summary(names, reads.agg(F.count(F.lit(1)).alias("n_reads"))).first()
    say(f"Finished Processing {s.n_reads} reads...")
    say(f"Total counted assignments: {s.assignments} ({s.percent:.2f}% of reads)")
    if not a.sam:
        return
    # reads with several references stay in the SAM rows, whatever the counts leave out
    if a.anchors:
        rows = sam.mapped(mapping.with_nh(found.alignments), reads, a.soft_clip, F.col("tag"))
        rest = sam.unmapped(reads.join(found.tagged, "read_id"), found.alignments, F.col("tag"))
    else:
        rows = sam.mapped(mapping.with_nh(best), soft=a.soft_clip)
        rest = sam.unmapped(mapping.missed(reads, refs, opt))
    rows = rows.select("line")
    fastx.write_sam(sam.header_lines(refs), rows if a.no_sam_unmapped else rows.unionByName(rest.select("line")), a.sam)


if __name__ == "__main__":
    main()
