"""The commands on files, and the parts of them that no query covers."""

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from seqloom.operators import prototype, statistics
from seqloom.plans import commands
from seqloom.sources import fastx


def folder(path):
    return [line for p in sorted(path.glob("part-*")) for line in (gzip.open(p, "rt") if p.suffix == ".gz" else p.open()).read().split("\n") if line]


def fastq_of(rows):
    return "".join(f"@{n}\n{s}\n+\n{q or 'I' * len(s)}\n" for n, s, q in rows)


@pytest.fixture
def files(tmp_path):
    (tmp_path / "refs.fa").write_text(">a x>y\nAACAGGTC\n>b\nGTTTGACC\n>short\nAC\n")
    reads = [("one", "TTAACAGGTCTT", None), ("two/rc", "CCCCCCCC", None), ("both", "AACAGGTCGTTTGACC", "@" * 16), ("turned", "TTGACCTGTT", None)]
    (tmp_path / "reads.fq").write_text(fastq_of(reads))
    return tmp_path


def test_count(spark, files, capsys):
    common = ["-i", str(files / "reads.fq"), "-r", str(files / "refs.fa"), "-k", "6"]
    commands.main([*common, "-o", str(files / "counts"), "-s", str(files / "sam")])
    assert folder(files / "counts") == ["key,count", "a,3", "b,1"]
    rows = sorted(folder(files / "sam" / "rows"))
    assert [r.split("\t")[:3] for r in rows] == [["both", "0", "a"], ["both", "0", "b"], ["one", "0", "a"], ["turned", "16", "a"], ["two", "4", "*"]]
    assert rows[0].split("\t")[5:] == ["8M8H", "*", "0", "0", "AACAGGTC", "@" * 8, "NM:i:0", "NH:i:2", "MD:Z:8"]
    assert folder(files / "sam" / "header")[0].startswith("@HD") and len(folder(files / "sam" / "header")) == 3
    said = capsys.readouterr().err
    assert "Inserted 4 sequences" in said and "Finished Processing 4 reads..." in said and "Total counted assignments: 4 (100.00% of reads)" in said
    # multihits go from the counts, not from the SAM rows
    commands.main(["count", *common, "-o", str(files / "single"), "-s", str(files / "sam2"), "--exclude-multihit", "--soft-clip", "--no-sam-unmapped"])
    assert folder(files / "single") == ["key,count", "a,2", "b,0"]
    rows = sorted(folder(files / "sam2" / "rows"))
    assert [r.split("\t")[0] for r in rows] == ["both", "both", "one", "turned"] and rows[1].split("\t")[5] == "8S8M" and rows[1].split("\t")[9:11] == ["AACAGGTCGTTTGACC", "@" * 16]


def test_count_with_indels(spark, tmp_path):
    (tmp_path / "refs.fa").write_text(">a\nAACAGGTCTTGA\n")
    (tmp_path / "reads.fq").write_text(fastq_of([("del", "CAACAGGTTTGACC", None), ("ins", "AACAGGTCCTTGA", None), ("none", "AACAGGAAAAAA", None)]))
    common = ["-i", str(tmp_path / "reads.fq"), "-r", str(tmp_path / "refs.fa"), "-k", "5", "-m", "1", "--no-rc"]
    commands.main([*common, "-o", str(tmp_path / "plain")])
    assert folder(tmp_path / "plain") == ["key,count", "a,0"]
    commands.main([*common, "-o", str(tmp_path / "counts"), "-s", str(tmp_path / "sam"), "--indel"])
    assert folder(tmp_path / "counts") == ["key,count", "a,2"]
    got = {r.split("\t")[0]: r.split("\t") for r in folder(tmp_path / "sam" / "rows")}
    assert got["none"][1] == "4"
    assert got["del"][5] == "1H7M1D4M2H" and got["del"][9] == "AACAGGTTTGA" and got["del"][11:] == ["NM:i:1", "MD:Z:7^C4"]
    assert got["ins"][5] in ("7M1I5M", "8M1I4M") and got["ins"][11:] == ["NM:i:1", "MD:Z:12"]


def test_count_with_anchors(spark, tmp_path):
    (tmp_path / "refs.fa").write_text(">a\nAACAGG\n>b\nGTTTGA\n>n\nACGTNN\n")
    (tmp_path / "reads.fq").write_text(fastq_of([("hit", "CAGTCAACAGGTCCAC", None), ("bare", "AACAGGCCCC", None)]))
    common = ["-i", str(tmp_path / "reads.fq"), "-k", "4", "--no-rc", "-a", "AGTC...TCCA"]
    commands.main(["count", *common, "-r", str(tmp_path / "refs.fa"), "-o", str(tmp_path / "counts"), "-s", str(tmp_path / "sam")])
    assert folder(tmp_path / "counts") == ["key,count", "a,1", "b,0"]
    got = {r.split("\t")[0]: r.split("\t") for r in folder(tmp_path / "sam" / "rows")}
    assert got["hit"][5] == "5H6M5H" and got["hit"][-1].startswith("ZA:Z:ori=FWD") and got["bare"][1] == "4" and got["bare"][-1].startswith("ZA:Z:reason=")
    # one with another letter is left out, but its length counts
    (tmp_path / "more.fa").write_text(">a\nAACAGG\n>n\nACGTNNN\n")
    with pytest.raises(ValueError, match="one length"):
        commands.main(["count", *common, "-r", str(tmp_path / "more.fa"), "-o", str(tmp_path / "x")])


def test_cut(spark, tmp_path, capsys):
    rows = [("x", "CCAGTCGATTCCAGG", "ABCDEFGHIJKLMNO"), ("y", "GGGGGG", None), ("z", "CCTGGAATCGACTGG", "ABCDEFGHIJKLMNO"), ("w", "AAAGTCTTT", "ABCDEFGHI"), ("v", "AAAGACTAA", "ABCDEFGHI")]
    (tmp_path / "reads.fq").write_text(fastq_of(rows))
    pair = ["cut", "-i", str(tmp_path / "reads.fq"), "-a", "AGTC...TCCA", "-m", "3", "-M", "3"]
    commands.main([*pair, "-o", str(tmp_path / "out.gz"), "-c", str(tmp_path / "counts")])
    assert folder(tmp_path / "out.gz") == ["@x", "GAT", "+", "GHI", "@z", "ATC", "+", "GHI"]
    assert folder(tmp_path / "counts") == ["sequence,count", "ATC,1", "GAT,1"]
    assert "cut summary: total=5 kept=2 discarded=3 kept_revcomp=0" in capsys.readouterr().err
    commands.main(["cut", "-i", str(tmp_path / "reads.fq"), "-a", "AGTC...", "-m", "3", "-M", "3", "--check-rc", "-c", str(tmp_path / "rc")])
    # w as it is; v only turned round: TTAGTCTTT
    assert "ATT,1" not in folder(tmp_path / "rc") and "TTT,2" in folder(tmp_path / "rc")
    assert re.search(r"kept=4 discarded=1 kept_revcomp=2|kept=3 discarded=2 kept_revcomp=1", capsys.readouterr().err)
    for bad in (["cut", "-i", "x", "-a", "A...C"], [*pair[:-1], "2", "-c", "y"], ["count", "-i", "x"]):
        with pytest.raises(SystemExit):
            commands.main(bad)


def test_records_across_splits(spark, tmp_path):
    """Whatever the size of splits, also where a quality begins with an at sign."""
    rng = random.Random(2)
    rows = [(f"r{i}", s := "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 60))), "".join(rng.choice("@@+I>") for _ in s)) for i in range(300)]
    (tmp_path / "a.fq").write_text(fastq_of(rows[:200]))
    (tmp_path / "b.fq").write_text(fastq_of(rows[200:]).replace("\n", "\r\n"))
    with gzip.open(tmp_path / "c.fq.gz", "wt") as f:
        f.write(fastq_of([(f"z{n}", s, q) for n, s, q in rows[:50]]))
    want = sorted([*rows, *((f"z{n}", s, q) for n, s, q in rows[:50])])
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("97", "1000", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = fastx.fastq(spark, str(tmp_path / "*.fq*"))
            out = [tuple(r) for r in got.select("name", "seq", "qual", "read_id").collect()]
            assert sorted(r[:3] for r in out) == want and len({r[3] for r in out}) == len(want)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_references_of_both_kinds(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">a >b c\nAC\nGT\n\n>d>e\r\nGG\r\n")
    (tmp_path / "r.fq").write_text("@a b\nACGT\n+\nIIII\n@d\nGG\n+\n@@\n")
    assert [(r.name, r.seq) for r in fastx.fasta(spark, str(tmp_path / "r.fa")).orderBy("ord").collect()] == [("a", "ACGT"), ("d>e", "GG")]
    assert [(r.name, r.seq) for r in fastx.fasta(spark, str(tmp_path / "r.fq")).orderBy("ord").collect()] == [("a", "ACGT"), ("d", "GG")]


def test_alignment_statistics(spark, tmp_path):
    lines = ["@HD\tVN:1.6", "@SQ\tSN:g\tLN:4"]
    row = lambda q, flag, ref, cigar, nm, md: f"{q}\t{flag}\t{ref}\t1\t255\t{cigar}\t*\t0\t0\tACGT\tIIII\tNM:i:{nm}\tMD:Z:{md}"
    lines += [row("p", 99, "g", "4M", 0, "4"), row("p", 147, "g", "4M", 0, "4"), row("q", 0, "g", "4M", 1, "2A1"), row("q", 256, "h", "4M", 0, "4"), row("s", 2, "h", "1S4M", 0, "4"), "u\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*", row("v", 9, "g", "4M", 0, "4")]
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    table = statistics.scan(spark, str(tmp_path / "x.sam"))
    refs = spark.createDataFrame([("g", 4), ("h", 4), ("k", 4)], "name string, ref_len int")
    got = statistics.summary(table, refs).first().asDict()
    assert got == {"alignment_count": 7, "multimapped": 1, "read": 5, "unmapped_mate": 2, "not_proper_pair": 1, "exact_match": 2, "mapped": 3, "unpaired": 4, "mapped_percent": 60.0, "exact_match_percent": 100.0 * 2 / 3}
    assert {r.key: r["count"] for r in statistics.counts(table, refs).collect()} == {"g": 2, "h": 1, "k": 0}
    assert {r.key: r["count"] for r in statistics.exact_counts(table).collect()} == {"g": 3, "h": 1}
    statistics.write(statistics.summary(table, refs), "x", str(tmp_path / "stats"))
    assert folder(tmp_path / "stats")[:2] == ["Statistics,x", "alignment_count,7"]
    one = spark.sql("select '2S3M1I2D1M' c, '3^AC1' m, 'MMXXIMDM' o").select(statistics.expanded(F.col("c")), statistics.expanded_md(F.col("m")), *statistics.gap_of(F.col("o")), *statistics.gap_of(F.lit("MMM"))).first()
    assert tuple(one) == ("MMMIDDM", "MMMDDM", 3, 4, 0, 0)


def test_operations_of_a_stretch(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(80):
        ops = "M" + "".join(rng.choice("MMMID") for _ in range(rng.randrange(4, 14)))
        cigar = "".join(f"{len(m[0])}{m[0][0]}" for m in re.finditer(r"M+|I+|D+", ops))
        letters = [c if c == "D" else rng.choice("MMX") for c in ops if c != "I"]
        md = "".join(str(len(m[0])) if m[0][0] == "M" else "^" + "A" * len(m[0]) if m[0][0] == "D" else "C" * len(m[0]) for m in re.finditer("M+|D+|X+", "".join(letters)))
        md = re.sub(r"(\^A+)(?=C)", r"\g<1>0", md)
        first = rng.randrange(3)
        last = first + rng.randrange(1, 8)
        out, i, end = [], 0, last
        for c, op in enumerate(ops):
            if c > end + 1:
                break
            if op == "I":
                out.append("I")
                end += 1
            else:
                out.append(letters[i])
                i += 1
        rows.append((rng.choice(["", "2S"]) + cigar, md, first, last, "".join(out)[first:end]))
    df = spark.createDataFrame(rows, "c string, m string, a int, b int, want string")
    assert all(r.got == r.want for r in df.select("want", statistics.adjusted(F.col("c"), F.col("m"), F.col("a"), F.col("b")).alias("got")).collect())


def test_tables_of_hits(spark, tmp_path):
    raw = spark.createDataFrame([("a", "AACAGGTCTTGA", 0), ("b", "GTTTGACCAAAC", 1), ("c", "CCCCCCCCCCCC", 2)], "name string, seq string, ord long")
    reads = spark.createDataFrame([(0, "x", "TTAACAGGTCTTGAC"), (1, "y", "TCAAGACCTGTT"), (2, "z", "GTTTGACCAAACAACAGGTCTTGA"), (3, "w", "AACAGGTCTTGG")], "read_id long, name string, seq string")
    hits = prototype.names(reads, raw)
    fastx.write_hits(prototype.counts(hits, raw), str(tmp_path / "hits"))
    assert folder(tmp_path / "hits") == ["Sequence_Name\tSequence\tRead_Count", "a\tAACAGGTCTTGA\t3", "b\tGTTTGACCAAAC\t1", "c\tCCCCCCCCCCCC\t0"]
    fastx.write_cache(prototype.cache(hits, reads, raw).orderBy("seq_id").coalesce(1), str(tmp_path / "cache"))
    assert folder(tmp_path / "cache") == ["Seq_Id,Ref_Id", "a,x;y;z", "b,z", "c,"]


def test_streaming_counts(spark, tmp_path):
    from seqloom.operators import mapping, reference_set
    from seqloom.streaming import counting

    refs = reference_set.build(spark.createDataFrame([("a", "AACAGGTC", 0), ("b", "GTTTGACC", 1)], "name string, seq string, ord long"), 4)
    opt = mapping.Options(4, 0, 1)
    rows = [(i, f"r{i}", ("AACAGGTC", "TTGTTTGACC", "CCCCCCCC")[i % 3], None) for i in range(30)]
    kind = "read_id long, name string, seq string, qual string"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counting.start(stream, refs, opt, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {r.key: r["count"] for r in counting.total(spark, str(tmp_path / "out")).collect()} == {"a": 10, "b": 10}
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
