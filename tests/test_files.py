import gzip

import pytest

from seqloom.sources import fastx


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">a one\nACGT\nAC\n>b\nGG\n")
    assert [(r.name, r.seq) for r in fastx.fasta(spark, str(tmp_path / "r.fa")).orderBy("ord").collect()] == [("a", "ACGTAC"), ("b", "GG")]
    with gzip.open(tmp_path / "q.fq.gz", "wt") as f:
        f.write("@x 1\nACGT\n+\n@III\n@y\r\nAC\nGT\n+y\nII\nII\n")
    got = fastx.fastq(spark, str(tmp_path / "q.fq.gz"))
    assert [(r.name, r.seq, r.qual) for r in got.collect()] == [("x", "ACGT", "@III"), ("y", "ACGT", "IIII")]
    fastx.write_fastq(got, str(tmp_path / "out"), gzip=True)
    assert fastx.fastq(spark, str(tmp_path / "out" / "*.gz")).count() == 2


def test_bad_quality(spark, tmp_path):
    (tmp_path / "q.fq").write_text("@x\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="another length"):
        fastx.fastq(spark, str(tmp_path / "q.fq")).collect()
    assert fastx.fastq(spark, str(tmp_path / "q.fq"), strict=False).first().qual is None
