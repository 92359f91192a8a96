import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import dna
from seqloom.operators import anchored, anchors, indels, mapping, reference_set, sam


def reads_of(spark, rows):
    return spark.createDataFrame([(i, f"read{i}", *((r, None) if isinstance(r, str) else r)) for i, r in enumerate(rows)], "read_id long, name string, seq string, qual string")


def refs_of(spark, rows, **more):
    return reference_set.build(spark.createDataFrame([(n, s, i) for i, (n, s) in enumerate(rows)], "name string, seq string, ord long"), **{"k": 4, **more})


def test_functions(spark):
    row = spark.sql("select 'acguX' s, 'ACGT' k").select(dna.normalized(F.col("s")), dna.reverse_complement(F.col("s")), dna.kmer_code(F.col("k")), dna.kmer_base(dna.kmer_code(F.col("k")), 2, 4), dna.kmer_code(F.lit("ACNT"))).first()
    assert tuple(row) == ("ACGTN", "NNCGT", 27, "G", None)


def test_reference_set(spark):
    refs = refs_of(spark, [("a", "ACGGA"), ("b", "acgga"), ("c", "ACGNA"), ("d", "ACG"), ("p", "ACGT")])
    assert {(r.name, r.ref) for r in refs.collect()} == {("a", "ACGGA"), ("a/rc", "TCCGT"), ("p", "ACGT")}
    with pytest.raises(reference_set.DuplicateReference):
        refs_of(spark, [("p", "ACGT")], policy="error")
    assert {(r.sn, r.ln) for r in sam.header(refs).collect()} == {("a", 5), ("p", 4)}


def test_seed_hits(spark):
    refs = refs_of(spark, [("x", "ACGT")], add_rc=False)
    for seq, mm, want in (("AACGTAA", 0, [1]), ("AACCTAA", 0, []), ("AACCTAA", 1, [1])):
        seeds = mapping.seed_table(refs, mapping.Options(4, mm))
        assert [r.pos for r in mapping.seed_hits(reads_of(spark, [seq]), seeds, 4, 4).collect()] == want


def test_sam_rows(spark):
    refs = spark.createDataFrame([("ref1/rc", "ACGT", 4, True, 0)], "name string, ref string, ref_len int, is_rc boolean, ord long")
    reads = reads_of(spark, [("TTACCTAA", "HHHXHHHH")])
    found = mapping.with_nh(mapping.mapped(reads, refs, mapping.Options(4, 1, 1)).where("pos = 2"))
    hard = sam.mapped(found, reads).first().line.split("\t")
    assert hard == ["read0", "16", "ref1", "1", "255", "2H4M2H", "*", "0", "0", "ACCT", "HXHH", "NM:i:1", "MD:Z:2G1"]
    soft = sam.mapped(found, reads, soft=True).first().line.split("\t")
    assert soft[5] == "2S4M2S" and soft[9:11] == ["TTACCTAA", "HHHXHHHH"]


def test_multihit_nh(spark):
    refs = refs_of(spark, [("r1", "ACGT"), ("r2", "CGTA")], add_rc=False)
    reads = reads_of(spark, ["ACGTA"])
    rows = sam.mapped(mapping.with_nh(mapping.mapped(reads, refs, mapping.Options(4))), reads).orderBy("pos").collect()
    assert [r.line.split("\t")[5] for r in rows] == ["4M1H", "1H4M"] and all("NH:i:2" in r.line for r in rows)


def brute_best(seq, refs, k, seed_mm, m):
    """Best reference for each start, by trying every reference there."""
    out = {}
    for pos in range(len(seq)):
        found = []
        for name, ref in refs:
            w = seq[pos : pos + len(ref)]
            if len(w) < len(ref):
                continue
            off = [i for i in range(k) if w[i] != ref[i]]
            ed = sum(a != b for a, b in zip(w, ref))
            if len(off) <= seed_mm and ed <= m:
                found.append((off[0] * 4 + "ACGT".index(ref[off[0]]) + 1 if off else 0, ed, len(ref), name))
        if found:
            out[pos] = min(found)[3]
    return out


@pytest.mark.parametrize("seed_mm,m", [(0, 0), (0, 2), (1, 2)])
def test_best_per_start_against_brute_force(spark, seed_mm, m):
    rng = random.Random(seed_mm * 10 + m)
    refs = [(f"r{i}", "".join(rng.choice("ACGT") for _ in range(8))) for i in range(12)]
    seqs = ["".join(rng.choice([rng.choice("ACGT"), *refs[rng.randrange(12)][1]]) for _ in range(60)) + refs[j % 12][1] for j in range(12)]
    found = mapping.mapped(reads_of(spark, seqs), refs_of(spark, refs, add_rc=False), mapping.Options(4, seed_mm, m)).collect()
    got = {}
    for r in found:
        got.setdefault(r.read_id, {})[r.pos] = r.name
    assert got == {i: b for i, s in enumerate(seqs) if (b := brute_best(s, refs, 4, seed_mm, m))}


def test_nearby_collapse(spark):
    rows = [(0, p, "r", ed, 50, "ACGT", 4, False, "") for p, ed in ((5, 2), (7, 1), (9, 1), (30, 0))]
    best = spark.createDataFrame(rows, "read_id long, pos int, name string, ed int, read_len int, ref string, ref_len int, is_rc boolean, window string")
    assert [(r.pos, r.ed) for r in mapping.collapsed(best, 3).orderBy("pos").collect()] == [(7, 1), (30, 0)]


def test_counts(spark):
    refs = refs_of(spark, [("a", "AAAAC"), ("b", "GGGGC")])
    reads = reads_of(spark, ["TAAAACT", "AGTTTTG", "CCCCC", (None, None)])
    names = mapping.hit_names(mapping.mapped(reads, refs, mapping.Options(4)))
    assert [tuple(r) for r in mapping.ordered(mapping.counts(names, refs)).collect()] == [("a", 2), ("b", 0)]  # the second read holds the reverse complement


def test_indels():
    assert indels.align("ACGTACGT", "ACGTACGT", 4, 2)[:3] == (0, 0, 8)
    assert indels.align("ACGTAGTA", "ACGTACGTA", 4, 1) == (1, 1, 8, "MMMMMDMMM")
    assert indels.align("ACGTTTTT", "ACGTACGT", 4, 1) is None
    assert indels.md_of("MMMMMDMMM", "ACGTAGTA", "ACGTACGTA") == "5^C3" and indels.cigar_of("MMMMMDMMM", 1, 0) == "1H5M1D3M"


@pytest.mark.parametrize(
    "opt,seq,want",
    [
        (anchors.Anchors("AGTC", "TCCA", 0, 3, 3), "CCAGTCGATTCCAGG", ("FWD", 6, 3, 2, 6, 0, 9, 13, 0)),
        (anchors.Anchors("AGTC", "TCCA", 0, 3, 3), "AATGGACATGACTCC", ("RC", 6, 3, 9, 13, 0, 2, 6, 0)),
        (anchors.Anchors("AGTC", "TCCA", 0, 3, 3), "AGTCAAAGTCTCCA", None),
        (anchors.Anchors("AGTC", "", 0, 4, 4), "TTAGTCGGGG", ("FWD", 6, 4)),
        (anchors.Anchors("", "TCCA", 0, 4, 4), "AAAAGGGGTCCAAA", ("FWD", 4, 4)),
        (anchors.Anchors("AAAA", "TTTT", 1, 3, 3), "AAATAAAAGGGTTTT", ("FWD", 8, 3)),
    ],
)
def test_anchor_windows(opt, seq, want):
    best = anchors.extract(seq, opt)
    assert (best is None) == (want is None)
    if want:
        assert tuple(anchors.as_row(best))[: len(want)] == want


def test_anchor_errors_and_options():
    a5, a3, guide = "ATTTTCAATTTAACGTCG", "GTTTTAGAGCTAGAAATA", "TCCGATGCAGGCTCCAGAGG"
    seq = "CC" + a5[:5] + "A" + a5[6:] + guide + a3
    assert anchors.extract(seq, anchors.Anchors(a5, a3, 0, 20, 20)) is None
    best = anchors.extract(seq, anchors.Anchors(a5, a3, 1, 20, 20))
    assert seq[best[3] : best[3] + best[2]] == guide
    assert anchors.za_tag(seq, best, anchors.Anchors(a5, a3, 1, 20, 20)).startswith("ZA:Z:ori=FWD;ins=21,20;ast=5:pass,3:pass;a5=3-20,ed=1,md=5C12;a3=41-58,ed=0,md=18")
    assert anchors.Anchors.parse("AC...").a3 == "" and anchors.Anchors.parse("...AC").a5 == ""
    with pytest.raises(ValueError):
        anchors.Anchors.parse("AC")


def test_cut(spark):
    reads = reads_of(spark, [("CCAGTCGATTCCAGG", "I" * 15), ("GGGG", "IIII"), ("CCAGTCGATTCCAGG", None)])
    trimmed = anchors.cut(reads, anchors.Anchors("AGTC", "TCCA", 0, 3, 3))
    assert [(r.read_id, r.seq, r.qual) for r in trimmed.collect()] == [(0, "GAT", "III")]
    assert tuple(anchors.cut_stats(reads, trimmed).first()) == (3, 1, 2, 0)


@pytest.mark.parametrize(
    "opt,seq,want",
    [
        (anchors.Anchors("AGTC", "TCCA", 0, 3, 3), "AAAGTCGGGGTCCAA", "ZA:Z:ori=FWD;ins=7,4;exp=3;reason=insert_len_gt;ast=5:pass,3:pass;a5=3-6,ed=0,md=4;a3=11-14,ed=0,md=4"),
        (anchors.Anchors("AGTC", "TCCA", 0, 3, 3), "AAAGTCGGGGTCGA", "ZA:Z:ori=FWD;partial=1;ast=5:pass,3:fail;a5=3-6,ed=0,md=4;a3f=11-14,len=4,ed=1,md=2C1"),
        (anchors.Anchors("AGTC", "TCCA", 0, 3, 3), "TGGATTTTTT", "ZA:Z:ori=RC;partial=1;ast=5:fail,3:pass;a3rc=1-4,ed=0,md=4;a5f=3-6,len=4,ed=1,md=2C1"),
        (anchors.Anchors("AGTC", "TCCA", 0, 3, 3), "CCAGCCGG", "ZA:Z:reason=anchor_not_found;ast=5:fail,3:na;a5f=3-6,len=4,ed=1,md=2T1"),
        (anchors.Anchors("", "TCCA", 0, 3, 3), "", "ZA:Z:reason=anchor_not_found;ast=5:na,3:fail"),
    ],
)
def test_tags_of_reads_without_a_window(opt, seq, want):
    assert anchors.extract(seq, opt) is None and anchors.unmapped_tag(seq, opt, 3) == want


def test_counting_with_anchors(spark):
    refs = refs_of(spark, [("a", "AACAGG"), ("b", "GTTTGA")], add_rc=False)
    find = anchors.Anchors("AGTC", "TCCA")
    reads = reads_of(spark, ["CAGTCAACAGGTCCAC", "CAGTCAACAGGTCCAGTTTGA", "AACAGGCCCC", "CAGTCCCCCCCTCCA", (None, None)])
    found = anchored.mapped(reads, refs, find, mapping.Options(4))
    assert [tuple(r) for r in mapping.ordered(mapping.counts(found.names, refs)).collect()] == [("a", 2), ("b", 1)]
    lines = [r.line.split("\t") for r in sam.mapped(mapping.with_nh(found.alignments), reads, tag=F.col("tag")).orderBy("read_id").collect()]
    assert [x[5] for x in lines] == ["5H6M5H", "5H6M10H"] and lines[0][-1] == "ZA:Z:ori=FWD;ins=6,6;ast=5:pass,3:pass;a5=2-5,ed=0,md=4;a3=12-15,ed=0,md=4"
    with pytest.raises(ValueError):
        anchored.mapped(reads, refs_of(spark, [("a", "AACAGG"), ("c", "GTTTGAA")]), find, mapping.Options(4))


def brute_alignment(read, ref, k, m):
    """(edits, gaps, span, operations) of the best alignment, by trying every span with a table of its own."""
    from functools import cache

    head = sum(a != b for a, b in zip(read[:k], ref[:k]))
    best = None
    for span in range(max(k, len(ref) - m), min(len(read), len(ref) + m) + 1):
        tail, rest = read[k:span], ref[k:]

        @cache
        def cost(i, j, tail=tail, rest=rest):
            """(edits, gaps, operations) from there to the end: insertion first, then match, then deletion."""
            if i == len(rest) and j == len(tail):
                return 0, 0, ""
            found = []
            for rank, (op, di, dj) in enumerate((("I", 0, 1), ("M", 1, 1), ("D", 1, 0))):
                if i + di <= len(rest) and j + dj <= len(tail):
                    e, g, ops = cost(i + di, j + dj)
                    found.append((e + (op != "M" or tail[j] != rest[i]), g + (op != "M"), rank, op + ops))
            e, g, _, ops = min(found)
            return e, g, ops

        e, g, ops = cost(0, 0)
        key = (e + head, g, abs(span - len(ref)), span)
        if key[0] <= m and (best is None or key < best[:4]):
            best = (*key, "M" * k + ops)
    return best and (best[0], best[1], best[3], best[4])


def test_indels_against_brute_force():
    rng = random.Random(4)
    pairs = []
    for _ in range(400):
        ref = "".join(rng.choice("ACGT") for _ in range(rng.choice([5, 8, 12])))
        read = list(ref[4:])
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(read) + 1)
            read[at : at + rng.randrange(2)] = rng.choice(["", "A", "C", "GT"])
        pairs.append((ref[:4] + "".join(read) + "".join(rng.choice("ACGT") for _ in range(rng.randrange(4))), ref))
    for m in (0, 1, 3):
        got = {i: tuple(x) for i, *x in indels.align_all([a for a, _ in pairs], [b for _, b in pairs], 4, m)}
        assert got == {i: b for i, (read, ref) in enumerate(pairs) if (b := brute_alignment(read, ref, 4, m))}


@pytest.mark.parametrize("opt", [mapping.Options(4, 0, 2), mapping.Options(4, 1, 2), mapping.Options(4, 0, 2, indel=True), mapping.Options(4, 1, 1, indel=True)])
def test_large_dictionaries_give_the_same(spark, monkeypatch, opt):
    rng = random.Random(5)
    rows = [(f"r{i}", "".join(rng.choice("ACGT") for _ in range(rng.choice([7, 9])))) for i in range(9)]
    seqs = [("".join(rng.choice([rng.choice("ACGTUN"), *(r for _, r in rows)]) for _ in range(20)), None) for _ in range(20)]
    seqs = [(s.replace(rows[j % 9][1][5:], "") if j % 4 == 0 else s.lower() if j % 4 == 1 else s, "".join(rng.choice("IJK") for _ in s) if j % 3 else None) for j, (s, _) in enumerate(seqs)] + [("", ""), (None, None), ("CCCCC", "IIIII")]
    reads, refs = reads_of(spark, seqs), refs_of(spark, rows)
    small, few = mapping.mapped(reads, refs, opt, "part").collect(), mapping.missed(reads, refs, opt).collect()
    whole = sam.mapped(mapping.with_nh(mapping.mapped(reads, refs, opt, "all")), soft=True).collect()
    monkeypatch.setattr(mapping, "BROADCAST_SEEDS", 0)
    cut = lambda rows: sorted(str({k: v for k, v in r.asDict().items() if k != "window"}) for r in rows)
    assert small and few
    assert cut(small) == cut(mapping.mapped(reads, refs, opt, "part").collect())
    assert cut(few) == cut(mapping.missed(reads, refs, opt).collect())
    assert cut(whole) == cut(sam.mapped(mapping.with_nh(mapping.mapped(reads, refs, opt)), reads, soft=True).collect())


def test_mapping_with_indels_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(f"r{i}", "".join(rng.choice("ACGT") for _ in range(8))) for i in range(6)]
    seqs = ["".join(rng.choice([rng.choice("ACGT"), rows[rng.randrange(6)][1], rows[rng.randrange(6)][1][:5]]) for _ in range(20)) for _ in range(10)]
    got = {(r.read_id, r.pos): (r.name, r.ed, r.gaps, r.span, r.ops) for r in indels.mapped(reads_of(spark, seqs), refs_of(spark, rows, add_rc=False), mapping.Options(4, 0, 2)).collect()}
    want = {}
    for i, s in enumerate(seqs):
        for p in range(len(s) - 3):
            found = [(b[0], b[1], abs(b[2] - 8), b[2], n, b[3]) for n, r in rows if s[p : p + 4] == r[:4] and len(s) - p >= 6 and (b := brute_alignment(s[p : p + 10], r, 4, 2))]
            if found:
                e, g, _, span, n, ops = min(found)
                want[i, p] = (n, e, g, span, ops)
    assert got == want


def test_rows_of_indels(spark):
    refs = refs_of(spark, [("a", "ACGTAGGCATTC")], add_rc=False)
    reads = reads_of(spark, [("TTACGTAGGATTCAA", "ABCDEFGHIJKLMNO"), ("ACGTAGGCCATTC", None)])
    found = mapping.with_nh(mapping.mapped(reads, refs, mapping.Options(4, 0, 1, indel=True), "part"))
    lines = [r.line.split("\t") for r in sam.mapped(found).orderBy("read_id").collect()]
    assert lines[0][5] == "2H7M1D4M2H" and lines[0][9:11] == ["ACGTAGGATTC", "CDEFGHIJKLM"] and lines[0][11:] == ["NM:i:1", "MD:Z:7^C4"]
    assert lines[1][5] == "7M1I5M" and lines[1][10:] == ["*", "NM:i:1", "MD:Z:12"]


def test_nearby_collapse_against_all_kept_starts(spark):
    rng = random.Random(7)
    rows = []
    for read in range(6):
        for name in ("a", "b"):
            for p in sorted(rng.sample(range(200), 60)):
                rows.append((read, p, name, rng.randrange(4), 250, "ACGT", 4, False, rng.randrange(2), 4 + rng.randrange(-1, 2), "M", ""))
    best = spark.createDataFrame(rows, "read_id long, pos int, name string, ed int, read_len int, ref string, ref_len int, is_rc boolean, gaps int, span int, ops string, window string").repartition(3)
    for m in (2, 3, 5):
        want = []
        for key in sorted({(r[0], r[2]) for r in rows}):
            kept: list = []
            for r in (r for r in rows if (r[0], r[2]) == key):
                rank = lambda x: (x[3], x[8], abs(x[9] - 4), x[1])
                slot = next((i for i, x in enumerate(kept) if abs(x[1] - r[1]) <= m - 1), None)
                if slot is None:
                    kept.append(r)
                elif rank(r) < rank(kept[slot]):
                    kept[slot] = r
            want += [(*key, x[1], x[3]) for x in kept]
        assert sorted((r.read_id, r.name, r.pos, r.ed) for r in mapping.collapsed(best, m).collect()) == sorted(want)


def test_unmapped_rows(spark):
    reads = reads_of(spark, [("ACGT", "IIII"), ("ACG", "II"), ("AC", None)]).withColumn("name", F.concat("name", F.lit("/rc")))
    rows = [r.line.split("\t") for r in sam.unmapped(reads).orderBy("read_id").collect()]
    assert [(r[0], r[9], r[10]) for r in rows] == [("read0", "ACGT", "IIII"), ("read1", "ACG", "*"), ("read2", "AC", "*")]
    assert [r.line.split("\t")[0] for r in sam.unmapped(reads, spark.createDataFrame([(0,), (0,)], "read_id long")).collect()] == ["read1", "read2"]


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def brute_near(text, pattern, most, start):
    """Places with errors, by the distance of every part of the text."""
    out = []
    while len(out) < anchors.CAP and start < len(text):
        ends = []
        for e in range(start + 1, len(text) + 1):
            d, b = min((brute_distance(text[b:e], pattern), b) for b in range(start, e + 1))
            if d <= min(most, len(pattern)):
                ends.append((b, d, abs(e - b - len(pattern)), e))
        if not ends:
            break
        b, d, _, e = min(ends)
        out.append((b, e, d))
        start = b + 1
    return out


def test_anchors_with_errors_against_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        a5, a3 = ("".join(rng.choice("ACGT") for _ in range(rng.choice([3, 4]))) for _ in range(2))
        text = "".join(rng.choice([rng.choice("ACGT"), rng.choice("ACGT"), a5, a3, anchors.turned(a3)]) for _ in range(10))[:26]
        most = rng.choice([1, 2])
        near = {p: anchors.Near(text, p, most) for p in (a5, a3)}
        for start in rng.sample(range(len(text)), 4):
            for p in (a5, a3):
                assert near[p].after(start) == brute_near(text, p, most, start)
        opt = anchors.Anchors(a5, a3, most, 1, 9)
        found = []
        for order, (a, b) in enumerate(((a5, a3), (anchors.turned(a3), anchors.turned(a5)))):
            best = None
            for s in brute_near(text, a, most, 0):
                for e in brute_near(text, b, most, s[1]) if s[1] < len(text) else []:
                    if 1 <= e[0] - s[1] <= 9:
                        c = (s[2] + e[2], s[0], e[0] - s[1], s[1], order, s, e)
                        best = c if best is None or c[:4] < best[:4] else best
            found += [best] if best else []
        assert anchors.windows(text, opt, most) == min(found, key=lambda c: c[:5], default=None)


def test_anchor_md_against_loops():
    rng = random.Random(9)
    for _ in range(300):
        anchor = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 9)))
        read = "".join(rng.choice([c, c, c, "", rng.choice("ACGT"), c + "A"]) for c in anchor)
        n, m = len(anchor), len(read)
        cost = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                cost[i][j] = min(cost[i - 1][j - 1] + (read[j - 1] != anchor[i - 1]), cost[i][j - 1] + 1, cost[i - 1][j] + 1)
        i, j, ops = n, m, ""
        while i or j:
            if i and j and cost[i][j] == cost[i - 1][j - 1] + (read[j - 1] != anchor[i - 1]):
                i, j, ops = i - 1, j - 1, "M" + ops
            elif j and (not i or cost[i][j] == cost[i][j - 1] + 1):
                j, ops = j - 1, "I" + ops
            else:
                i, ops = i - 1, "D" + ops
        assert anchors.anchor_md(read, anchor) == indels.md_of(ops, read, anchor)


def test_empty_tables(spark):
    refs, none = refs_of(spark, [("a", "ACGTAC")]), spark.createDataFrame([], "read_id long, name string, seq string, qual string")
    empty = refs.limit(0)
    reads = reads_of(spark, [("ACGTACGT", "I" * 8), (None, None)])
    for opt in (mapping.Options(4, 1, 1), mapping.Options(4, 0, 1, indel=True)):
        assert mapping.mapped(none, refs, opt).count() == 0 and mapping.missed(none, refs, opt).count() == 0
        assert mapping.mapped(reads, empty, opt, "all").count() == 0 and mapping.missed(reads, empty, opt).count() == 2
    assert mapping.counts(mapping.hit_names(mapping.mapped(none, refs, mapping.Options(4))), refs).first()["count"] == 0
    assert mapping.collapsed(mapping.mapped(none, refs, mapping.Options(4, 0, 3)), 3).count() == 0
