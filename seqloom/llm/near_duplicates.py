"""Near-duplicates by ProbMinHash over weighted word shingles, banding and exact verification.

A shingle is five consecutive words (lower-cased; a shorter text is one shingle), weighted by how often it occurs. Each shingle is
a Poisson process whose rate is its weight; its arrivals fall on the signature's components at random, each component keeps the
shingle with the earliest arrival, and a process ends when its time passes the latest component. Two components agree with a
probability equal to the probability Jaccard similarity of the texts; bands of four components make candidates; candidates are
verified by that similarity, computed exactly.

Scale. Equal word sequences fall together first (a hash aggregation with partial sums). In a band's bucket a text that shares TRIED buckets
with the bucket's centre is compared with it; this settles most, and only saves work. Buckets that are not one component then are compared
exactly. Of one with up to SMALL texts the pairs are made rows, each pair once. Larger buckets that share texts are a cell, and only texts of
one cell are compared: chains of chance pairs in small buckets would join most texts of a large table. Let X be the share of x on shingles that y lacks, Y that of y on shingles that x lacks; the similarity is at most
(1 - X)(1 - Y) / (1 - XY). So similar texts have a first common shingle, rare ones first, with little weight before it in both (in any order
that is the same for all texts; it comes from a bounded sample, and a sample changes the work, not the result). The texts that can be similar by
that bound are joined into groups, a star for each shingle of a cell; groups are dealt into pairs of blocks, and a task compares two blocks, in
parts of about BLOCK_CHARS characters, by matrix products of shares and supports: no pair of them is made a row but verified links. So all pairs
that share a bucket are compared or are in one class. A text is sent once for each block of its group: at most COPIES times, until blocks have
WIDE_CHARS characters. What is sent goes in rounds, so that disk holds one round and not all of them. A group's work grows with the square of its
characters, where texts are that alike and still not of one class.
Pairs of rows go in rounds too, by the characters of their texts and those of all texts in shared buckets; a round moves only texts of its pairs.
Staged tables go when nothing reads them any more, and shuffle files after each step that moves texts or band keys.
Components come from min-label propagation in tables. Nothing of the documents reaches the driver but counts.

Defined results: null texts and wordless texts have no shingles: null ones and null doc_ids stay alone, equal wordless texts are copies. The class
id is the smallest doc_id of the class. An empty table gives no rows. A repeated row is a copy of itself and is returned each time. Rows with one
doc_id and different texts are compared as rows of their own. Very long texts are taken whole, a block each. Other columns, whatever their names, are not looked at
by classes() and pass through keep_first().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 4
#: Ids are broadcast up to this number (about 50 MB in an executor); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Texts whose shingles give the order of prefixes, and the number of frequent shingles that the order knows.
ORDER_TEXTS, ORDER_SIZE = 10_000, 200_000
#: Buckets that a text shares with a centre to be compared with it; characters of a part of a block (and those that a text counts beside its own); columns of a matrix product.
TRIED, BLOCK_CHARS, TEXT_CHARS, COLUMNS = 3, 256_000, 100, 1024
#: Texts of a bucket whose pairs are made rows (half as many a text, at most).
SMALL = 16
#: Blocks of a group, until a block has WIDE_CHARS characters.
COPIES, WIDE_CHARS = 16, 8_000_000
#: Characters sent to be compared in one round: so many times those of the groups' texts, or so many.
ROUND_TIMES, ROUND_CHARS = 2, 1_000_000_000
#: The same of the texts of pairs, as a share of those of all texts in shared buckets (ROUND_CHARS if that's more); most rounds that are made only to keep to BROADCAST_IDS.
PAIRS_SHARE, ID_ROUNDS = 0.5, 16
_MULT = np.uint64(0x9FB21C651E98DF25)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the shingles in order, repeated ones included."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass").translate(common.WORD_BYTES), np.uint8)
    inside = np.concatenate(([False], data != 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    w = common.span_hashes(data, start, end)
    with np.errstate(over="ignore"):
        n = max(1, len(w) - words + 1)
        out = np.zeros(n, np.uint64)
        for k in range(min(words, len(w))):
            out = out * _MULT + w[k : k + n]
    return common.splitmix(out)


def weighted(text: str | None, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(text, words), return_counts=True)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, size: int) -> np.ndarray:
    """Signatures (n, size) of n weighted sets given flat; owner: the set of each element, ascending."""
    best, sig = np.full(n * size, np.inf), np.zeros(n * size, np.uint64)
    live, e, rate, own, time = np.arange(len(elements)), elements, weights.astype(float), owner, np.zeros(len(elements))
    step = 0
    while len(live):
        r = common.splitmix(e + np.uint64(step * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        time = time - np.log(((r >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52) / rate
        slot = own * size + (common.splitmix(r) % np.uint64(size)).astype(np.int64)
        sooner = np.flatnonzero(time < best[slot])
        np.minimum.at(best, slot[sooner], time[sooner])
        won = sooner[time[sooner] == best[slot[sooner]]]
        sig[slot[won]] = e[won]
        last = best.reshape(n, size).max(1)
        stay = time < last[own]
        live, e, rate, own, time = live[stay], e[stay], rate[stay], own[stay], time[stay]
        step += 1
    return sig.reshape(n, size)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets: the sum over common d of 1 / sum over all e of max(a_e / a_d, b_e / b_d)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    common_, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common_):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    if (x == y).all():
        # max(a_e / a_d, b_e / b_d) is then the same weight over that of d
        return float(x.sum() / (x.sum() + only_a + only_b))
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    below, above = np.cumsum(x), y.sum() - np.cumsum(y)  # ratio at most that of d: a_e / a_d is the larger
    return float((1 / ((below + only_a) / x + (above + only_b) / y)).sum())


# ---- tables


def digest(text: str) -> bytes:
    """Of the word sequence, or of the raw text if it has no word."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(common.WORD_BYTES).split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16, key=b"raw").digest()


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, digest k1 and k2 of the word sequence, band keys (none without words) of every text that isn't null."""

    def run(batches):
        mix = np.arange(1, bands + 1, dtype=np.uint64)
        for batch in batches:
            batch = batch.filter(pa.array([t is not None for t in common.texts(batch)], pa.bool_()))
            ids, texts = batch.column("doc_id").to_numpy(zero_copy_only=False), common.texts(batch)
            for at in tokens.blocks(texts, 400_000):
                sets = [weighted(t) for t in texts[at]]
                owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
                sig = signatures(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), owner, len(sets), bands * rows).reshape(len(sets), bands, rows)
                key = np.zeros(sig.shape[:2], np.uint64) + mix
                for k in range(rows):
                    key = common.splitmix(key ^ sig[:, :, k])
                some = np.array([len(s[0]) > 0 for s in sets])
                offsets = np.concatenate(([0], np.cumsum(np.where(some, bands, 0)))).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[some].reshape(-1).view(np.int64)))
                k = np.frombuffer(b"".join(map(digest, texts[at])), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), keys], names=["doc_id", "k1", "k2", "keys"])

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, keys array<long>")


def pool(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of those ids. They are counted and then broadcast, up to BROADCAST_IDS at a time, so that only their texts move; in ID_ROUNDS rounds at most."""
    wanted = common.stage(ids.distinct(), "ids")
    n, out = wanted.count(), None
    rounds = max(1, min(ID_ROUNDS, -(-n // BROADCAST_IDS)))
    for k in range(rounds):
        own, now = docs.select("doc_id", "text"), wanted
        if rounds > 1:
            own, now = (t.where(F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.lit(rounds)) == k) for t in (own, now))
        now = common.stage(own.join(F.broadcast(now) if n <= rounds * BROADCAST_IDS else now, "doc_id", "left_semi"), "pool")
        out = now if out is None else out.union(now)
        common.free(docs.sparkSession)
    return out


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of a staged table whose texts are at least that similar."""
    sizes = texts.select("doc_id", F.length("text").alias("size"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    n, sent = ends.join(sizes, "doc_id").agg(F.count(F.lit(1)), F.sum("size")).first()
    held = sizes.agg(F.sum("size")).first()[0] or 0
    rounds = max(1, int(-(-(sent or 0) // max(ROUND_CHARS, PAIRS_SHARE * held))), min(ID_ROUNDS, -(-n // BROADCAST_IDS)))
    out = None
    for k in range(rounds):
        # a text has few pairs as b, so rounds are alike in size
        now = pairs if rounds == 1 else pairs.where(F.pmod(F.xxhash64(F.lit(37), "b"), F.lit(rounds)) == k)
        now = common.stage(_verified(now, texts, least, n <= rounds * BROADCAST_IDS), "links")
        out = now if out is None else out.union(now)
        common.free(pairs.sparkSession)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, least: float, few: bool) -> DataFrame:
    def of(c: str) -> DataFrame:
        own = texts.join(F.broadcast(pairs.select(F.col(c).alias("doc_id")).distinct()), "doc_id", "left_semi") if few else texts
        return own.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))

    both = pairs.join(of("b"), "b").join(of("a"), "a")

    def run(batches):
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), common.texts(batch, "text_a"), common.texts(batch, "text_b")):
                if last[0] != a:
                    last = (a, weighted(ta))
                keep.append(similarity(last[1], weighted(tb)) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest id of its component) of every linked id, by large-star and small-star rounds."""
    edges = links.where(F.col("a") != F.col("b"))
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # large-star: larger neighbours of u go to the smallest of u and its neighbours
        least = common.stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")  # a table, so that a hot u can be split
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        # small-star: u and its smaller neighbours go to the smallest of them (edges are a < b, so u is b)
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).where("x != y").union(low.select(F.col("m").alias("x"), F.col("b").alias("y")))
        small = common.stage(small.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "small")
        # a star forest: nothing is both a root and below one, and each has one root
        ends = small.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(small.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("n").agg(F.max("up").alias("up"), F.sum("down").alias("down")).where("up + down > 1").isEmpty():
            return small.select(F.col("b").alias("node"), F.col("a").alias("root"))
        edges = small


def prefix(elements: np.ndarray, weights: np.ndarray, frequent: np.ndarray, often: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Elements with at most 1 - least of the weight before them, rare ones first, and that weight; frequent is ascending, often are its counts."""
    count = np.zeros(len(elements), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, elements), len(frequent) - 1)
        count = np.where(frequent[at] == elements, often[at], 0)
    order = np.lexsort((elements, count))
    w = weights[order]
    before = (np.cumsum(w) - w) / w.sum()
    keep = before <= 1 - least + 1e-9
    return elements[order[keep]], before[keep]


def neighbours(apart: DataFrame, texts: DataFrame, n: int, least: float) -> DataFrame | None:
    """node, root: groups of the n texts of apart (doc_id, root, cell) outside of which no text of its cell is similar to one of them; None if there are none."""
    mine = common.stage(texts.join(F.broadcast(apart) if n <= BROADCAST_IDS else apart, "doc_id"), "apart-texts")
    share = min(common.MAX63, int(ORDER_TEXTS / n * (1 << 63)))

    def each(batches):
        for batch in batches:
            sets = [weighted(t)[0] for t in common.texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], names=["s"])

    some = mine.where(common.hashed(23, "doc_id") <= share).select("text").mapInArrow(each, "s long")
    top = some.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(ORDER_SIZE).toArrow()
    s, c = top.column("s").to_numpy().view(np.uint64), top.column("n").to_numpy()
    up = np.argsort(s)
    shared = apart.sparkSession.sparkContext.broadcast((s[up], c[up]))

    def rare(batches):
        for batch in batches:
            parts = [prefix(*weighted(t), *shared.value, least) for t in common.texts(batch)]
            of = pa.array(np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts]))
            flat, before = (np.concatenate([np.zeros(0, kind), *(p[i] for p in parts)]) for i, kind in enumerate((np.uint64, float)))
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), *(batch.column(c).take(of) for c in ("cell", "root", "doc_id")), pa.array(before)], names=["s", "cell", "root", "doc_id", "before"])

    rows = common.stage(mine.select("doc_id", "root", "cell", "text").mapInArrow(rare, "s long, cell long, root long, doc_id long, before double"), "prefixes")
    # the text with the least before a shingle is a partner of every text of the cell there that has one
    first = rows.groupBy("cell", "s").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min(F.struct("before", "doc_id")).alias("f")).where("r0 != r1")
    first = common.stage(first.select("cell", "s", F.col("f.before").alias("b0"), F.col("f.doc_id").alias("d0")), "firsts")
    x, y = F.col("before"), F.col("b0")
    near = rows.join(first, ["cell", "s"]).where((F.col("doc_id") != F.col("d0")) & ((1 - x) * (1 - y) >= least * (1 - x * y) - 1e-9))
    edges = common.stage(near.select(F.least("doc_id", "d0").alias("a"), F.greatest("doc_id", "d0").alias("b")).distinct(), "near")
    if edges.isEmpty():
        return None
    groups = components(edges)
    return groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())


def compare(sets: list, roots: list[int], left: np.ndarray, right: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Verified links (places in sets) of left texts to right ones that join different roots; what links so far have joined is not tried again."""
    element, weight = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] / s[1].sum() for s in sets])
    owner = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    _, column, count = np.unique(element, return_inverse=True, return_counts=True)
    again = count[column] > 1  # a shingle of one text alone is in no product
    column, weight, owner = np.unique(column[again], return_inverse=True)[1], weight[again], owner[again]
    order = np.argsort(column, kind="stable")
    column, weight, owner = column[order], weight[order], owner[order]
    x, y = np.zeros((len(left), len(right)), np.float32), np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        share = np.zeros((len(sets), COLUMNS), np.float32)
        share[owner[a:b], column[a:b] - at] = weight[a:b]
        has = (share > 0).astype(np.float32)
        x += share[left] @ has[right].T  # share of the left text on what the right one has too
        y += has[left] @ share[right].T
    with np.errstate(invalid="ignore", divide="ignore"):
        bound = np.where(x * y > 0, x * y / (x + y - x * y), 0)
    i, j = np.nonzero(bound >= least - 1e-4)
    order = np.argsort(-bound[i, j], kind="stable")
    parent = {r: r for r in roots}

    def top(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    out = []
    for p, q in zip(left[i[order]].tolist(), right[j[order]].tolist()):
        a, b = top(roots[p]), top(roots[q])
        if a != b and similarity(sets[p], sets[q]) >= least:
            parent[a] = b
            out.append((p, q))
    return out


def parts(sizes: list[int]) -> list[slice]:
    """Consecutive parts of about BLOCK_CHARS; a larger text is a part of its own."""
    out, at, total = [], 0, 0
    for k, size in enumerate(sizes):
        if k > at and total + size > BLOCK_CHARS:
            out.append(slice(at, k))
            at, total = k, 0
        total += size
    return [*out, slice(at, len(sizes))] if sizes else []


def compare_blocks(left: list, right: list | None, least: float) -> list[tuple[int, int]]:
    """Links (doc_ids a < b) of left texts (doc_id, root, set, size) to right ones, or of left ones with one another, part by part."""
    parent: dict[int, int] = {}

    def top(r: int) -> int:
        while (up := parent.get(r, r)) != r:
            parent[r] = r = parent.get(up, up)
        return r

    out = []
    one, other = ([rows[at] for at in parts([r[3] for r in rows])] for rows in (left, left if right is None else right))
    for k, a in enumerate(one):
        for m, b in enumerate(other):
            if right is None and m < k:
                continue
            both = a if right is None and m == k else a + b
            i = np.arange(len(a))
            found = compare([r[2] for r in both], [top(r[1]) for r in both], i, i if both is a else np.arange(len(a), len(both)), least)
            for p, q in found:
                parent[top(both[p][1])] = top(both[q][1])
                out.append((min(both[p][0], both[q][0]), max(both[p][0], both[q][0])))
    return out


def within(groups: DataFrame, apart: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a < b) that join all texts of a group (node, root) that are similar and not of one root in apart (doc_id, root) yet."""
    nodes = groups.select(F.col("node").alias("doc_id"), F.col("root").alias("g")).join(apart.select("doc_id", "root"), "doc_id")
    nodes = common.stage(nodes, "nodes")
    own = texts.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes, "doc_id")
    own = common.stage(own.select("doc_id", "text", "root", "g"), "grouped")
    common.free(own.sparkSession)
    sizes = own.groupBy("g").agg(F.sum(F.length("text") + TEXT_CHARS).alias("size"))
    count = F.least(F.ceil(F.col("size") / BLOCK_CHARS), F.greatest(F.lit(COPIES), F.ceil(F.col("size") / WIDE_CHARS)))
    blocks = common.stage(sizes.select("g", "size", count.cast("long").alias("blocks")), "blocks")
    held, sent = blocks.agg(F.sum("size"), F.sum(F.col("size") * F.col("blocks").cast("double"))).first()
    rounds = max(1, int(-(-sent // max(ROUND_CHARS, ROUND_TIMES * held))))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    dealt = own.join(blocks, "g").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "root", "text")

    def run(batches):
        key, rows = None, ([], [])

        def flush():
            ends = compare_blocks(rows[0], rows[1] if key[1] != key[2] else None, least)
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("g", "i", "j", "block", "doc_id", "root")]
            for g, i, j, b, doc_id, root, text in zip(*cols, common.texts(batch)):
                if (g, i, j) != key:
                    if key is not None:
                        yield flush()
                    key, rows = (g, i, j), ([], [])
                rows[b != i].append((doc_id, root, weighted(text), len(text) + TEXT_CHARS))
        if key is not None:
            yield flush()

    found = None
    for k in range(rounds):
        now = dealt if rounds == 1 else dealt.where(F.pmod(F.xxhash64(F.lit(29), "g", "i", "j"), F.lit(rounds)) == k)
        now = now.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(run, "a long, b long").distinct()
        now = common.stage(now, "compared")
        found = now if found is None else found.union(now)
        if rounds > 1:
            common.free(own.sparkSession)
    return found


def small_pairs(roots: DataFrame, mixed: DataFrame) -> DataFrame:
    """Pairs (a < b) of texts of different roots in the buckets of mixed (key, n) with up to SMALL texts; roots: key, a, b, root."""
    few = roots.join(mixed.where(F.col("n") <= SMALL).select("key"), "key").groupBy("key").agg(F.collect_list(F.struct("b", "root")).alias("m"))
    few = few.select("m", F.explode("m").alias("x")).select("x", F.explode("m").alias("y")).where("x.b < y.b and x.root != y.root")
    return few.select(F.col("x.b").alias("a"), F.col("y.b").alias("b")).distinct()


def large_links(roots: DataFrame, mixed: DataFrame, texts: DataFrame, least: float) -> DataFrame | None:
    """Links (a < b) that join the similar texts of the buckets of mixed (key, n) with more than SMALL texts; roots: key, a, b, root."""
    many = common.stage(roots.join(mixed.where(F.col("n") > SMALL).select("key"), "key").select("a", "b", "root").distinct(), "many")
    if many.isEmpty():
        return None
    # buckets with a text in common are a cell; the smallest doc_id of each is a star's centre
    cells = components(many.select("a", "b").where("a != b").distinct()).select(F.col("node").alias("doc_id"), F.col("root").alias("cell"))
    apart = many.select(F.col("b").alias("doc_id"), "root").distinct().join(cells, "doc_id", "left")
    apart = common.stage(apart.select("doc_id", "root", F.coalesce("cell", "doc_id").alias("cell")), "apart")
    groups = neighbours(apart, texts, apart.count(), least)
    return None if groups is None else within(groups, apart, texts, least)


def links(keyed: DataFrame, docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame | None]:
    """Verified links (a < b) that join the similar texts of keyed (doc_id, key; ids not repeated), and their components (None without a link).

    A staged keyed is discarded.
    """
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a")).where("n > 1")
    centres = common.stage(shared.select("key", "a"), "centres")
    common.free(docs.sparkSession)
    members = common.stage(keyed.join(centres, "key").select("key", F.col("doc_id").alias("b"), "a"), "members")
    common.discard(keyed)
    common.discard(centres)
    common.free(docs.sparkSession)
    texts = pool(docs, members.select(F.col("b").alias("doc_id")))
    tried = members.where("a != b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TRIED)
    tried = common.stage(tried.select("a", "b"), "pairs")
    found = verified(tried, texts, least)
    forest = None if found.isEmpty() else components(found)
    # buckets whose texts are not in one component yet; a text without a link is its own root
    roots = members.select("key", "a", "b", F.col("b").alias("root")) if forest is None else members.join(forest.withColumnRenamed("node", "b"), "b", "left").select("key", "a", "b", F.coalesce("root", "b").alias("root"))
    roots = common.stage(roots, "roots")
    mixed = roots.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1")
    mixed = common.stage(mixed.select("key", "n"), "mixed")
    common.discard(members)
    more = verified(common.stage(small_pairs(roots, mixed).join(tried, ["a", "b"], "left_anti"), "small-pairs"), texts, least)
    if (large := large_links(roots, mixed, texts, least)) is not None:
        more = common.stage(more.union(large).distinct(), "all-more")
    if more.isEmpty():
        return found, forest
    edges = more if forest is None else forest.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more)
    return found.union(more), components(edges)


def repeated(docs: DataFrame) -> bool:
    """Some doc_id occurs twice."""
    return not docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").isEmpty()


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number of their own in _row."""
    return common.stage(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")


def classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, rep (the smallest doc_id with the same words) and n_links of every document.

    n_links: links verified between the document's representative and texts with other words. They join the class; pairs that others
    have joined already are not tried, so it's no count of all similar texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not repeated(docs):
        return _classes(docs, least, bands, rows)
    rows_ = numbered(docs)
    kind = common.stage(_classes(rows_.where(F.col("doc_id").isNotNull()).select(F.col("_row").alias("doc_id"), "text"), least, bands, rows).withColumnRenamed("doc_id", "_row"), "row-classes")
    known = rows_.join(kind, "_row", "left").select("_row", "doc_id", "class_id", "rep", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    known = common.stage(known, "known")
    of = lambda c: known.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(c)).agg(F.min("doc_id").alias(f"{c}_doc"))
    out = known.join(common.stage(of("class_id"), "class-ids"), "class_id", "left").join(common.stage(of("rep"), "rep-ids"), "rep", "left")
    return out.select("doc_id", F.col("class_id_doc").alias("class_id"), F.col("rep_doc").alias("rep"), "n_links")


def _classes(docs: DataFrame, least: float, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """As classes, of doc_ids that are not repeated."""
    sig = common.stage(signed(docs, bands, rows), "signatures")
    first = common.stage(sig.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "first")
    member = common.stage(sig.select("doc_id", "k1", "k2").join(first, ["k1", "k2"]).select("doc_id", "rep"), "member")
    own = sig.select("doc_id", "keys").join(first.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    keyed = common.stage(own.select("doc_id", F.explode("keys").alias("key")), "keyed")
    common.discard(sig)
    common.free(docs.sparkSession)
    found, forest = links(keyed, docs, least)
    ends = found.select("a").union(found.select(F.col("b").alias("a")))
    info = ends.groupBy("a").agg(F.count(F.lit(1)).alias("n_links")).withColumnRenamed("a", "rep")
    info = info.join(forest.withColumnRenamed("node", "rep"), "rep", "left") if forest is not None else info.withColumn("root", F.col("rep"))
    out = member.join(common.stage(info, "info"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"), "rep", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    alone = docs.where(F.col("text").isNull() | F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def keep_first(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents without those that have a smaller doc_id in their class; of rows with one doc_id and the same words one stays.

    Rows with a null doc_id all stay; different texts of one doc_id are documents of their own.
    """
    if repeated(docs):
        return _keep_first_rows(docs, least)
    drop = common.stage(_classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least).where("class_id != doc_id").select("doc_id").distinct(), "drop")
    if drop.count() <= BROADCAST_IDS:
        drop = F.broadcast(drop)
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def _keep_first_rows(docs: DataFrame, least: float) -> DataFrame:
    """As keep_first, where doc_ids repeat: rows get numbers of their own, and of each class the row with the smallest doc_id stays."""
    rows = numbered(docs)
    some = rows.where(F.col("doc_id").isNotNull())
    kind = _classes(some.select(F.col("_row").alias("doc_id"), "text"), least).select(F.col("doc_id").alias("_row"), "class_id")
    # null texts are alike only with one doc_id
    own = F.when(F.col("text").isNull(), F.struct(F.lit(-1).cast("long").alias("c"), F.col("doc_id").cast("long").alias("d"))).otherwise(F.struct(F.col("class_id").alias("c"), F.lit(0).cast("long").alias("d")))
    known = common.stage(some.join(kind, "_row").select("_row", "doc_id", own.alias("own")), "known")
    first = known.groupBy("own").agg(F.min(F.struct("doc_id", "_row")).alias("f")).select(F.col("f._row").alias("_row"))
    drop = common.stage(known.select("_row").join(first, "_row", "left_anti"), "drop")
    if drop.count() <= BROADCAST_IDS:
        drop = F.broadcast(drop)
    return rows.join(drop, "_row", "left_anti").select(*docs.columns)
