"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of insults (a fixed list, words and word beginnings learned from the labels), their nearness to second-person
words, capitals, punctuation, repetition and obfuscation rates (letters swapped for digits or signs, letters apart). Trees of depth 3
on quantile bins are boosted for the logistic loss; a quarter of the labels, not used by the words and trees, fits the calibration by pooling
adjacent violators, with linear interpolation so that scores keep their order.

The labels are a bounded sample: about PER_CLASS documents of each label; weights restore the shares of all labels.

Defined results: a null or empty text has all features 0 and gets a score too; without labels of both kinds every score is the share
of label 1 (0 without labels). Repeated labels of a document count once, the larger one; labels of a repeated doc_id hold for each of its rows, and a null
one is never learned from. Repeated rows are scored alike; splits with equal gains go to the first feature and threshold, margins that are equal share
a calibration block. Very long texts are taken whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string as schema

from . import common

PER_CLASS, TREES, DEPTH, RATE, BINS = 3000, 80, 3, 0.15, 32
WORDS_KEPT, STEMS_KEPT, STEM = 600, 300, 5
#: Plain English insults, and second-person words of the corpus languages.
INSULTS = frozenset(b"idiot moron stupid loser scum trash clown worthless pathetic disgusting dumb fool imbecile jerk bastard garbage vermin filthy ugly hate".split())
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted vosotros vuestro".encode().split())
LEET = bytes.maketrans(b"013457@$!", b"oieastasi")
SPLIT = bytes(b if common.WORD_BYTES[b] != 32 or b in b"@$!*'_" else 32 for b in range(256))
ODD = re.compile(rb"[a-z][0-9@$!*_]+[a-z]")
APART = re.compile(rb"(?<![a-z])[a-z](?:[ .\-_*][a-z]){3,}(?![a-z])")
SIGNS = re.compile(rb"[^\sA-Za-z0-9\x80-\xff]")
AGAIN = re.compile(rb"([^\sA-Za-z0-9\x80-\xff])\1")
NAMES = ("words", "learned", "learned_rate", "fixed", "fixed_rate", "stems", "stem_rate", "you_rate", "near_you", "capitals", "loud_words", "exclaims", "asks", "signs", "doubled_signs", "odd_words", "leet", "apart", "distinct", "weight", "top_weight")


def vocabulary(text: bytes) -> set[bytes]:
    return set(text.translate(common.WORD_BYTES).split())


def features(text: bytes | None, words: dict[bytes, float], stems: dict[bytes, float]) -> list[float]:
    if not text:
        return [0.0] * len(NAMES)
    ws = text.translate(common.WORD_BYTES).split()
    n, size = max(len(ws), 1), len(text)
    count = Counter(ws)
    learned = {w: c for w, c in count.items() if w in words}
    fixed = {w: c for w, c in count.items() if w in INSULTS}
    stem = {w: c for w, c in count.items() if w[:STEM] in stems and len(w) > STEM}
    marked = learned.keys() | fixed.keys() | stem.keys()
    you = sum(count[w] for w in YOU & count.keys())
    near = 0
    if you and marked:
        at = [i for i, w in enumerate(ws) if w in YOU]
        spots = np.array(at)
        for i, w in enumerate(ws):
            if w in marked:
                k = np.searchsorted(spots, i)
                near += min(abs(i - spots[j]) for j in (k - 1, k) if 0 <= j < len(spots)) <= 4
    upper = sum(map(text.count, _UPPER))
    loud = len(LOUD.findall(text))
    low = text.lower()
    odd, leet = 0, 0
    if ODD.search(low):
        for w in low.translate(SPLIT).split():
            if ODD.search(w):
                odd += 1
                plain = w.translate(LEET)
                leet += plain in words or plain in INSULTS
    apart = APART.findall(low)
    leet += sum(re.sub(rb"[^a-z]", b"", x) in INSULTS or re.sub(rb"[^a-z]", b"", x) in words for x in apart)
    hits, s = sum(learned.values()), sum(stem.values())
    weights = [words[w] for w in learned] + [stems[w[:STEM]] for w in stem]
    return [
        float(np.log1p(len(ws))), hits, hits / n, sum(fixed.values()), sum(fixed.values()) / n, s, s / n, you / n, near, upper / size, loud / n,
        text.count(b"!") / n, text.count(b"?") / n, len(SIGNS.findall(text)) / n, len(AGAIN.findall(text)) / n, odd / n, leet, len(apart), len(marked), sum(weights), max(weights, default=0.0),
    ]


_UPPER = [bytes([b]) for b in range(65, 91)]
LOUD = re.compile(rb"(?<![A-Za-z0-9\x80-\xff])[A-Z]{3,}(?![a-z0-9\x80-\xff])")


class Trees:
    """Boosted trees of one depth, as arrays of split features, thresholds and leaf values."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, l2: float = 2.0):
        self.depth = depth
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b = self.binned(x)
        w = w / w.mean()
        p = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
        self.base, f = float(np.log(p / (1 - p))), np.full(len(y), float(np.log(p / (1 - p))))
        self.splits, self.leaves = [], []
        for _ in range(trees):
            q = 1 / (1 + np.exp(-f))
            g, h = w * (q - y), w * q * (1 - q)
            node, split = np.zeros(len(y), np.int64), []
            for level in range(depth):
                width, best = 1 << level, [(0.0, 0, BINS)] * (1 << level)
                for j in range(b.shape[1]):
                    key = node * BINS + b[:, j]
                    gs = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(1)
                    hs = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(1)
                    gain = gs**2 / (hs + l2) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + l2) - gs[:, -1:] ** 2 / (hs[:, -1:] + l2)
                    gain[(hs < 1e-3) | (hs[:, -1:] - hs < 1e-3)] = 0
                    k = gain.argmax(1)
                    for i in range(width):
                        if gain[i, k[i]] > best[i][0] + 1e-12:
                            best[i] = (gain[i, k[i]], j, int(k[i]))
                split.append((np.array([x[1] for x in best]), np.array([x[2] for x in best])))
                node = 2 * node + (b[np.arange(len(y)), split[-1][0][node]] > split[-1][1][node])
            leaf = -rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + l2)
            f += leaf[node]
            self.splits.append(split)
            self.leaves.append(leaf)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f, rows = self.binned(x), np.full(len(x), self.base), np.arange(len(x))
        for split, leaf in zip(self.splits, self.leaves):
            node = np.zeros(len(x), np.int64)
            for feature, cut in split:
                node = 2 * node + (b[rows, feature[node]] > cut[node])
            f += leaf[node]
        return f


def isotonic(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres of margin and values of the pooled blocks, both ascending."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, v, k in zip(margin[order], y[order], w[order]):
        blocks.append([v, k, m * k])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, k2, s2 = blocks.pop()
            v1, k1, s1 = blocks.pop()
            blocks.append([(v1 * k1 + v2 * k2) / (k1 + k2), k1 + k2, s1 + s2])
    return np.array([s / k for _, k, s in blocks]), np.array([v for v, _, _ in blocks])


class Model:
    def __init__(self, words: dict, stems: dict, x: np.ndarray, y: np.ndarray, w: np.ndarray, fold: np.ndarray):
        self.words, self.stems, self.trees = words, stems, None
        self.share = float((w * y).sum() / w.sum()) if len(y) else 0.0
        if len(set(y.tolist())) == 2:
            fit = fold != 0 if len(set(y[fold != 0].tolist())) == 2 and len(set(y[fold == 0].tolist())) == 2 else np.ones(len(y), bool)
            self.trees = Trees(x[fit], y[fit], w[fit])
            own = ~fit if not fit.all() else fit
            self.at, self.value = isotonic(self.trees.margin(x[own]), y[own], w[own])

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        m = self.trees.margin(np.array([features(t, self.words, self.stems) for t in texts]))
        # a small part of the raw probability keeps the order where the calibration is level
        return np.clip(0.98 * np.interp(m, self.at, self.value) + 0.02 / (1 + np.exp(-m)), 0, 1)


def _learned(sample: DataFrame, n: dict[int, float]) -> tuple[dict, dict]:
    """Words and word beginnings that documents of label 1 have far more often, with their log odds ratios."""

    def run(batches):
        for batch in batches:
            out: dict = {}
            for text, y in zip(common.raw(batch), batch.column("y").to_pylist()):
                v = vocabulary(text or b"")
                for w in [*((0, w) for w in v if len(w) <= 40), *((1, w) for w in {w[:STEM] for w in v if len(w) > STEM})]:
                    out.setdefault(w, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([w for _, w in out], pa.binary()), *[pa.array([c[i] for c in out.values()], pa.int64()) for i in (0, 1)]], names=["kind", "w", "c0", "c1"])

    counts = sample.select("text", "y").mapInArrow(run, "kind int, w binary, c0 long, c1 long").groupBy("kind", "w").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    n0, n1 = n[0], n[1]
    p1, p0 = (F.col("c1") + 0.25) / (n1 + 0.5), (F.col("c0") + 0.25) / (n0 + 0.5)
    scored = counts.withColumn("r", F.log(p1) - F.log(p0)).where(F.col("r") > 1.5).where(F.col("c1") >= 4)
    out = []
    for kind, most in ((0, WORDS_KEPT), (1, STEMS_KEPT)):
        rows = scored.where(F.col("kind") == kind).orderBy((F.col("r") * F.sqrt("c1")).desc(), "w").limit(most).collect()
        out.append({bytes(r.w): float(r.r) for r in rows})
    return out[0], out[1]


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns from labels of documents whose crc32 modulo 5 is not 0."""
    spark = docs.sparkSession
    given = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~common.held(0, 5)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y")).where("y in (0, 1)")
    ids, share = common.bounded_sample(given, "y", per_class)
    ids = common.stage(ids, "labels")
    if set(share) != {0, 1}:
        return Model({}, {}, np.zeros((ids.count(), len(NAMES))), np.full(ids.count(), float(next(iter(share), 0))), np.ones(ids.count()), np.zeros(ids.count()))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")  # at most about 2 * per_class ids
    sample = common.stage(sample, "sample")
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if set(n) != {0, 1}:
        return Model({}, {}, np.zeros((sum(n.values()), len(NAMES))), np.full(sum(n.values()), float(next(iter(n), 0))), np.ones(sum(n.values())), np.zeros(sum(n.values())))
    words, stems = _learned(sample.where(~_calibrates()), n)

    def run(batches):
        for batch in batches:
            x = [features(t, words, stems) for t in common.raw(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("fold"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "fold", "x"])

    rows = sorted(sample.select("doc_id", "y", F.when(_calibrates(), 0).otherwise(1).alias("fold"), "text").mapInArrow(run, "doc_id long, y int, fold int, x array<double>").collect())
    y = np.array([r.y for r in rows], float)
    return Model(words, stems, np.array([r.x for r in rows]), y, np.array([1 / share[r.y] for r in rows]), np.array([r.fold for r in rows]))


def _calibrates() -> F.Column:
    """A quarter of the labelled documents fits the calibration, not the words and trees."""
    return common.hashed(5, "doc_id") % 4 == 0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(batch):
            s = shared.value.scores(common.raw(batch))
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s.tolist(), "predicted": (s >= 0.5).astype(int).tolist()}

        return work

    return common.map_batches(docs.select("doc_id", common.held(0, 5).alias("held_out"), "text"), make, schema("doc_id long, held_out boolean, score double, predicted int"))
