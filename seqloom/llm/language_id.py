"""Language ID: blended-spectrum presence kernels, Nystroem landmarks, one-versus-rest kernel ridge regression.

A text becomes the set of its 1-, 2- and 3-grams over 64 symbols (0: a run of non-letters, 1-26: a-z after lower-casing,
27-63: other letters, hashed). The kernel of two texts is the number of grams that both have over the geometric mean of
their sizes. Landmarks are labelled texts; ridge regression against the landmarks' kernel columns gives one score for each
language, and a batch is scored by two matrix products.

The sample is bounded: about TRAIN_PER_LANG documents of each of the common.LABELS most frequent languages; what comes to the driver of each is
its set of grams, GRAMS numbers at most, whatever the text's length.

Defined results: a text that is null or has no letter gets `und` and score 0. Without training rows (or an empty table) every text is `und`; the
only language learned is that of every text with a letter. Of languages with one score the first in order of name is taken.
Repeated rows are scored alike; very long texts are taken whole. Any extra columns of the input are ignored by identify() and pass through keep_identified().
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAMS = 64 + 64**2 + 64**3
#: Bounds of the training sample: labelled documents of each language, and landmarks of all.
TRAIN_PER_LANG, LANDMARKS, RIDGE, SHARPNESS = 250, 128, 1e-3, 4.0
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@functools.cache
def symbols() -> np.ndarray:
    """Symbol of each code point."""
    out = np.zeros(0x110000, np.uint8)
    out[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
    letters = np.flatnonzero(out).astype(np.uint64)
    out[letters] = 27 + (common.splitmix(letters) % np.uint64(37)).astype(np.uint8)
    out[97:123] = np.arange(1, 27)
    out[65:91] = np.arange(1, 27)
    return out


def grams(text: str | None, scratch: np.ndarray) -> np.ndarray | None:
    """The grams of the text as marks in scratch; None if there is no letter."""
    if not text:
        return None
    s = symbols()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = s != 0
    if not letter.any():
        return None
    letter[1:] |= letter[:-1].copy()  # keep one symbol 0 after each run of letters
    s = s[letter].astype(np.int32)
    scratch.fill(False)
    scratch[s] = True
    if len(s) > 1:
        two = s[:-1] * 64 + s[1:]
        scratch[64 + two] = True
        if len(s) > 2:
            scratch[64 + 4096 + two[:-1] * 64 + s[2:]] = True
    return scratch


class Model:
    """Landmark grams and regression weights."""

    def __init__(self, rows: list[tuple[np.ndarray, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        seen = [(g, lang) for g, lang in rows if len(g)]  # grams of a text, ascending
        self.langs = sorted({lang for _, lang in seen})
        if not seen:
            return
        by = {k: [i for i, (_, lang) in enumerate(seen) if lang == k] for k in self.langs}
        chosen = sorted({i for k in self.langs for i in by[k][: max(2, landmarks // len(self.langs))]})
        self.vocab = np.unique(np.concatenate([seen[i][0] for i in chosen]))
        self.marks = np.zeros((len(self.vocab), len(chosen)), np.float32)
        for j, i in enumerate(chosen):
            self.marks[np.searchsorted(self.vocab, seen[i][0]), j] = 1
        self.norm = np.sqrt(np.array([len(seen[i][0]) for i in chosen], np.float32))
        present, size = np.zeros((len(seen), len(self.vocab)), np.float32), np.array([len(g) for g, _ in seen], np.float32)
        for r, (g, _) in enumerate(seen):
            at = np.searchsorted(self.vocab, g)
            at[at == len(self.vocab)] = 0
            present[r, at[self.vocab[at] == g]] = 1
        k = self.kernel(present, size).astype(np.float64)
        km = k[chosen]
        y = np.where(np.array([[lang == x for x in self.langs] for _, lang in seen]), 1.0, -1.0)
        w = 1 / np.array([len(by[lang]) for _, lang in seen])[:, None]  # each language weighs the same
        self.alpha = np.linalg.solve(k.T @ (w * k) + ridge * (km + km.T) / 2 + 1e-9 * np.eye(len(chosen)), k.T @ (w * y)).astype(np.float32)

    def kernel(self, present: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (present @ self.marks) / (np.sqrt(size)[:, None] * self.norm)

    def predict(self, batch: list) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(batch), [0.0] * len(batch)
        if not self.langs:
            return langs, scores
        scratch, block = np.zeros(GRAMS, bool), max(1, 4_000_000 // len(self.vocab))
        for at in range(0, len(batch), block):
            rows = range(at, min(at + block, len(batch)))
            present, size, known = np.zeros((len(rows), len(self.vocab)), np.float32), np.ones(len(rows), np.float32), np.zeros(len(rows), bool)
            for j, r in enumerate(rows):
                if grams(batch[r], scratch) is not None:
                    present[j], size[j], known[j] = scratch[self.vocab], np.count_nonzero(scratch), True
            f = SHARPNESS * (self.kernel(present, size) @ self.alpha)
            p = np.exp(f - f.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            for j, r in enumerate(rows):
                if known[j]:
                    langs[r], scores[r] = self.langs[best[j]], float(p[j, best[j]])
        return langs, scores


def gram_set(text: str | None, scratch: np.ndarray) -> np.ndarray:
    """The grams of the text, ascending; none if there is no letter."""
    return np.flatnonzero(scratch) if grams(text, scratch) is not None else np.zeros(0, np.int64)


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> Model:
    """From labelled documents that aren't held out; at most about per_lang of each language (a documented bound)."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held(2, 4))
    sample, _ = common.bounded_sample(labelled.select("doc_id", "lang", "text"), "lang", per_lang)

    def run(batches):
        scratch = np.zeros(GRAMS, bool)
        for batch in batches:
            sets = [gram_set(t, scratch).astype(np.int32) for t in common.texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(sets, pa.list_(pa.int32()))], names=["doc_id", "lang", "grams"])

    kind = sample.schema["lang"].dataType.simpleString()
    found = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(run, f"doc_id long, lang {kind}, grams array<int>").toArrow()
    rows = [(d or 0, lang, np.array(g, np.int64)) for d, lang, g in zip(*(found.column(c).to_pylist() for c in ("doc_id", "lang", "grams")))]
    rows.sort(key=lambda r: (common.splitmix(np.array([r[0]], np.int64).view(np.uint64))[0], r[0], r[1], r[2].tolist()))
    return Model([(g, lang) for _, lang, g in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(batch):
            langs, scores = shared.value.predict(common.texts(batch))
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": langs, "score": scores}

        return work

    from pyspark.sql.types import _parse_datatype_string as schema

    return common.map_batches(docs.select("doc_id", common.held(2, 4).alias("held_out"), "text"), make, schema(SCHEMA))


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.0) -> DataFrame:
    """The documents whose language was found (not `und`) with at least min_score; all columns stay. A null lang becomes the language found."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches):
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(names.index("text")).to_pylist())
            cols = list(batch.columns)
            if "lang" in names:
                i = names.index("lang")
                cols[i] = pa.array([x if x is not None or lang == "und" else lang for x, lang in zip(cols[i].to_pylist(), langs)], cols[i].type)
            filled = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
            yield filled.filter(pa.array([lang != "und" and s >= min_score for lang, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
