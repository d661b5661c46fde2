"""Language identification: averaged hashed subword embeddings and a linear
softmax, trained by stochastic gradient descent in numpy, with a calibrated
threshold below which a prediction is rejected.

The mean of embeddings times the output weights is the mean of their products,
so a trained model is one small table of scores per subword bucket.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vigilake.llm.tokens import chunks, mixed

BUCKETS, DIMENSIONS, SIZES = 1 << 15, 16, (2, 3, 4)
PER_LANGUAGE = 1500  # documents of a language in the training sample, about
EPOCHS, RATE, SEED = 12, 4.0, 5
BASE = np.uint64(257)
REJECTED_SHARE = 0.0005  # of right predictions on held-back pieces
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
# Bytes that are neither letters nor part of one, as one blank.
FOLDED[[b for b in range(128) if not chr(b).isalpha()]] = 32


def subwords(text: str) -> np.ndarray:
    """Bucket of every run of 2, 3 and 4 bytes of the text, A-Z lower-cased,
    everything below x80 that is no letter as a blank; blank-only runs left out."""
    data = FOLDED[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    # One blank in a row is enough, and one at either end.
    data = np.concatenate(([np.uint8(32)], data, [np.uint8(32)]))
    data = data[np.concatenate(([True], (data[1:] != 32) | (data[:-1] != 32)))].astype(np.uint64)
    out, run = [], np.zeros(len(data), dtype=np.uint64)
    for size in range(1, SIZES[-1] + 1):
        # Runs of one byte more, from those of the size before.
        n = len(data) - size + 1
        run = run[:n] * BASE + data[size - 1:]
        if n > 0 and size in SIZES:
            h = run + np.uint64(size * int(BASE) ** size)
            out.append((mixed(h) & np.uint64(BUCKETS - 1)).astype(np.uint16))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint16)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket x language
    bias: np.ndarray
    sharpness: float
    threshold: float  # below it a prediction is rejected

    @cached_property
    def _table(self) -> np.ndarray:
        return self.scores.astype(np.float64)

    def predict(self, text: str) -> tuple[str, float]:
        total, n = np.zeros(len(self.languages)), 0
        for at in range(0, len(text), 1 << 18):  # bounds the memory; pieces only part subwords at the seam
            found = subwords(text[at:at + (1 << 18)])
            # A text is how often it has each bucket; no row of scores is gathered for a subword.
            total += np.bincount(found, minlength=BUCKETS) @ self._table
            n += len(found)
        z = self.sharpness * (total / max(n, 1) + self.bias)
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def fit(texts: list[str], langs: list[str], seed: int = SEED) -> Model:
    """Train on labelled texts; each step sees a random piece of a text, from a
    few words to all of it, so that short texts are known too. A tenth of the
    texts is held back for the sharpness and the rejection threshold."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    order = sorted(range(len(texts)), key=lambda i: (texts[i], langs[i]))
    rng.shuffle(order)
    held = order[: max(len(order) // 10, 1)] if len(order) > 1 else order
    used = order[len(held):] or held
    y = {n: k for k, n in enumerate(names)}
    features = {i: subwords(texts[i]) for i in order}

    def piece(i: int) -> np.ndarray:
        f = features[i]
        n = min(len(f), int(np.exp(rng.uniform(np.log(24), np.log(6000)))))
        if n >= len(f):
            return f
        # A contiguous piece of each size of subword.
        third, at = n // 3 + 1, rng.random()
        parts = np.array_split(f, 3)
        return np.concatenate([p[int(at * max(len(p) - third, 0)):][:third] for p in parts])

    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, b = np.zeros((DIMENSIONS, len(names)), dtype=np.float32), np.zeros(len(names), dtype=np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(used):
            f = piece(int(i))
            if not len(f):
                continue
            mean = e[f].mean(axis=0)
            z = mean @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[langs[i]]] -= 1.0
            back = w @ p
            w -= 0.1 * rate * np.outer(mean, p)
            b -= 0.01 * rate * p
            np.subtract.at(e, f, (rate / len(f)) * back)
    model = Model(names, (e @ w).astype(np.float32), b.astype(np.float64), 1.0, 0.0)
    tests = [(piece(i), y[langs[i]]) for i in held for _ in range(4)]
    tests = [(model.scores[f].mean(axis=0) + b, k) for f, k in tests if len(f)]
    if tests:
        z, k = np.array([t[0] for t in tests], dtype=np.float64), np.array([t[1] for t in tests])

        def chances(s: float) -> np.ndarray:
            p = np.exp(s * z - (s * z).max(axis=1, keepdims=True))
            return p / p.sum(axis=1, keepdims=True)

        at = np.arange(len(k))
        model.sharpness = float(min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=lambda s: -np.log(chances(s)[at, k] + 1e-12).mean()))
        p = chances(model.sharpness)
        right = p.max(axis=1)[p.argmax(axis=1) == k]
        model.threshold = float(min(np.quantile(right, REJECTED_SHARE), 0.5)) if len(right) else 0.0
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept out of training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` documents of each language, chosen by a
    hash of their ids among all that may be learned from; languages are counted
    first, so rare ones are there in full. One task fits the model on that
    bounded sample; the driver only gets the model."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("id").isNotNull() & ~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count(F.lit(1))).alias("share"))
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # One short map, one entry per language; the texts need no shuffle.
    known = shares.agg(F.map_from_entries(F.collect_list(F.struct("lang", "share"))).alias("shares")).scalar()
    sample = labelled.where(draw < F.element_at(known, F.col("lang"))).select(F.lit(0).alias("one"), "text", "lang")
    fitted = sample.groupBy("one").applyInPandas(_fitted, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)


def _fitted(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"model": [pickle.dumps(fit(rows["text"].tolist(), rows["lang"].tolist()))]})


@lru_cache(maxsize=2)
def _loaded(stored: bytes) -> Model:
    return pickle.loads(stored)


def _judged(known: Model, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """Language, score and whether it is rejected, of each text."""
    out = []
    for part in chunks(texts):
        for t in texts[part]:
            letters = bool(t) and any(map(str.isalpha, t))
            lang, score = known.predict(t) if letters and known.languages else ("und", 0.0)
            out.append((lang, score, not letters or bool(known.languages) and score < known.threshold))
    return out


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score, rejected.

    NULL texts and texts without a letter get ``und``, score 0, and are
    rejected; if no language was learned, others get ``und`` and are not. NULL
    ids, repeated rows and empty tables need no care. Only the two named columns
    are read.
    """
    stored = pickle.dumps(model)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _loaded(stored)
        for batch in batches:
            out = _judged(known, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_()),
            ], names=["id", "lang_pred", "score", "rejected"])

    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return pairs.mapInArrow(run, f"id {kind.simpleString()}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    stored, at = pickle.dumps(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _loaded(stored)
        for batch in batches:
            yield batch.filter(pa.array([not o[2] for o in _judged(known, batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
