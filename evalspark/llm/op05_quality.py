"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader updates, scored as sparse dot products.

Features are words, runs of other visible characters, and neighbouring pairs of both,
hashed to ``2 ** bits`` weights; a text is the unit-length vector of 1 + log(count).
The model is trained in one task on a bounded sample of the labelled rows (parameter
``max_train``, the labels with the smallest hash of their id), so its size and training
time do not grow; every row is scored, in place, with the broadcast weights
(``2 ** bits`` floats)."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import spare

PARTS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
BLOCK = 1 << 20
REPEAT = zlib.crc32(b"\0again")  # every pair of equal parts is this one bigram


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers and values (unit length) of a whole text; none if it has no words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    mask, crc = (1 << bits) - 1, zlib.crc32
    seen = np.zeros(0, np.int64)
    counts = np.zeros(0, np.int64)
    last = b""
    for at in _blocks(raw):
        parts = PARTS.findall(at)
        pairs = [crc(b, crc(a)) if a != b else REPEAT for a, b in zip([last, *parts], parts)]
        last = parts[-1] if parts else last
        ids = np.array([crc(p) for p in parts] + pairs, dtype=np.int64) & mask
        idx, n = np.unique(ids, return_counts=True)
        if len(seen):
            idx, inv = np.unique(np.concatenate([seen, idx]), return_inverse=True)
            n = np.bincount(inv, weights=np.concatenate([counts, n])).astype(np.int64)
        seen, counts = idx, n
    if not len(seen):
        return seen, np.zeros(0)
    x = 1.0 + np.log(counts)
    return seen, x / np.sqrt((x * x).sum())


def _blocks(raw: bytes):
    """The text in blocks of about a megabyte, cut at white space where there is any."""
    at = 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        if end < len(raw):
            space = max(raw.rfind(b" ", at + 1, end), raw.rfind(b"\n", at + 1, end))
            end = space if space > at else end
        yield raw[at:end]
        at = end


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with L1 and L2 terms; the last
    coordinate is the intercept."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, idx) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, idx: np.ndarray, x: np.ndarray, y: float) -> None:
        idx, x = np.append(idx, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(idx)
        g = (_sigmoid(float(w @ x)) - y) * x
        sigma = (np.sqrt(self.n[idx] + g * g) - np.sqrt(self.n[idx])) / self.alpha
        self.z[idx] += g - sigma * w
        self.n[idx] += g * g


def _sigmoid(m: float) -> float:
    return float(1 / (1 + np.exp(-min(max(m, -35.0), 35.0))))


def train(labelled: DataFrame, id_col: str, text_col: str, label_col: str, bits: int = 18,
          max_train: int = 16_384, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0,
          l1: float = 1e-4, l2: float = 1e-6) -> np.ndarray:
    """Weights (``2 ** bits`` and the intercept). Rows without a label are left out.
    At most ``max_train`` labelled rows are used, those with the smallest hash of id
    and text, in that order. No rows: all weights are zero."""
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    sample = (labelled.where(F.col(label_col).isNotNull())
              .select(key.alias("k"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("double").alias("y"))
              .orderBy("k").limit(max_train))

    def fit(batches):
        import pyarrow as pa

        rows = []
        for b in batches:
            rows += [(*features(t, bits), y) for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist())]
        model = Ftrl(bits, alpha, beta, l1, l2)
        for _ in range(epochs):
            for idx, x, y in rows:
                model.update(idx, x, y)
        w = model.weights(np.arange(len(model.z)))
        idx = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(w[idx])], ["i", "w"])

    got = sample.coalesce(1).mapInArrow(fit, "i bigint, w double").toArrow()
    w = np.zeros((1 << bits) + 1)
    w[got.column("i").to_numpy()] = got.column("w").to_numpy()
    return w


def with_score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for every whole text. Null and empty
    texts have no features: their score is the intercept's."""
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def probability(text: pd.Series) -> pd.Series:
        w = shared.value
        out = []
        for t in text:
            idx, x = features(t, bits)
            out.append(_sigmoid(float(w[idx] @ x) + float(w[-1])))
        return pd.Series(out, dtype="float64")

    return docs.withColumn(out, F.pandas_udf(probability, "double")(F.col(text_col).cast("string")))


def held_out(id_col: str, folds: int = 5):
    """True for the fold that is never trained on: crc32 of the id as text is divisible
    by ``folds`` (a null id counts as the empty text, so it is held out)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", max_train: int = 16_384, **kw) -> np.ndarray:
    """Train on labelled documents that are not held out: of the labels, the ``max_train``
    with the smallest hash of their id are drawn first, so only that many texts move."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y")))  # contradicting labels: the lower one
    drawn = known.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    rows = docs.select(id_col, text_col).join(F.broadcast(drawn), F.col(id_col) == F.col("_id"))
    return train(rows, id_col, text_col, "_y", max_train=max_train, **kw)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", threshold: float = 0.3, **kw) -> DataFrame:
    """Per document: id, ``held_out``, ``score``, ``predicted``."""
    weights = fit_quality(docs, labels, id_col, text_col, label_col, **kw)
    return (with_score(docs.select(id_col, text_col), weights, text_col)
            .select(id_col, held_out(id_col).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     label_col: str = "quality", threshold: float = 0.3, **kw) -> DataFrame:
    """The rows of ``docs`` the classifier accepts, with all their columns, whatever their names.

    Every row is judged by its text alone: null and empty texts have one score (that of no words), repeated
    rows stay or go together, ids are not looked at. An empty table gives an empty result."""
    weights, score = fit_quality(docs, labels, id_col, text_col, label_col, **kw), spare("_quality_score", docs)
    return with_score(docs, weights, text_col, out=score).where(F.col(score) >= threshold).drop(score)
