"""Toxicity by FTRL-proximal logistic regression (operator 9).

Features are indicators of words, their first five and seven letters (for
inflected and compound words), word pairs and skip-grams (a word and the second
next), hashed to 2**BITS. The learner goes through a bounded sample of
labelled rows a few times; each coordinate has its own learning rate, and the
L1 term keeps a weight at zero until its evidence is large, so the weights that
are broadcast are few: sorted features and values, at most 2**BITS of them.
A logistic curve over the margins of
a fifth of the sample, left out of the learning, turns margins into scores.
Rows are scored where they are read: no shuffle.

Only rows outside the held-out fold are learnt from, and only texts are looked
at; features in fewer than MIN_ROWS examples have no weight. Words are
lower-cased and stripped of signs at both ends. Null and empty texts have the score of the bias alone; repeated rows are scored alike; without
labelled rows every score is 0.5.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .features import MIX, SAMPLE_ROWS, as_bytes, fitted, fold, hasher, kept, key, labelled, logistic, scored, sigmoid, table

BITS, FOLDS, HELD_OUT, THRESHOLD = 20, 3, 1, 0.7
#: Chosen by folds inside the rows that may be learnt from.
ALPHA, BETA, L1, L2, PASSES, MIN_ROWS = 3.0, 1.0, 5.0, 0.3, 8, 5
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”‘’„…–—"


def word_hash(word: str) -> bytes:
    plain = word.lower().strip(SIGNS)
    return as_bytes(key(plain), key("^" + plain[:5]), key("^" + plain[:7]))


class Features:
    """The n-gram and skip-gram hashes of a text."""

    def __call__(self, text: str) -> np.ndarray:
        h = hasher(word_hash, 3).hashes(text)
        w = h[:, 0]
        return np.concatenate((w * MIX[0], h[:, 1] * MIX[0], h[:, 2] * MIX[0], w[:-1] * MIX[1] + w[1:] * MIX[2], w[:-2] * MIX[3] + w[2:] * MIX[1]))


def fit(examples: list[np.ndarray], y: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) of the weights that are not zero."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias, bias_n = 0.0, 0.0
    order = np.random.default_rng(5)
    place = order.permutation(len(examples))
    apart, learnt = place[: len(place) // 5], place[len(place) // 5 :]
    for _ in range(PASSES):
        for k in order.permutation(learnt):
            f = examples[k]
            zf, nf = z[f], n[f]
            w = np.where(np.abs(zf) <= L1, 0.0, -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(nf)) / ALPHA + L2))
            g = sigmoid(w.sum() + bias) - y[k]
            root = np.sqrt(nf + g * g)
            z[f] = zf + g - (root - np.sqrt(nf)) / ALPHA * w
            n[f] = nf + g * g
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    slope, offset = logistic(np.array([w[examples[k]].sum() + bias for k in apart]), y[apart])
    at = np.flatnonzero(w).astype(np.uint32)
    return at, w[at] * slope, bias * slope + offset


class Model:
    """score(text) from broadcast weights."""

    def __init__(self, spark: SparkSession, at: np.ndarray, weights: np.ndarray, bias: float, bits: int):
        self.shared, self.bits, self.features, self.table = spark.sparkContext.broadcast((at, weights, bias)), bits, Features(), None

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def __call__(self, text: str) -> float:
        if self.table is None:
            at, weights, self.bias = self.shared.value
            self.table = np.zeros(1 << self.bits, np.float32)
            self.table[at] = weights
        f = fold(self.features(text), self.bits)
        f = np.unique(f[self.table[f] != 0])
        return sigmoid(self.table[f].sum(dtype=np.float64) + self.bias)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, bits: int = BITS) -> Model:
    """The model of labels.toxic, from at most about `rows` labelled rows of docs."""
    sample = labelled(docs, labels, "toxic", FOLDS, HELD_OUT, rows)
    return Model(docs.sparkSession, *fitted(sample, Features(), bits, MIN_ROWS, functools.partial(fit, bits=bits)), bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    return scored(docs, model, FOLDS, HELD_OUT, THRESHOLD)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are predicted toxic."""
    return kept(docs, train(docs, labels), lambda s: s < THRESHOLD)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
