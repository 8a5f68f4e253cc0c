"""Quality by naive Bayes support vectors (operator 8).

Features are indicators of n-grams: words, word pairs, word outlines (letter
case, digits and signs), outline pairs and triples, and runs of one repeated
word, hashed to 2**BITS. Each indicator is scaled by the log ratio of its
smoothed counts in the two classes; a linear hinge-loss model is then fitted to
the scaled vectors by dual coordinate descent, and a logistic curve over the
margins of rows that were left out turns margins into scores. It is fitted on a
bounded sample of labelled rows; the product of ratio and weight, one number a
feature, is broadcast. Rows are scored where they are read: no shuffle.

Only rows outside the held-out fold are learnt from, and only texts are looked
at. Features in fewer than MIN_ROWS examples have no weight. Null and empty
texts have the score of the bias alone; repeated rows are scored alike; without
labelled rows of both classes every score is 0.5. If no feature got a weight (no
such rows, or too few), every text has the same score, and `good` keeps them all.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .features import MIX, SAMPLE_ROWS, as_bytes, fitted, fold, hasher, kept, key, labelled, logistic, scored, shape, sigmoid, table

BITS, FOLDS, HELD_OUT, THRESHOLD = 18, 4, 2, 0.7
SMOOTH, COST, PASSES, MIN_ROWS = 1.0, 0.01, 12, 5


def word_hash(word: str) -> bytes:
    return as_bytes(key(word.lower()), key("\t" + shape(word)))


class Features:
    """The n-gram hashes of a text."""

    def __call__(self, text: str) -> np.ndarray:
        h = hasher(word_hash, 2).hashes(text)
        w, s = h[:, 0], h[:, 1]
        same = w[:-1] == w[1:]
        runs = same[:-2] & same[1:-1] & same[2:]  # four equal words in a row
        grams = [w * MIX[0], w[:-1] * MIX[1] + w[1:] * MIX[2], s * MIX[0], s[:-1] * MIX[1] + s[1:] * MIX[2], s[:-2] * MIX[1] + s[1:-1] * MIX[2] + s[2:] * MIX[3]]
        return np.concatenate((*grams, np.full(int(runs.any()), MIX[3])))


def fit(examples: list[np.ndarray], y: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, float]:
    """(weight of each feature, bias): score = sigmoid(sum of weights + bias)."""
    size = 1 << bits
    if len(set(y.tolist())) < 2:
        return np.zeros(size, np.float32), 0.0
    order = np.random.default_rng(11)
    place = order.permutation(len(examples))
    apart, learnt = place[: len(place) // 5], place[len(place) // 5 :]
    counts = np.full((2, size), SMOOTH)
    for k in learnt:
        counts[y[k], examples[k]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[counts.sum(axis=0) < MIN_ROWS + 2 * SMOOTH] = 0
    sign = 2 * y - 1
    # The rarer class weighs as much as the other.
    share = np.bincount(y[learnt], minlength=2) / len(learnt)
    most = COST * 0.5 / np.maximum(share[y], 1e-9)
    w, b, dual = np.zeros(size), 0.0, np.zeros(len(examples))
    square = np.array([float((ratio[f] ** 2).sum()) + 1 for f in examples])
    for _ in range(PASSES):
        for k in order.permutation(learnt):
            f = examples[k]
            r = ratio[f]
            slope = sign[k] * (float(w[f] @ r) + b) - 1
            new = min(max(dual[k] - slope / square[k], 0.0), most[k])
            step = (new - dual[k]) * sign[k]
            if step:
                dual[k] = new
                w[f] += step * r
                b += step
    weight = (w * ratio).astype(np.float32)
    margin = np.array([weight[examples[k]].sum(dtype=np.float64) + b for k in apart])
    a, c = logistic(margin, y[apart])
    return (weight * a).astype(np.float32), float(b * a + c)


class Model:
    """score(text) from broadcast weights."""

    def __init__(self, spark: SparkSession, weights: np.ndarray, bias: float, bits: int):
        self.shared, self.bits, self.features = spark.sparkContext.broadcast((weights, bias)), bits, Features()
        self.learnt = bool(weights.any())

    def __call__(self, text: str) -> float:
        weights, bias = self.shared.value
        f = fold(self.features(text), self.bits)
        f = np.unique(f[weights[f] != 0])
        return sigmoid(weights[f].sum(dtype=np.float64) + bias)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, bits: int = BITS) -> Model:
    """The model of labels.quality, from at most about `rows` labelled rows of docs."""
    sample = labelled(docs, labels, "quality", FOLDS, HELD_OUT, rows)
    return Model(docs.sparkSession, *fitted(sample, Features(), bits, MIN_ROWS, functools.partial(fit, bits=bits)), bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    return scored(docs, model, FOLDS, HELD_OUT, THRESHOLD)


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are predicted to be of low quality; all of docs
    if the labels taught nothing that tells texts apart."""
    model = train(docs, labels)
    return kept(docs, model, lambda s: s >= THRESHOLD) if model.learnt else docs


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
