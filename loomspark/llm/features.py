"""Hashed n-gram indicators and the labelled sample that classifiers are fitted on."""

from __future__ import annotations

import functools
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, crc_fold, dropped, extended, stored, table, texts

#: Labelled rows that a classifier is fitted on at most (drawn by a hash of the id).
SAMPLE_ROWS = 8_000
#: Bytes of their features, four a feature, that the fit holds at most.
SAMPLE_BYTES = 192 << 20
#: Words that a worker keeps hashed, in each of two generations.
CACHED_WORDS = 60_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))


def key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode())


def fold(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.uint32)


def shape(word: str) -> str:
    """The word's outline: runs of capitals, small letters and digits as A, a, 0, other signs as they are."""
    out = re.sub(r"\d+", "0", word[:64])
    return re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a", out)


class Hasher:
    """Turns a text into the array of its words' hashes (with repeats), `width` numbers a word."""

    def __init__(self, make: Callable[[str], bytes], width: int):
        self.words, self.width = WordCache(make, CACHED_WORDS), width

    def hashes(self, text: str) -> np.ndarray:
        flat = np.frombuffer(b"".join(map(self.words.__getitem__, text.split())), np.uint64)
        return flat.reshape(-1, self.width)


@functools.cache
def hasher(make: Callable[[str], bytes], width: int) -> Hasher:
    """The worker's hasher for a word function: its bounded cache serves all tasks of the worker."""
    return Hasher(make, width)


def as_bytes(*hashes: int) -> bytes:
    return np.array(hashes, np.uint64).tobytes()


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, y, h of the labelled documents outside the held-out fold; h is a hash of id, text and label.

    Where there are more than `rows` labels, a share drawn by a hash of the id
    remains: the same rows in every run, of all sources and parts of the table.
    Each id with a 0 or 1 is an example; null labels are not. An id may stand
    before many documents: if more than `rows` documents have a label, a share
    drawn by `h` remains of them.
    """
    own = labels.where(crc_fold("doc_id", folds) != held_out).where(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("label_id"), F.col(label).alias("y")).distinct()
    n = own.count()
    drawn = F.pmod(F.xxhash64(F.col("label_id"), F.lit(label)), F.lit(max(1, n)))
    # At most `rows` pairs of numbers, so they may be broadcast whatever the table's size.
    own = F.broadcast(own.where(drawn < rows).orderBy(drawn, "label_id", "y").limit(rows))
    found = docs.select("doc_id").join(own, F.col("doc_id") == F.col("label_id")).count()
    h = F.xxhash64("doc_id", "text", "y")
    out = docs.select("doc_id", "text").join(own, F.col("doc_id") == F.col("label_id")).select("text", "y", h.alias("h"))
    return out.where(F.pmod("h", F.lit(found)) < rows).dropDuplicates(["h"]) if found > rows else out


def bounded(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """The examples (y, f, h), each once, in the order of their hash as long as
    there are at most so many and their features have so many bytes. At most
    most_rows pairs of numbers come to the driver."""
    first = rows.groupBy("h").agg(F.max(F.length("f")).alias("size")).orderBy("h").limit(most_rows).collect()
    total, last = 0, None
    for r in first:
        total += r["size"]
        if total > most_bytes and last is not None:
            break
        last = r["h"]
    return rows.where(F.col("h") <= F.lit(last)).dropDuplicates(["h"])


def fitted(sample: DataFrame, features: Callable[[str], np.ndarray], bits: int, least: int, fit: Callable, most_rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES):
    """fit(examples, labels) of the sample (text, y, h): each example's distinct
    features, those of fewer than `least` examples left out. Repeated rows are
    one example.

    Features are found where the texts are; the fit is one task over a sample of
    at most most_rows examples and most_bytes bytes of features, so only the
    model comes to the driver.
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"].astype("int32"), "f": [np.unique(fold(features(t or ""), bits)).tobytes() for t in b["text"]], "h": b["h"]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((f, int(y)) for b in batches for f, y in zip(b["f"], b["y"], strict=True))
        examples, count = [np.frombuffer(f, np.uint32) for f, _ in rows], np.zeros(1 << bits, np.int64)
        for f in examples:
            count[f] += 1
        model = fit([f[count[f] >= least] for f in examples], np.array([y for _, y in rows], np.int64))
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    rows = stored(sample.mapInPandas(found, "y int, f binary, h bigint"))
    got = bounded(rows, most_rows, most_bytes).select("y", "f").coalesce(1).mapInPandas(learn, "model binary").first()
    dropped(rows)
    return fit([], np.empty(0, np.int64)) if got is None else pickle.loads(got["model"])


def scored(docs: DataFrame, score: Callable[[str], float], folds: int, held_out: int, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text)."""

    def made(b: pa.RecordBatch) -> list:
        s = [score(t) for t in texts(b)]
        return [s, pa.array([int(x >= threshold) for x in s], pa.int32())]

    rows = docs.select("doc_id", "text", (crc_fold("doc_id", folds) == held_out).alias("held_out"))
    return extended(rows, ["doc_id", "held_out"], made, "score double, predicted int")


def kept(docs: DataFrame, score: Callable[[str], float], passes: Callable[[float], bool]) -> DataFrame:
    """The rows of docs whose text's score passes, scored where they are read;
    all columns stay as they are, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([passes(score(t)) for t in texts(b)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over the margins (Newton steps, slightly smoothed targets)."""
    good, bad = int(y.sum()), int(len(y) - y.sum())
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = float(np.abs(margin).mean()) or 1.0
    x = np.stack([margin / scale, np.ones(len(margin))], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    return max(float(beta[0]) / scale, 1e-6), float(beta[1])


__all__ = ["MIX", "as_bytes", "fitted", "fold", "hasher", "kept", "key", "labelled", "logistic", "scored", "shape", "sigmoid", "table"]
