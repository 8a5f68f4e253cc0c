"""Periodic run detection in word sequences (operator 13).

A run is a stretch of words with smallest period q, at least max(LEAST, TIMES * q)
long, that no neighbouring word extends. They are found by Karp-Miller-Rosenberg
naming: a name at level k stands for a block of 2^k words; a block's name comes
from the names of its halves, so equal names are equal blocks, without hashes and
without sorting suffixes. Blocks that occur once need no name of their own (they
equal nothing) and drop out of the next level, so ordinary prose ends after a few
levels and only repeated passages are named further.

In a run of period q at least `least` neighbouring places equal the place q words
on. Such a stretch holds a block of 2^k words at a place of a grid whose step is
least - 2^k + 1, wherever it lies. So for each q only grid places are compared,
by one look at their names, about n / q of them; those that agree are extended to
both sides by the longest common extension, going down the levels of names. All
texts of an Arrow batch are named and extended together as one array: the name of
a word holds its text's number, so no block equals one of another text. Multiples
of a period give the same stretch; the smallest one stays.

The work of a text of n words is about n log n; it lies where the text is read,
nothing is shuffled. Repeated rows and ties are rows like any others (each has
its own result); a null text has no words, an empty or blank one neither; an empty
table gives an empty result; extra columns are left out. A null id is never
rewritten.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import extended, table, texts

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: Words of texts that are named together, unless one text alone has more; candidates that are extended together.
TOGETHER, CHUNK = 1 << 17, 1 << 20


class Names(dict):
    """word -> number, by first occurrence."""

    def __missing__(self, word) -> int:
        self[word] = n = len(self)
        return n


def levels(first: np.ndarray) -> list[np.ndarray]:
    """The names of all levels: at level k, place i holds the name of the block
    of 2^k words from i on, or -1 if that block occurs only there (or ends beyond the array)."""
    out, half = [], 0
    alive, pair = np.arange(len(first)), first.astype(np.int64)
    while len(alive):
        _, name, count = np.unique(pair, return_inverse=True, return_counts=True)
        often = count[name] > 1
        alive, name = alive[often], name[often]
        if not len(alive):
            break
        level = np.full(len(first), -1, np.int32)
        level[alive] = name
        out.append(level)
        half = half * 2 or 1
        alive = alive[alive < len(first) - half]
        alive = alive[level[alive + half] >= 0]
        pair = level[alive].astype(np.int64) * (len(count) + 1) + level[alive + half]
    return out


def extended_right(names: list[np.ndarray], x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The first places from x on that differ from the place q words on."""
    size = len(names[0])
    for k in range(len(names) - 1, -1, -1):
        low = np.minimum(x, size - 1)
        a, b = names[k][low], names[k][np.minimum(x + q, size - 1)]
        x = x + (((a == b) & (a >= 0) & (x + q < size)).astype(np.int64) << k)
    return x


def extended_left(names: list[np.ndarray], x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The first place of the stretch before x whose places equal the places q words on."""
    for k in range(len(names) - 1, -1, -1):
        at = x - (1 << k)
        low = np.maximum(at, 0)
        a, b = names[k][low], names[k][np.minimum(low + q, len(names[0]) - 1)]
        x = np.where((a == b) & (a >= 0) & (at >= 0), at, x)
    return x


def grid(names: list[np.ndarray], longest: int, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (place, period) whose blocks at a grid place and a period further are equal."""
    size, places, periods, held = len(names[0]), [], [], 0
    for q in range(1, longest // times + 1):
        stretch = max(least, times * q) - q
        k = ((stretch + 1) // 2).bit_length() - 1
        if k >= len(names):
            # No block of that length occurs twice, and none of a greater one.
            break
        at = np.arange(0, size - q, stretch - (1 << k) + 1)
        own = names[k][at]
        at = at[(own == names[k][at + q]) & (own >= 0)]
        if len(at):
            places.append(at)
            periods.append(np.full(len(at), q))
            held += len(at)
        if held >= CHUNK:
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, held = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(periods)


def distinct_runs(found: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), the smallest period of each stretch, by start, then period."""
    order = np.lexsort((found[:, 2], found[:, 1], found[:, 0]))
    found = found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs(first: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """All runs of a sequence of names as rows (start, length, period); no text in it is longer than `longest`."""
    found = np.empty((0, 3), np.int64)
    names = levels(first) if len(first) else []
    for x, q in grid(names, longest, least, times) if names else ():
        start, end = extended_left(names, x, q), extended_right(names, x, q) + q
        keep = end - start >= np.maximum(least, times * q)
        found = distinct_runs(np.concatenate([found, np.stack([start, end - start, q], axis=1)[keep]]))
    return found


def periodic(doc_id: int, n: int) -> np.ndarray | None:
    """Of every tenth id: the places whose words stand at 0, 1, ... after the rewriting; else None."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a, i = g % n, np.arange(n)
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(i < a, i, a + (i - a) % p)


def batched(sizes: list[int]) -> list[list[int]]:
    """The texts' numbers in groups of similar length, of about TOGETHER words."""
    out, held = [[]], 0
    for k in sorted(range(len(sizes)), key=sizes.__getitem__):
        if held and held + sizes[k] > TOGETHER:
            out.append([])
            held = 0
        out[-1].append(k)
        held += sizes[k]
    return out


def text_runs(sequences: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """The runs of each sequence of words."""
    out: list = [np.empty((0, 3), np.int64)] * len(sequences)
    sizes = [len(s) for s in sequences]
    for group in batched(sizes):
        number = Names().__getitem__
        counts = np.array([sizes[k] for k in group], np.int64)
        begin = np.concatenate([[0], np.cumsum(counts)])
        flat = np.fromiter((number(w) for k in group for w in sequences[k]), np.int64, int(begin[-1]))
        owner = np.repeat(np.arange(len(group)), counts)
        found = runs(flat * len(group) + owner, int(counts.max(initial=0)), least, times)
        cut = np.searchsorted(found[:, 0], begin)
        for j, k in enumerate(group):
            mine = found[cut[j] : cut[j + 1]]
            if len(mine):
                out[k] = mine - np.array([begin[j], 0, 0])
    return out


def collapsed(sequence: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words without all repeats: of each run only the first period stays."""
    if not len(found):
        return sequence
    change = np.zeros(len(sequence) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return [sequence[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def found_runs(docs: DataFrame, rewrite: bool = False, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period) and collapsed (the
    text without the repeats, words joined by one space) of every row of docs
    (doc_id, text). `rewrite` first makes every tenth text periodic, by its id."""

    def made(b: pa.RecordBatch) -> list:
        # bytes.split cuts at the six white-space signs of the word rule and nothing else.
        sequences = [t.encode().split() for t in texts(b)]
        if rewrite:
            for k, key in enumerate(b.column("doc_id").to_pylist()):
                places = None if key is None else periodic(key, len(sequences[k]))
                if places is not None:
                    sequences[k] = [sequences[k][i] for i in places.tolist()]
        found = text_runs(sequences, least, times)
        rows = [[{"start": s, "length": n, "period": q} for s, n, q in f.tolist()] for f in found]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        kept = [b" ".join(collapsed(s, f)).decode() for s, f in zip(sequences, found, strict=True)]
        return [pa.array([len(s) for s in sequences], pa.int64()), pa.array(rows, kind), pa.array(kept, pa.string())]

    return extended(docs.select("doc_id", "text"), ["doc_id"], made, "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run, and digests of all runs and of the text without repeats, of every document."""
    rows = found_runs(table(spark, sf_dir, "documents"), rewrite=True)
    longest = "array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))"
    rows = rows.selectExpr("*", f"{longest} AS best")
    return rows.selectExpr(
        "doc_id",
        "n_words",
        "cast(size(runs) AS bigint) AS n_runs",
        "-best.start AS start",
        "best.length AS length",
        "-best.period AS period",
        "1000 * best.length div -best.period AS exponent_milli",
        "sha2(array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), ''), 256) AS runs_sha256",
        "sha2(collapsed, 256) AS collapsed_sha256",
    )


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT),
      lambda crc, b: list_reduce([xor(crc, b)] || range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h FROM documents
), e AS (
  SELECT *, len(w) AS n, (h // 10) % len(w) AS a, 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) AS p FROM d
), f AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM e
), t AS (
  SELECT r, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM f
), pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island
), runs AS (
  SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length
), told AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    arg_min(struct_pack(s := start, l := length, q := period), struct_pack(a := -length, b := start, c := period)) AS best FROM runs GROUP BY r
), dropped AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT t.r, string_agg(word, ' ' ORDER BY t.i) AS text FROM t ANTI JOIN dropped USING (r, i) GROUP BY t.r
)
SELECT doc_id, n AS n_words, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM f LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""
