"""Links between near copies: exact similarity of word shingles.

Two texts are linked if the Jaccard similarity of their sets of `width`-word
shingles (64-bit hashes) is at least `similarity`. A text of at most `width`
words is one shingle; texts without words have the same empty set.

Candidates come first from the SimHash search (see simhash): fingerprints that
the vantage-point trees connect. Each is confirmed by the sets themselves. 64
bits can't show all links of this similarity (at 0.8 two fingerprints differ in
about ten bits, where no tree prunes), so an exact join adds those that are left.

In the join all sets are put in one global order; two sets of that
similarity share a shingle among the first size - ceil(similarity * size) + 1 of
each (prefix filter), and behind their first common one enough must be left on
both sides (positional filter, which holds the length filter). Shingles that a
sample of texts shows to be common come last in the order, so prefixes hold rare
ones; the sample steers only the cost, any order gives the same links.

Links are wanted for components only. So after the SimHash links each set is
compared with one head of the groups of its shingles (STARS rounds, with other
heads each); then all pairs that share a prefix shingle and are not yet in one
component are, as far as bit maps of both sets, which go along, show few enough
differences. Large groups of near
copies thus cost no pairs of their own, equal sets meet as one, and of shingles
that the very same sets hold one is looked at. Shingles of
very many rows are counted by partial aggregation and joined by broadcast.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, dropped, extended, joined_hot, released, stored, texts
from .components import components

WIDTH, SIMILARITY, SEED = 5, 0.8, 42
SAMPLE_ROWS, COMMON_ROWS, COMMON, STARS, LONGS = 4000, 2, 100_000, 2, 16


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The XXH64 hashes of the text's word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and [\x20\x09-\x0D] exactly
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The SimHash: a bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The ascending distinct hashes of the text's word shingles."""
    return np.unique(shingle_hashes(text, width))


def row_mark(docs: DataFrame) -> Column:
    """128 bits of hashes of all columns, nulls told from missing places; maps, which have no hash, count as JSON."""
    whole = [F.to_json(F.struct(docs[f.name])) if "map<" in f.dataType.simpleString() else docs[f.name] for f in docs.schema]
    whole += [c.isNull() for c in whole]
    # What comes first changes the whole hash; what comes last would only hash the first 64 bits again.
    return F.struct(F.xxhash64(*whole).alias("m1"), F.xxhash64(F.lit("second"), *whole).alias("m2"))


def told_apart(found: DataFrame) -> DataFrame:
    """Sets with a key of their own each: `found` has a row for every (key, key2);
    where sets share the first 64 bits, the key is made of both."""
    clash = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("clash"))
    if clash.isEmpty():
        return found.drop("key2")
    key = F.when(F.col("clash"), F.xxhash64("key2", "key")).otherwise(F.col("key"))
    return found.join(clash, "key", "left").withColumn("key", key).drop("key2", "clash")


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """At most COMMON shingles that several of about SAMPLE_ROWS distinct texts hold."""
    every = max(1, docs.count() // SAMPLE_ROWS)
    sample = docs.select("text").where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(every)) == 0).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"shingle": np.concatenate([np.empty(0, np.uint64), *(shingles(t, width) for t in b["text"])]).view(np.int64)})

    counts = sample.mapInPandas(run, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_ROWS)
    found = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle").toPandas()["shingle"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def sets(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """key (hash of the set, told apart by 128 bits), size, prefix, odd (a bit for each bucket of hashes
    that holds an odd number), fp (a SimHash) and best (the row with the smallest
    doc_id, nulls last, as a struct with its mark) of every distinct set."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width))

    def made(b: pa.RecordBatch) -> list:
        held = np.append(shared.value, np.uint64(2**64 - 1))
        rows = []
        for t in texts(b):
            every = shingle_hashes(t, width)
            s = np.unique(every)
            common = held[np.searchsorted(held, s)] == s
            upto = len(s) - math.ceil(similarity * len(s) - 1e-9) + 1
            prefix = np.concatenate((s[~common], s[common]))[:upto]
            odd = np.packbits(np.bincount((s % np.uint64(64 * LONGS)).astype(np.int64), minlength=64 * LONGS) & 1)
            whole = xxhash.xxh3_128_intdigest(s.tobytes(), SEED)
            rows.append((whole >> 64, whole & (1 << 64) - 1, len(s), prefix.view(np.int64), odd.view(np.int64), majority(every)))
        key, key2, size, prefix, odd, fp = zip(*rows, strict=True) if rows else [()] * 6
        signed = lambda x: np.array(x, np.uint64).view(np.int64)
        return [signed(key), signed(key2), pa.array(size, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())), signed(fp)]

    rows = docs.select("doc_id", "text", row_mark(docs).alias("mark"))
    rows = extended(rows, ["doc_id", "mark"], made, "key bigint, key2 bigint, size int, prefix array<bigint>, odd array<bigint>, fp bigint")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("best")
    released(docs.sparkSession)
    found = stored(rows.groupBy("key", "key2").agg(*(F.any_value(c).alias(c) for c in ("size", "prefix", "odd", "fp")), best))
    return told_apart(found)


def near_enough(a: Column, b: Column, similarity: float) -> Column:
    """Whether two sets (structs with size and odd) may differ in few enough
    shingles: every bit of `odd` that differs stands for one that only one has."""
    differing = sum((F.bit_count(F.get(a["odd"], F.lit(k)).bitwiseXOR(F.get(b["odd"], F.lit(k)))) for k in range(LONGS)), F.lit(0))
    return differing <= (1 - similarity) / (1 + similarity) * (a["size"] + b["size"]) + 1e-6


def possible(pairs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets may differ in few enough shingles."""
    left, right = (found.select(F.col("key").alias(k), F.struct("size", "odd").alias(f"{k}_set")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").where(near_enough(F.col("a_set"), F.col("b_set"), similarity)).select("a", "b")


def confirmed(pairs: DataFrame, docs: DataFrame, found: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough. Only texts of these
    pairs leave the documents; the tables stored tell Spark how few they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Texts leave the Arrow batch one pair at a time: a batch of long ones is held once.
            left, right, ok = b.column("x"), b.column("y"), np.zeros(b.num_rows, bool)
            for k in range(b.num_rows):
                s, t = shingles(left[k].as_py(), width), shingles(right[k].as_py(), width)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok[k] = both >= similarity * (len(s) + len(t) - both) - 1e-9
            yield b.select(["a", "b"]).filter(pa.array(ok))

    pairs = stored(possible(pairs, found, similarity))
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    marks = stored(found.join(keys, "key").select("key", F.col("best.mark").alias("mark")))
    own = docs.select("text", row_mark(docs).alias("mark")).join(marks, "mark").dropDuplicates(["mark"])
    left, right = (own.select(F.col("key").alias(k), F.col("text").alias(t)) for k, t in (("a", "x"), ("b", "y")))
    out = stored(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"))
    dropped(pairs, marks)
    return out


def joined_shingles(left: DataFrame, right: DataFrame, total: int) -> DataFrame:
    """joined_hot by shingle with a stored `right` that counts left's rows as n.
    The keys broadcast are fewer than HOT, so the other rows are told from a list
    of them, by no join; where no key is that common there is but one join."""
    hot = right.where(F.col("n") * HOT > total).drop("n")
    common = [r["shingle"] for r in hot.select("shingle").collect()]
    rest = left.where(~F.col("shingle").isin(common)).join(right.where(F.col("n") * HOT <= total).drop("n").hint("merge"), "shingle")
    return left.join(F.broadcast(hot), "shingle").unionByName(rest) if common else rest


def told_once(held: DataFrame, total: int) -> DataFrame:
    """The rows (key, size, place, shingle) of one shingle for all that the very
    same sets hold: the first in the global order. A passage is many shingles of
    the same sets; two sets' first common shingle is always the one that stays,
    for the shingles before it have other sets."""
    mark = (F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"m{k}") for k in (1, 2))
    # Of two shingles with the same sets the first in the order has the smaller place in each.
    members = held.groupBy("shingle").agg(F.count("*").alias("n"), *mark, F.min("place").alias("place"))
    first = stored(members.groupBy("n", "m1", "m2").agg(F.min(F.struct("place", "shingle")).alias("first")).select("first.shingle", "n"))
    out = stored(joined_shingles(held, first, total))
    dropped(first)
    return out


def seeds(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, b) of set keys from the connected fingerprints (a, b): the heads
    of both, and each set with the head of its own fingerprint."""
    heads = stored(found.groupBy("fp").agg(F.min("key").alias("head"), F.count("*").alias("n")))
    same = joined_hot(found.select("key", "fp"), heads, "fp", "n", found.count()).where("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b"))
    one, two = (heads.select(F.col("fp").alias(k), F.col("head").alias(f"{k}_head")) for k in "ab")
    across = edges.join(one, "a").join(two, "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    both = same.unionByName(across)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(docs: DataFrame, found: DataFrame, first: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """Edges (a, b) that connect all links between the sets `found` of docs; the
    pairs (a, b) of `first` are tried before the join."""
    places = found.select("key", "size", F.posexplode("prefix").alias("place", "shingle"))
    counts = places.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    counts = stored(counts)
    released(docs.sparkSession)
    total = counts.agg(F.sum("n")).first()[0] or 0
    held = stored(joined_shingles(places, counts, total))
    released(docs.sparkSession)
    shared = told_once(held, total)
    dropped(held, counts)
    released(docs.sparkSession)
    total = shared.count()

    def fits(a: str, b: str) -> Column:
        need = similarity / (1 + similarity) * (F.col(f"{a}.size") + F.col(f"{b}.size")) - 1e-9
        return F.least(*(F.col(f"{x}.size") - F.col(f"{x}.place") for x in (a, b))) >= need

    me = F.struct("key", "size", "place", "root")
    pair = [F.least("p.key", "q.key").alias("a"), F.greatest("p.key", "q.key").alias("b")]
    pairs = stored(first)
    tried, edges = [pairs], [confirmed(pairs, docs, found, width, similarity)]
    for k in range(STARS + 1):
        group = components(functools.reduce(DataFrame.unionByName, edges))
        released(docs.sparkSession)
        named = shared.join(group, shared["key"] == group["node"], "left").select(shared["*"], F.coalesce("root", "key").alias("root"))
        order = F.struct(F.xxhash64("key", F.lit(k)), "key")
        spread = named.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by(me, order).alias("q"), F.count("*").alias("n"))
        spread = stored(spread.where("low <> high").drop("low", "high"))
        if k < STARS:
            pairs = joined_shingles(named.select("shingle", me.alias("p")), spread, total)
            # One head a set: as many pairs as sets, however large the groups are.
            pairs = pairs.where((F.col("p.root") != F.col("q.root")) & fits("p", "q"))
            pairs = pairs.groupBy(F.col("p.key").alias("__key")).agg(F.min_by(F.struct("p", "q"), F.struct(F.xxhash64("q.key", F.lit(k)), "q.key")).alias("x")).select("x.p", "x.q")
        else:
            named = joined_shingles(named, spread.drop("q"), total)
            named = stored(named.join(found.select("key", "odd"), "key").select("shingle", F.struct("key", "size", "place", "root", "odd").alias("p")))
            pairs = named.join(named.select("shingle", F.col("p").alias("q")), "shingle").where("p.root < q.root").where(near_enough(F.col("p"), F.col("q"), similarity))
        pairs = pairs.where((F.col("p.root") != F.col("q.root")) & fits("p", "q")).select(*pair).distinct()
        for old in tried:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        tried.append(pairs := stored(pairs))
        edges.append(confirmed(pairs, docs, found, width, similarity))
        dropped(spread, *([named] if k == STARS else []))
        released(docs.sparkSession)
    out = stored(functools.reduce(DataFrame.unionByName, edges))
    dropped(shared, *tried, *edges)
    return out
