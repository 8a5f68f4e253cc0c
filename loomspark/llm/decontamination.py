"""Benchmark decontamination by winnowing (operator 12).

A window is `width` consecutive words of a benchmark item (all its words, if they
are fewer); every word of a document inside an occurrence of a window is hit.

Documents and items are winnowed alike: of the hashes of all k-grams in every
`width` consecutive words the smallest is kept as a fingerprint (several, if
equal). Two texts that share a window share its smallest k-gram, at the same
place of the window, so every window is found through a fingerprint that lies in
it; about two of seven k-grams are kept. A fingerprint carries the words around
it that a window through it can hold (`width - k` on either side). Documents and
items are joined by fingerprint, the k-gram's words are compared, and the hit is
extended word by word to both sides: as long as the shared span is a window
long, all of it is hit. Nothing rests on a hash alone.

Items shorter than `width` have windows of their own length, with k-grams and
fingerprints of their own; the lengths are at most `width` many.

Scale: documents are read once and their texts are never shuffled. The tasks that
winnow them keep only fingerprints whose bits stand in a map of the benchmark's
fingerprints; the map has a bounded size and is not used for more than MAPPED
fingerprints, where all of a document's fingerprints go to the join. The join's
benchmark side is a stored table, which Spark broadcasts if it is small and
shuffles otherwise, adaptively split where a passage is hot. Equal fingerprints
with equal surroundings are one row of that side, whatever number of items share
them, and documents meet the items only after equal hits were made one.

Null texts and texts without words have no windows and hit nothing. Items are
told apart by id: rows that repeat an id are one item, and a null id is an item
whose id is written as the empty text. Repeated rows of documents have a result
each; extra columns are left out; empty tables give no rows or no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, stored, table, texts

WIDTH, GRAM = 10, 5
#: Fingerprints of the benchmark up to which their bits are sent to the documents' tasks, bits a fingerprint at least, and the map's smallest size.
MAPPED, BITS_EACH, LEAST_BITS = 4_000_000, 16, 1 << 20
#: Words that a task keeps hashed, in each of two generations.
CACHED_WORDS = 100_000
#: The word rule on UTF-8 bytes after A-Z became a-z (bytes.lower() changes no other sign).
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PRINTS = "array<struct<print:bigint,at:bigint,gram:array<string>,before:array<string>,after:array<string>>>"


def words(text: str) -> list[bytes]:
    return WORDS.findall(text.encode().lower())


def gram_hashes(hashes: np.ndarray, k: int, span: int) -> np.ndarray:
    """One hash for each k words in a row, of words' hashes; other spans have other hashes."""
    n = len(hashes) - k + 1
    out = np.full(n, span * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : j + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return out


def winnowed(grams: np.ndarray, w: int) -> np.ndarray:
    """The places that hold the smallest of some w hashes in a row (all of the smallest ones)."""
    least, done = grams, 1
    while done < w:
        step = min(done, w - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    # least[j] is the smallest of window j; a place is kept if the largest of its windows' is its own.
    most, done = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), 1
    while done < w:
        step = min(done, w - done)
        most = np.maximum(most[:-step], most[step:])
        done += step
    return np.flatnonzero(most == grams)


class Winnower:
    """Finds the fingerprints of texts for a set of window lengths."""

    def __init__(self, spans: list[int], gram: int = GRAM, bits: np.ndarray | None = None):
        self.spans, self.gram, self.bits = spans, gram, bits
        self.shift = np.uint64(64 - (8 * len(bits)).bit_length() + 1) if bits is not None else None
        self.hashes = WordCache(xxhash.xxh3_64_intdigest, CACHED_WORDS)

    def prints(self, found: list[bytes], spans: list[int]) -> list[dict]:
        if not spans or len(found) < min(spans):
            return []
        hashes = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))
        out, n = [], len(found)
        for span in spans:
            if n < span:
                continue
            k = min(self.gram, span)
            grams = gram_hashes(hashes, k, span)
            at = winnowed(grams, span - k + 1)
            mine = grams[at]
            if self.bits is not None:
                place = mine >> self.shift
                there = self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0
                at, mine = at[there], mine[there]
            text = lambda a, b: [x.decode() for x in found[max(0, a) : b]]
            for i, h in zip(at.tolist(), mine.view(np.int64).tolist(), strict=True):
                # The words before stand nearest first.
                out.append({"print": h, "at": i, "gram": text(i, i + k), "before": text(i - span + k, i)[::-1], "after": text(i + k, i + span)})
        return out


def fingerprints(docs: DataFrame, key: str, made: Winnower, whole: int | None = None) -> DataFrame:
    """row (a number of its own), the key column, n_words, span and prints of
    every text. With `whole`, texts of fewer words than `whole` have windows of
    their own length; otherwise all lengths of `made` are looked for."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        arrow = pa.list_(pa.struct([("print", pa.int64()), ("at", pa.int64()), *((c, pa.list_(pa.string())) for c in ("gram", "before", "after"))]))
        for b in batches:
            found = [words(t) for t in texts(b)]
            spans = [made.spans if whole is None else [min(whole, len(f))] if f else [] for f in found]
            prints = pa.array([made.prints(f, s) for f, s in zip(found, spans, strict=True)], arrow)
            rows = pa.array(range(number, number + len(found)), pa.int64())
            own = pa.array([s[0] if whole is not None and s else 0 for s in spans], pa.int64())
            number += len(found)
            yield pa.RecordBatch.from_arrays([rows, b.column(key), pa.array([len(f) for f in found], pa.int64()), own, prints], names=["row", key, "n_words", "span", "prints"])

    return docs.select(key, "text").mapInArrow(run, f"row bigint, {key} {kind}, n_words bigint, span bigint, prints {PRINTS}")


def bit_map(prints: DataFrame, count: int) -> np.ndarray | None:
    """The benchmark's fingerprints as bits at the places of their first digits,
    null if they are more than MAPPED (so at most that many numbers come to the driver)."""
    if count > MAPPED:
        return None
    size = max(LEAST_BITS, 1 << (BITS_EACH * count).bit_length())
    place = F.shiftrightunsigned("print", 65 - size.bit_length()).cast("int").alias("place")
    bits = np.zeros(size >> 3, np.uint8)
    at = prints.select(place).distinct().toArrow().column("place").to_numpy()
    np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return bits


def common_start(a: Column, b: Column) -> Column:
    """How many elements two arrays share from their starts on."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("long")


class Hits:
    """The documents' words inside windows of the benchmark.

    rows: row, doc_id, n_words of every document. spans: row, start, end, context
    (the shared span around a fingerprint, end not included). items: context,
    item (the item ids that hold a context).
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, gram: int = GRAM):
        items = stored(fingerprints(benchmark.select(F.col("item_id").alias("item"), "text"), "item", Winnower([], gram), width))
        tests = items.select("item", F.col("span").alias("window"), F.explode("prints").alias("p"))
        tests = tests.select("item", "window", "p.print", "p.gram", "p.before", "p.after")
        around = ["window", "print", "gram", "before", "after"]
        # The same surroundings make one row; its name is a digest of all of them.
        context = F.sha2(F.to_json(F.struct(*around)), 256).alias("context")
        self.items = stored(tests.select(context, "item").distinct())
        tests = stored(tests.select(context, *around).distinct())
        # At most `width` lengths and one number.
        spans = sorted(r["window"] for r in tests.select("window").distinct().collect())
        made = Winnower(spans, gram, bit_map(tests, tests.count()))
        self.rows = stored(fingerprints(docs, "doc_id", made))
        mine = self.rows.select("row", F.explode("prints").alias("p")).select("row", "p.*")
        t = tests.select("context", "window", "print", *(F.col(c).alias(f"t_{c}") for c in ("gram", "before", "after")))
        pairs = mine.join(t, "print").where("gram = t_gram")
        left, right = common_start(F.col("before"), F.col("t_before")), common_start(F.col("after"), F.col("t_after"))
        pairs = pairs.select("row", "context", "window", (F.col("at") - left).alias("start"), (F.col("at") + F.size("gram") + right).alias("end"))
        self.spans = stored(pairs.where(F.col("end") - F.col("start") >= F.col("window")).drop("window").distinct())


def hit_words(spans: Column) -> Column:
    """How many places an array of (start, end) covers."""
    ordered = F.array_sort(F.array_distinct(spans))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def step(s: Column, x: Column) -> Column:
        more = F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], s["upto"]))
        return F.struct((s["n"] + more).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto"))

    return F.aggregate(ordered, start, step, lambda s: s["n"])


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """row, doc_id, n_words, n_hit, items (sorted texts of the ids whose windows
    occur) and spans (start, end of the merged hits' parts) of every row of docs
    (doc_id, text); benchmark has item_id and text."""
    hits = Hits(docs, benchmark, width, gram)
    spans = hits.spans.select("row", "start", "end").distinct().groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    held = hits.spans.select("row", "context").distinct().join(hits.items, "context")
    held = held.select("row", F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item")).distinct()
    held = held.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    none = F.array()
    out = hits.rows.select("row", "doc_id", "n_words").join(spans.join(held, "row"), "row", "left")
    spans = F.coalesce("spans", none.cast("array<struct<start:bigint,end:bigint>>"))
    return out.select("row", "doc_id", "n_words", hit_words(spans).alias("n_hit"), F.coalesce("items", none.cast("array<string>")).alias("items"), F.array_sort(spans).alias("spans"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark's windows in every document."""
    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item, w, least(10, len(w)) AS span FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, span, array_to_string(w[i:i + span - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - span + 2)) AS i FROM sized)
), spans AS (SELECT DISTINCT span FROM windows
), places AS (
  SELECT r, i, span, array_to_string(w[i:i + span - 1], ' ') AS win FROM (SELECT r, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM d, spans WHERE len(w) >= span)
), hits AS (
  SELECT r, i, span, item FROM places JOIN windows USING (span, win)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + span)) AS p FROM (SELECT DISTINCT r, i, span FROM hits)) GROUP BY r
), held AS (
  SELECT r, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(array_to_string(coalesce(items, []), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN held USING (r)
"""
