"""Exact top-k search by columnar branch and bound (operator 7).

Components become integers floor(1024 * x); the score is their inner product.
The queries are dealt to blocks of a bounded number of components. A block is
broadcast, and the candidates are searched where they are read: no candidate is
shuffled or copied, and only the best rows of each task and query meet in a
grouped limit. Blocks follow one another, so what is broadcast never grows.

A task turns its rows, a bounded chunk at a time, into vertical layout: a row
for each dimension. The lengths of all vectors from each block of dimensions on
are found once a chunk. A query adds its scores up one block of dimensions after
the other; after each, a candidate is dropped whose sum plus the most that its
remaining dimensions can add (by Cauchy and Schwarz the product of the remaining
lengths) is below the score that the query's last place needs, and the survivors
are moved together. That score is the last of the query's best rows so far; in a
task's first chunk it comes from the candidates with the largest first sums,
whose scores are made at once. Nothing is estimated: results are exact, ties go
to the smaller vec_id.

Rows whose vec_id or vector is null, or whose vector holds a null or non-finite
component, take no part; a vector meets those of its own length only. Every row
that is asked counts, rows that share a vec_id too, and only its own row is left
out: a task returns one row more than is wanted, and one row equal to the query's
is taken out at the end. Equal query rows are searched once and each returns the
result. Sums are exact while they are below 2**53 and are made with unbounded
integers else, cut to the range of a long. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import stored, table

TOP, EVERY, SCALE = 10, 100, 1024
#: Components of a task's chunk and of a query block; dimensions added at once; queries whose first sums are made together.
CHUNK, BLOCK, DIMENSIONS, TOGETHER = 1 << 21, 1 << 20, 16, 32
LONG = (1 << 63) - 1


def lengths_left(upright: np.ndarray) -> np.ndarray:
    """Row k: the lengths of the vectors (columns) from the k-th block of dimensions on; the last row is zero."""
    squares = [(upright[s : s + DIMENSIONS] ** 2).sum(axis=0) for s in range(0, len(upright), DIMENSIONS)]
    left = np.zeros((len(squares) + 1, upright.shape[1]))
    for k in range(len(squares) - 1, -1, -1):
        left[k] = left[k + 1] + squares[k]
    return np.sqrt(left)


class Chunk:
    """Candidates of one length in vertical layout."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.upright, self.ids = np.ascontiguousarray(vectors.T), ids
        self.left = lengths_left(self.upright)

    def search(self, query: np.ndarray, left: np.ndarray, total: np.ndarray, worst: float, want: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(positions, scores) of all candidates that may be among the `want`
        best, from the sums `total` of the first block, and how many dimension
        blocks of candidates were added up."""
        if worst == -np.inf and len(total) > want:
            seed = np.argpartition(-total, want - 1)[:want]
            worst = float((query @ self.upright[:, seed]).min())
        alive, work = None, len(total)
        for k in range(1, len(self.left)):
            rest = self.left[k] if alive is None else self.left[k][alive]
            fits = np.flatnonzero(total + rest * (left[k] * (1 + 1e-9)) + 1 >= worst)
            alive, total = fits if alive is None else alive[fits], total[fits]
            s = k * DIMENSIONS
            if s >= len(query) or not len(alive):
                break
            total = total + query[s : s + DIMENSIONS] @ self.upright[s : s + DIMENSIONS][:, alive]
            work += len(alive)
        if alive is None:
            alive = np.arange(len(total))
        return alive, total, work


class Searcher:
    """Searches candidates for all queries of a block; keeps `want` rows of each."""

    def __init__(self, queries: list[tuple[int, np.ndarray]], want: int):
        """queries: (vec_id, components) each."""
        self.want, self.work, self.full = want, 0, 0
        self.best: list[list[tuple]] = [[] for _ in queries]  # (-score, vec_id, is not the query's own row)
        self.groups: dict[int, tuple] = {}
        for size in {len(v) for _, v in queries}:
            at = [k for k, (_, v) in enumerate(queries) if len(v) == size]
            q = np.floor(np.array([queries[k][1] for k in at], np.float64).reshape(len(at), size) * SCALE)
            self.groups[size] = (at, q, lengths_left(np.ascontiguousarray(q.T)), [queries[k][0] for k in at])

    def merge(self, k: int, rows: list[tuple]) -> None:
        self.best[k] = sorted(self.best[k] + rows)[: self.want]

    def feed(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (components unscaled, a row each) of one length."""
        if not len(ids) or vectors.shape[1] not in self.groups:
            return
        at, queries, left, own_ids = self.groups[vectors.shape[1]]
        whole = np.floor(vectors * SCALE)
        largest = max(np.abs(whole).max(initial=0), np.abs(queries).max(initial=0))
        if vectors.shape[1] * largest**2 >= 1 << 52:
            return self.feed_exactly(whole, ids)
        chunk = Chunk(whole, ids)
        first = chunk.upright[:DIMENSIONS]
        for start in range(0, len(at), TOGETHER):
            totals = queries[start : start + TOGETHER, :DIMENSIONS] @ first
            for j, total in enumerate(totals, start):
                best = self.best[at[j]]
                worst = float(-best[-1][0]) if len(best) == self.want else -np.inf
                alive, scores, work = chunk.search(queries[j], left[:, j], total, worst, self.want)
                self.work, self.full = self.work + work, self.full + len(ids) * max(1, len(chunk.left) - 1)
                found = alive[np.lexsort((ids[alive], -scores))[: self.want]] if len(alive) > self.want else alive
                if len(found):
                    values = (queries[j] @ chunk.upright[:, found]).tolist()
                    mine = [i == own_ids[j] and bool((chunk.upright[:, c] == queries[j]).all()) for c, i in zip(found, ids[found].tolist(), strict=True)]
                    self.merge(at[j], [(-int(s), i, not m) for s, i, m in zip(values, ids[found].tolist(), mine, strict=True)])

    def feed_exactly(self, whole: np.ndarray, ids: np.ndarray) -> None:
        """The same with unbounded integers, for components too large for doubles."""
        at, queries, _, own_ids = self.groups[whole.shape[1]]
        rows = [[int(x) for x in v] for v in whole]
        for k, q, own in zip(at, queries, own_ids, strict=True):
            query = [int(x) for x in q]
            found = ((-sum(a * b for a, b in zip(query, v, strict=True)), i, not (i == own and v == query)) for v, i in zip(rows, ids.tolist(), strict=True))
            self.merge(k, sorted(found)[: self.want])


def search(batches: Iterator[pa.RecordBatch], queries: list[tuple], top: int) -> Iterator[pa.RecordBatch]:
    """The candidates (vec_id, v) against the queries (number, vec_id, copies, components)."""
    searcher = Searcher([(i, v) for _, i, _, v in queries], top + 1)
    waiting: dict[int, list] = {}

    def flush(size: int) -> None:
        ids, vectors = zip(*waiting.pop(size), strict=True)
        searcher.feed(np.concatenate(vectors).reshape(-1, size), np.concatenate(ids))

    for b in batches:
        v, ids = b.column("v"), b.column("vec_id").to_numpy(zero_copy_only=False)
        sizes = v.value_lengths().to_numpy(zero_copy_only=False)
        flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
        for size in set(sizes.tolist()).intersection(searcher.groups):
            at = np.flatnonzero(sizes == size)
            own = flat if len(at) == len(ids) else flat[(ends[at, None] - size + np.arange(size)).ravel()]
            waiting.setdefault(size, []).append((ids[at], own))
            if sum(len(i) for i, _ in waiting[size]) * max(1, size) >= CHUNK:
                flush(size)
    for size in list(waiting):
        flush(size)
    rows = [(number, i, copies, c, max(-LONG - 1, min(LONG, -s)), not other) for (number, i, copies, _), best in zip(queries, searcher.best, strict=True) for s, c, other in best]
    columns = zip(*rows, strict=True) if rows else [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    names = ["number", "query_id", "copies", "vec_id", "score", "own"]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def top_k(vectors: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by
    `every`, against all other rows of vectors (vec_id, embedding)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(sound)
    asked = stored(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.count("*").alias("copies")))
    size = asked.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("components")).first()
    blocks = max(1, -(-(size["components"] or 0) // BLOCK))
    spark, found = vectors.sparkSession, None
    for k in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == k).orderBy("vec_id", "v").collect()
        block = spark.sparkContext.broadcast([((k << 32) + j, r["vec_id"], r["copies"], np.array(r["v"], np.float64)) for j, r in enumerate(mine)])

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            return search(batches, block.value, top)

        part = rows.mapInArrow(run, "number bigint, query_id bigint, copies bigint, vec_id bigint, score bigint, own boolean")
        place = F.row_number().over(W.partitionBy("number").orderBy(F.desc("score"), "vec_id", F.desc("own")))
        part = part.withColumn("place", place).where(F.col("place") <= top + 1)
        if blocks > 1:  # a block's rows are written before the next one is sent
            part = stored(part)
            block.unpersist()
        found = part if found is None else found.unionByName(part)
    # One row equal to the query's own goes, if it came so far.
    mine = F.row_number().over(W.partitionBy("number").orderBy(F.desc("own"), "place"))
    found = found.withColumn("mine", mine).where("not (own and mine = 1)")
    rank = F.row_number().over(W.partitionBy("number").orderBy("place"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= top)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best other rows of every hundredth vector."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
