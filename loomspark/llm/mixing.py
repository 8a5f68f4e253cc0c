"""Mixing sources to target weights by weighted fair queueing (operator 10).

Every source gets a target: its weight's share of all words, at most `repeats`
times the words it has; what that cuts off is shared again by weight among the
others. Within a source the documents stand in a fixed shuffled order, up to
`repeats` passes one after the other; a pass of a document enters the queue in
pieces of at most QUANTUM words. The virtual finish time of a piece is the
source's words up to its end divided by the source's target. The pieces of all
sources are sorted globally by that time, in ranges, with running totals over
the ranges and inside each; the queue is truncated where the total reaches the
budget (the sum of the targets), in the midst of a piece if need be. What a
document's pieces hold before that place is what the mix takes of it. As sources
advance together in virtual time, each ends within QUANTUM words of its target,
however long its documents are.

No row waits for a whole source: the shuffle hash deals a source's rows to
as many buckets as each then has rows (the square root of the source's rows);
buckets are summed, the table of bucket sums gets its running totals, and each
row adds the running total inside its own bucket. Only numbers, ids and source
names are shuffled, never texts.

Null and empty texts have size 0 and are taken 0 times; a null source is a
source of its own, last in order; repeated rows are rows like any others; an
empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import WORD, free_name, literal, parts, range_bounds, range_bucket, stored, table

REPEATS, WEIGHTS, QUANTUM = 3, 3, 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text: the shuffled order, the same in every
    run; rows that share an id but not the text are spread."""
    empty = F.lit("")
    own = F.md5(F.coalesce(text, empty).cast("binary"))
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), empty), F.lit(":"), own).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, repeats: int = REPEATS, weights: int = WEIGHTS) -> DataFrame:
    """source, place, source_size, n_rows, target of each row (source, source_size, n_rows).

    Water filling in closed form: by rising ratio of cap to weight a source is
    capped while its ratio is not above the level that the rest would get. The
    windows run over the table of sources: one row a source.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    fill = W.orderBy("ratio", "place")
    before, total = fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    s = (
        sources.withColumn("place", F.row_number().over(order))
        .withColumn("weight", ((F.col("place") - 1) % weights + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * repeats)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        .withColumn("capped", F.col("ratio") <= F.col("level"))
        .withColumn("rest", F.min(F.when(~F.col("capped"), F.struct("ratio", "place", "level"))).over(total)["level"])
    )
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("rest"))
    return s.select("source", "place", "source_size", "n_rows", target.alias("target"))


def queued(docs: DataFrame, repeats: int, weights: int) -> DataFrame:
    """doc_id, h, size, source, place, source_size, target and start of every
    row: its words stand at [start, start + size) of its source's first pass."""
    h = shuffle_hash(F.col("doc_id"), F.col("text"))
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), h.alias("h")))
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), repeats, weights)
    # One row a source: far below the rows, and joined by Spark as its measured size allows.
    sources = stored(sources.withColumn("buckets", F.ceil(F.sqrt("n_rows"))))
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select(sized["*"], "place", "source_size", "target", "buckets")
    rows = rows.withColumn("bucket", F.floor(F.col("h") / (F.lit(float(1 << 60)) / F.col("buckets"))).cast("long"))
    sums = rows.groupBy("place", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = F.coalesce(F.sum("bucket_size").over(W.partitionBy("place").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("ahead", ahead).drop("bucket_size")
    inside = W.partitionBy("place", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    queue = rows.join(sums, ["place", "bucket"])
    return queue.select("doc_id", "h", "size", "source", "place", "source_size", "target", (F.col("ahead") + F.col("inside")).alias("start"))


def pieces(queue: DataFrame, repeats: int) -> DataFrame:
    """The rows' pieces in all passes: begin, words, finish, beside place and start."""
    size, quantum = F.col("size"), F.lit(QUANTUM)
    numbers = F.sequence(F.lit(0).cast("long"), F.ceil(size / quantum) * repeats - 1)
    cut = queue.where("size > 0").select("*", F.explode(numbers).alias("n"))
    skipped = F.floor(F.col("n") / repeats).cast("long") * quantum
    begin = F.col("start") + F.col("source_size") * F.pmod(F.col("n"), F.lit(repeats)) + skipped
    cut = cut.withColumn("begin", begin).withColumn("words", F.least(quantum.cast("long"), size - skipped))
    return cut.withColumn("finish", (F.col("begin") + F.col("words")) / F.col("target")).drop("n")


def mix(docs: DataFrame, repeats: int = REPEATS, weights: int = WEIGHTS) -> DataFrame:
    """doc_id, h, size, source, source_size, target, taken, finish_time (of the
    first pass) of every row of docs (doc_id, text, source)."""
    queue = stored(queued(docs, repeats, weights))
    queue_pieces = pieces(queue, repeats)
    bounds = sorted(set(range_bounds(queue_pieces, "finish", parts(docs.sparkSession))))
    ranged = queue_pieces.withColumn("range", range_bucket(F.col("finish"), bounds, "double", F.lit(0)))
    # One row a range and one number, the budget, come to the driver; the ranges are as many as shuffle partitions.
    held = {r["range"]: r["words"] for r in ranged.groupBy("range").agg(F.sum("words").alias("words")).collect()}
    ahead = [0]
    for k in range(len(bounds)):
        ahead.append(ahead[-1] + held.get(k, 0))
    once = queue.groupBy("place").agg(F.first("target").alias("target"))
    budget = F.lit(round(once.agg(F.sum("target").alias("t")).first()["t"] or 0))
    order = W.partitionBy("range").orderBy("finish", "place", "begin").rowsBetween(W.unboundedPreceding, -1)
    before = F.get(literal(ahead, "bigint"), F.col("range")) + F.coalesce(F.sum("words").over(order), F.lit(0))
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), budget.cast("long") - before))
    cut = ranged.withColumn("taken", taken).groupBy("place", "start").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "h", "size", "source", "source_size", "target")), F.sum("taken").alias("taken")
    )
    blank = queue.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    finish = ((F.col("start") + F.col("size")) / F.when(F.col("target") > 0, F.col("target"))).alias("finish_time")
    names = ["doc_id", "h", "size", "source", "source_size", "target", "taken"]
    return cut.select(*names, finish).unionByName(blank.select(*names, finish))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed table itself: every row as often as the mix takes it (the part
    over the cut rounded to a whole document), with the columns of docs. Rows
    that share id and text share what is taken of them."""
    n, mark = free_name("copies", docs.columns), free_name("mark", docs.columns)
    counted = mix(docs, **options).where("size > 0").groupBy("h", "source").agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias(n))
    # The counts grow with the corpus, so they are never broadcast: the same plan at every size.
    counted = stored(counted.where(F.col(n) > 0)).hint("merge")
    marked = docs.withColumn(mark, shuffle_hash(F.col("doc_id"), F.col("text")))
    match = (marked[mark] == counted["h"]) & marked["source"].eqNullSafe(counted["source"])
    out = marked.join(counted, match).select(*(marked[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), counted[n])).alias(free_name("pass", docs.columns)))
    return out.select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS place FROM src
), weighed AS (
  SELECT *, (place - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM placed
), levels AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed
), targets AS (
  SELECT source, place, source_size, CASE WHEN ratio <= level THEN CAST(cap AS DOUBLE)
    ELSE weight * (SELECT level FROM levels WHERE ratio > level ORDER BY ratio, place LIMIT 1) END AS target FROM levels
), queue AS (
  SELECT s.*, t.place, t.source_size, t.target, row_number() OVER () AS rid,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), passes AS (
  SELECT rid, place, target, start, source_size, size, k, unnest(range(0, size, 1024)) AS skipped FROM queue, (SELECT unnest(range(0, 3)) AS k)
), pieces AS (
  SELECT rid, place, target, start + k * source_size + skipped AS begin, least(1024, size - skipped) AS words FROM passes
), totals AS (
  SELECT rid, words, coalesce(sum(words) OVER (ORDER BY CAST(begin + words AS DOUBLE) / target, place, begin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pieces
), taken AS (
  SELECT rid, sum(greatest(0, least(words, (SELECT round(sum(target)) FROM targets) - before))) AS taken FROM totals GROUP BY rid
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM queue LEFT JOIN taken ON queue.rid = taken.rid
"""
