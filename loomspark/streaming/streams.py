"""Structured Streaming: ingestion, windowed counts, incremental term statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text


def read_files(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet", **options) -> DataFrame:
    """A stream over a folder's files; works on any store that Spark lists."""
    return spark.readStream.format(form).schema(schema).options(**options).load(path)


def with_time(df: DataFrame, column: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """df with a watermark; times without a zone are taken as the session's."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """Late copies of a row within the watermark are dropped; a batch drops all copies."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def tumbling(df: DataFrame, width: str = "1 hour", keys: tuple[str, ...] = ("event_type",), column: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums by window; the same plan on batches and streams."""
    return _counts(df, F.window(column, width), keys, value)


def sliding(df: DataFrame, width: str = "1 hour", step: str = "15 minutes", keys: tuple[str, ...] = ("event_type",), column: str = "ts", value: str = "value") -> DataFrame:
    return _counts(df, F.window(column, width, step), keys, value)


def sessions(df: DataFrame, gap: str = "30 minutes", keys: tuple[str, ...] = ("user_id",), column: str = "ts", value: str = "value") -> DataFrame:
    """A session of a key ends after a gap without events."""
    return _counts(df, F.session_window(column, gap), keys, value)


def _counts(df: DataFrame, window, keys: tuple[str, ...], value: str) -> DataFrame:
    out = df.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def cleaned(docs: DataFrame) -> DataFrame:
    """The stateless part of the text pipeline, equal on batches and streams."""
    c = text.normalize(text.clean(F.col("raw_text")))
    return docs.withColumn("tokens", text.tokenize(c)).withColumn("filtered_tokens", F.filter("tokens", lambda t: F.length(t) >= 2))


def maintain_term_counts(docs: DataFrame, root: str, checkpoint: str):
    """Starts a stream that keeps additive term-year counts below root.

    Each batch writes its own counts as root/batch=<id>, overwriting only itself
    when it is repeated after a failure, so totals stay exact; readers sum the
    parts. A document's id comes in one batch only.
    """

    def write(batch: DataFrame, number: int) -> None:
        terms = batch.select("doc_id", "year", F.explode("filtered_tokens").alias("term"))
        pairs = terms.groupBy("term", "year", "doc_id").agg(F.count("*").alias("n"))
        pairs.groupBy("term", "year").agg(F.sum("n").alias("tf"), F.count("*").alias("df")).write.mode("overwrite").parquet(f"{root}/batch={number}")

    return cleaned(docs).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_counts(spark: SparkSession, root: str) -> DataFrame:
    """The totals of all batches so far."""
    return spark.read.parquet(root).groupBy("term", "year").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def running_vocabulary(docs: DataFrame, key: str = "source") -> DataFrame:
    """key, terms: how many distinct terms each key has shown so far (a stateful
    stream in update mode, or one batch): an approximate sketch of fixed size
    for each key, so state doesn't grow with the vocabulary."""
    return cleaned(docs).select(key, F.explode("filtered_tokens").alias("term")).groupBy(key).agg(F.approx_count_distinct("term").alias("terms"))
