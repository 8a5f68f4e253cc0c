"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import itertools
import json
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import BATCH, BATCH_BYTES, ship, small_batches  # noqa: F401

#: White space of the word rule `[^\x20\x09-\x0D]+`.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For str.translate: lower-cases A-Z and nothing else.
ASCII_LOWER = str.maketrans(UPPER, LOWER)
#: Keys with more than one of HOT parts of a table's rows are joined apart.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark's own reader."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder that all executors share.

    The session's spark.checkpoint.dir decides. Where it is unset, a local
    session gets a folder of its own; a cluster without it is an error, for a
    machine-local folder would not be seen by the other executors.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if given is None:
            import tempfile

            given = tempfile.mkdtemp(prefix="loomspark-")
        sc.setCheckpointDir(given)
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: the lineage ends
    here, a lost executor costs nothing, and Spark knows the table's size."""
    spark = df.sparkSession
    ship(spark)
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def released(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that nothing holds any more. It does so
    when the driver collects its garbage, which a driver with memory to spare hardly
    does, so a long job's disk would hold the files of all its steps."""
    gc.collect()  # Python's references to the plans
    spark.sparkContext._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `stored` wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def joined_hot(left: DataFrame, right: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """left joined with right, which has each key once and in its column `rows`
    (left out of the result) the number of left rows of that key; left has
    `total` rows. Keys with more than total / HOT rows, fewer than HOT of them,
    are broadcast, so their rows stay where they are; the others are shuffled."""
    hot = F.broadcast(right.where(F.col(rows) * HOT > total).drop(rows))
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(rows) * HOT <= total).drop(rows).hint("merge"), key)
    return left.join(hot, key).unionByName(rest)


def extended(df: DataFrame, carried: list[str], made: Callable[[pa.RecordBatch], list], schema: str) -> DataFrame:
    """The `carried` columns of df beside those that `made` finds for a batch,
    which `schema` declares. Carried columns stay Arrow arrays: pandas would turn
    a column of ids with a null into doubles and round large ones."""
    new = T.StructType.fromDDL(schema)
    whole = T.StructType([df.schema[c] for c in carried] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), *map(pa.array, made(b))], names=whole.names)

    return df.mapInArrow(run, whole)


def record_batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    """Rows as an Arrow batch of the schema; integers stay exact beside nulls."""
    kinds = to_arrow_schema(schema)
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordCache(dict):
    """word -> make(word) in bounded memory, for map(cache.__getitem__, words).

    Two generations of at most `limit` entries: when the young one is full it
    becomes the old one, so frequent words survive. It is no sample: a missing
    word is simply made again.
    """

    def __init__(self, make: Callable, limit: int = 100_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = value
        return value


def literal(values: list, kind: str) -> Column:
    """A constant array, as one folded expression whatever its length."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def range_bounds(df: DataFrame, column: str, buckets: int) -> list:
    """At most buckets - 1 ascending cut values of a numeric column, from one
    partial aggregation (nulls take no part)."""
    if buckets < 2:
        return []
    shares = literal([k / buckets for k in range(1, buckets)], "double")
    row = df.agg(F.percentile_approx(column, shares, max(1000, 20 * buckets)).alias("b")).first()
    return sorted(row["b"] or [])


def range_bucket(value: Column, bounds: list, kind: str, tie: Column) -> Column:
    """The bucket of a value among the cut values, null first.

    Two short scans of about sqrt(n) cut values find it. Where one value fills
    several cut values, `tie` (a hash) spreads its rows over those buckets, so
    a hot value does not meet in one bucket.
    """
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    flat, coarse = literal(bounds, kind), literal(bounds[width - 1 :: width], kind)

    def below(upto: Callable[[Column], Column]) -> Column:
        skipped = F.size(F.filter(coarse, upto)) * width
        return skipped + F.size(F.filter(F.slice(flat, skipped + 1, F.lit(width)), upto))

    high = below(lambda b: b <= value)
    if len(set(bounds)) == len(bounds):
        return F.when(value.isNull(), 0).otherwise(high)
    low = below(lambda b: b < value) + 1
    spread = F.least(low, high) + F.pmod(tie, F.greatest(high - low + 1, F.lit(1)).cast("long")).cast("int")
    return F.when(value.isNull(), 0).otherwise(F.when(low < high, spread).otherwise(high))


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the value as text, modulo the number of folds (null: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def free_name(base: str, taken) -> str:
    """A column name that is not taken (extra columns may clash with ours)."""
    have = {x.lower() for x in taken}
    return next(n for k in itertools.count() if (n := base if not k else f"{base}_{k}") not in have)


def words_of(text: str) -> list[str]:
    """Words by the rule `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased."""
    return re.findall(WORD, text.translate(ASCII_LOWER))
