"""Session helpers."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch that small_batches asks for; one longer row is a batch of its own.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def session(app: str = "loomspark", **options: str) -> SparkSession:
    """A session with the settings that the operators are written for; `options` are added to them."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }
    for k, v in (settings | options).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_loomspark_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="loomspark-"), "loomspark")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
    sc._loomspark_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Python workers get texts in Arrow batches of at most BATCH_BYTES from now on,
    unless the session has a size of its own. Spark's 64 MB are held several times
    over (Arrow vectors in the JVM and the worker, texts as Python strings), for each
    core of an executor, and a worker keeps most of that memory for its later tasks."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
