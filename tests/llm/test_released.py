"""Shuffle files of finished steps don't stay until the end of a long job."""

import time

from loomspark.llm.common import released


def test_shuffle_files_go(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    df = spark.range(100_000).repartition(5, "id")
    df.write.format("noop").mode("overwrite").save()
    before = blocks.getAllFiles().size()
    del df
    for _ in range(20):
        released(spark)  # Spark's cleaner works beside the driver, so files may go some time later
        if blocks.getAllFiles().size() < before:
            break
        time.sleep(0.3)
    assert blocks.getAllFiles().size() < before
