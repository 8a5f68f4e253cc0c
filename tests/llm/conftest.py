import pytest

ODD = [
    (1, "Released under the MIT License.\n\nthe GENERAL public license", "en", "a", 5), (2, None, "en", None, None), (3, "", "de", "a", 0), (4, "x " * 6000, "de", "b", 1), (5, "tie tie tie", "fr", "b", 2),
    (5, "tie tie tie", "fr", "b", 2), (None, "no id 中文 <|endoftext|> é", None, None, None), (8, " \n\t ", "en", "a", 3), (9, "Licensed under CC BY-NC 4.0.", "en", "c", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and an extra column with a clashing name."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.withColumn("size", F.lit("clash")).withColumn("fp", F.lit(1)).withColumn("bucket", F.lit(2)).withColumn("n_rows", F.lit(3)).withColumn("copies", F.lit(4)).persist()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0).persist()
