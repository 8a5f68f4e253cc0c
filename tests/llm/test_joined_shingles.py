"""Shingles of very many rows are joined apart from the others."""

from loomspark.llm import near_copies
from loomspark.llm.common import HOT, joined_hot, stored


def test_common_shingles_need_no_join_to_be_told(spark):
    rows = [(k % 7 if k % 3 else -1, k) for k in range(3 * HOT)] + [(100 + k, k) for k in range(20 * HOT)]
    left = spark.createDataFrame(rows, "shingle bigint, key bigint")
    counts = stored(left.groupBy("shingle").count().withColumnRenamed("count", "n"))
    found = near_copies.joined_shingles(left, counts, len(rows))
    assert sorted(map(tuple, found.collect())) == sorted(rows)
    assert sorted(map(tuple, joined_hot(left, counts, "shingle", "n", len(rows)).collect())) == sorted(rows)
    # No row passes through a join only to be told from the common ones.
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()
    few = stored(counts.where("shingle >= 100"))
    assert near_copies.joined_shingles(left, few, len(rows)).count() == 20 * HOT
