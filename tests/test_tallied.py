"""Terms are counted where their documents lie; only documents of several rows are put together first."""

import pyarrow as pa
from pyspark.sql import functions as F

from loomspark.operators import stats

ROWS = [(1, 2020, ["a", "a", "b"]), (2, 2020, ["a", None]), (3, 2021, []), (4, None, ["b"]), (5, 2021, None), (6, 2021, ["a", "c", "c"])]
SCHEMA = "doc_id int, year int, filtered_tokens array<string>"


def brute(rows):
    docs, n = {}, {}
    for key, year, tokens in rows:
        for t in tokens or ():
            if t is not None:
                n[year, t] = n.get((year, t), 0) + 1
                docs.setdefault((year, t), set()).add(key)
    return sorted(((y, t, n[y, t], len(docs[y, t])) for y, t in n), key=str)


def sums(df):
    return sorted(map(tuple, df.groupBy("year", "term").agg(F.sum("n"), F.sum("docs")).collect()), key=str)


def test_tallied(spark):
    for rows in (ROWS, [*ROWS, (1, 2020, ["a", "d"]), (6, 2020, ["a"]), (None, 2020, ["a"]), (None, 2020, ["a"])], []):
        df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
        found = stats.tallied(df, "year")
        assert sums(found) == brute(rows)
    plan = stats.tallied(spark.createDataFrame(ROWS, SCHEMA), "year")._jdf.queryExecution().toString()
    assert "Exchange" not in plan  # no row for each document and term is shuffled


def test_parts_hold_few_tokens(monkeypatch):
    monkeypatch.setattr(stats, "TOGETHER", 3)
    b = pa.RecordBatch.from_pydict({"y": [1, 2, 3, 4, 5], "t": pa.array([["a"], None, ["b", "c"], ["d"] * 9, []], pa.list_(pa.string()))})
    found = list(stats.parts(b))
    assert [x.num_rows for x in found] == [3, 1, 1] and pa.Table.from_batches(found).equals(pa.Table.from_batches([b]))
    assert [(r["row"], r["term"], r["count_all"]) for x in found for r in stats.terms_of(x).to_pylist()] == [(0, "a", 1), (2, "b", 1), (2, "c", 1), (0, "d", 9)]
