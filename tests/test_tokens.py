"""Tokens found in Arrow batches are those of the columns."""

from pyspark.sql import functions as F

from loomspark import queries
from loomspark.functions import text, tokens
from loomspark.operators import stats

ODD = "a-b/c-d x/-y a-/b --z- /q/ fooBarBazQ aBcD ＡＢ－Ｃ K İI 中文ab中 <b>x<y> http://a.b/c,d www.x y<z https:// q ΑΣ.Α a　b < > <> a.-b é-b"


def test_tokens_are_those_of_the_columns(spark):
    rows = spark.createDataFrame([(ODD,), (ODD.lower(),), (ODD.encode("ascii", "ignore").decode(),), ("",), (None,)], "t string")
    c = F.col("t")
    for kw in ({}, {"lowercase_english": False}, {"strip_html": False, "strip_urls": False}, {"full_half_width_normalize": False}, {"strip_email": True}):
        both = rows.select(text.tokenize(text.normalize(text.clean(c, **kw))).alias("a"), tokens.cleaned_tokens(c, **kw).alias("b"))
        assert both.where("not (a <=> b)").count() == 0, kw
    for kw in ({}, {"camel": False}, {"hyphens": False}, {"slashes": True}, {"hyphens": False, "slashes": True}, {"shortest": 3}):
        assert rows.select(text.tokenize(c, **kw).alias("a"), tokens.tokens(c, **kw).alias("b")).where("not (a <=> b)").count() == 0, kw


def test_many_tokens_are_held_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "HELD", 3)
    assert tokens.split_all(pa.array(["a b", None, "c d e", "", "f"]), tokens.splitter()).to_pylist() == [["a", "b"], None, ["c", "d", "e"], [], ["f"]]


def test_terms_of_a_document_in_several_rows_are_added_up(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["a", None]), (2, []), (3, None), (None, ["a"])], "doc_id long, filtered_tokens array<string>")
    assert sorted(map(tuple, stats.counted(rows).collect()), key=str) == [(1, "a", 3), (1, "b", 1), (None, "a", 1)]


def test_queries_make_their_tokens_in_batches(spark):
    plan = queries.filtered(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp" not in plan
