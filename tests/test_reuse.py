"""Results kept between runs: the cache of node results and signed deltas."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import deltas, dictionary, stats
from loomspark.plans import executors, workflow
from loomspark.plans.cache import NodeCache, content

FLOW = ("corpus_input", "dictionary_input", "clean_text", "normalize_text", ("tokenize", {"language_mode": "en"}), "apply_dictionary_rules", "filter_terms", "frequency_statistics", "term_year_analysis")


def run(spark, cache, rows, flow=None, words=(("stopwords", "and", None),), **options):
    corpus = spark.createDataFrame(rows, "doc_id string, raw_text string, title string, year int")
    context = executors.Context(spark, corpus, dictionary.entries(spark, list(words)))
    out = workflow.run(workflow.chain(*(flow or FLOW)), context, cache=cache, **options)
    tf = {r.term: r.tf for r in out.table("frequency_table").collect()}
    context.release()
    return tf, {x["node_id"]: x["status"] for x in out.log}


def test_a_second_run_computes_only_what_changed(spark, tmp_path):
    cache = NodeCache(spark, str(tmp_path / "nodes"))
    rows = [("1", "Graph data and graph", "a", 2020), ("2", "data mining", "b", 2021)]
    tf, log = run(spark, cache, rows)
    assert tf == {"graph": 2, "data": 2, "mining": 1} and set(log.values()) == {"composed", "computed"}
    again, log = run(spark, cache, rows[::-1])
    assert again == tf and "computed" not in log.values() and log["clean_text"] == "reused"
    # A new option: the nodes behind it, and nothing upstream, which isn't composed either.
    flow = tuple(("filter_terms", {"min_token_length": 5}) if s == "filter_terms" else s for s in FLOW)
    tf, log = run(spark, cache, rows, flow)
    assert tf == {"graph": 2, "mining": 1} and {k for k, v in log.items() if v == "computed"} == {"filter_terms", "frequency_statistics", "term_year_analysis"}
    # Only the latest run's results stay: the old option is computed again.
    assert run(spark, cache, rows)[1]["filter_terms"] == "computed"
    # A dictionary entry concerns what reads the dictionary; a document everything.
    tf, log = run(spark, cache, rows, words=(("stopwords", "data", None),))
    assert tf == {"graph": 2, "and": 1, "mining": 1} and log["clean_text"] == "reused" and log["apply_dictionary_rules"] == "computed"
    tf, log = run(spark, cache, [*rows, ("3", "mining", "c", None)], words=(("stopwords", "data", None),))
    assert tf["mining"] == 2 and log["clean_text"] == "computed"
    # Results that are marked as out of date, and results that were not finished, don't count.
    log = run(spark, cache, [*rows, ("3", "mining", "c", None)], words=(("stopwords", "data", None),), invalid=["filter_terms"])[1]
    assert log["tokenize"] == "reused" and log["filter_terms"] == log["frequency_statistics"] == "computed"


def test_content_tells_tables_apart(spark):
    df = lambda rows: spark.createDataFrame(rows, "a string, b int")
    base = content(df([("x", 1), ("y", None), ("y", None)]))
    assert base == content(df([("y", None), ("x", 1), ("y", None)]))
    assert len({base, content(df([("x", 1), ("y", None)])), content(df([])), content(df([("x", 1), ("y", 0), ("y", None)])), content(df([("x", 1), (None, 1), ("y", None)])), content(None)}) == 6


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    doc = lambda k: (f"d{k}", [rng.choice(words) for _ in range(rng.randrange(0, 15))], rng.choice([2019, 2020, 2021, None]), rng.choice(["A", "B", " ", None]))
    old = [doc(k) for k in range(80)]
    new = [doc(k) if k % 5 == 0 else r for k, r in enumerate(old) if k % 7] + [doc(k) for k in range(80, 90)]
    new[3] = (new[3][0], new[3][1], 2030, new[3][3])
    schema = "doc_id string, filtered_tokens array<string>, year int, institution string"
    return spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)


def test_deltas_equal_a_recount(spark, both):
    old, new = both
    columns = (stats.TOKENS, "year", "institution")
    gone, come = deltas.versions(old, new, columns)
    assert 0 < gone.count() < 40 and 0 < come.count() < 40
    tables = deltas.updated(deltas.summaries(old), gone, come)
    same = lambda a, b: sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))
    for name, table in deltas.summaries(new).items():
        assert same(tables[name], table.select(*tables[name].columns)), name
    assert same(deltas.frequency(tables["terms"]), stats.frequency(new))
    assert same(deltas.term_year(tables["terms"]), stats.term_year(new))
    assert same(deltas.cooccurrence(tables["pairs"], 2), stats.cooccurrence(new, 5, 2))
    shares = deltas.group_shares(tables["groups"]).where("group_value = 'A'").select("term", F.col("term_count"), "document_count", "total_terms", "normalized_frequency")
    whole = stats.group_compare(new, "institution", "A", ["A"], 1).where("group_value = 'A' and term_count > 0").select(*shares.columns)
    assert same(shares, whole)
    # Everything gone, and everything new.
    assert all(t.count() == 0 for t in deltas.updated(deltas.summaries(old), old, old.limit(0)).values())
    start = {k: t.limit(0) for k, t in deltas.summaries(old).items()}
    assert same(deltas.updated(start, old.limit(0), old)["terms"], deltas.summaries(old)["terms"])
