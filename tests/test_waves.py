"""Centrality by waves against the walks over a broadcast network."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import graph, waves


@pytest.fixture(scope="module")
def edges(spark):
    rng = random.Random(3)
    rows = {}
    for _ in range(90):
        a, b = rng.sample(range(45), 2)
        rows[tuple(sorted((f"t{a:02d}", f"t{b:02d}")))] = float(rng.randrange(1, 4))
    # A second component, a path with ties, and a single edge.
    rows |= {("u0", "u1"): 1.0, ("u1", "u2"): 1.0, ("u0", "u3"): 1.0, ("u2", "u3"): 1.0, ("x", "y"): 2.0}
    return spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "term_a string, term_b string, weight double").persist()


@pytest.fixture(scope="module")
def want(edges):
    return {r.term: r for r in graph.metrics(edges).collect()}


def test_closeness_by_waves(edges, want):
    # One word: sources in several blocks would need more than 64 terms; two words in one block are no different.
    for words in (1, 2):
        got = {r.term: round(r.closeness, 6) for r in waves.closeness(edges, words).collect()}
        assert got == pytest.approx({t: r.closeness for t, r in want.items()}, abs=2e-6)


def test_closeness_in_several_blocks(spark):
    line = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}", 1.0) for k in range(9)] + [("hub", f"s{k:03d}", 1.0) for k in range(80)], "term_a string, term_b string, weight double")
    got = {r.term: round(r.closeness, 6) for r in waves.closeness(line, 1).collect()}
    assert got == pytest.approx({r.term: r.closeness for r in graph.metrics(line).select("term", "closeness").collect()}, abs=2e-6)


def test_betweenness_by_waves(edges, want):
    got = {r.term: r.betweenness for r in waves.betweenness(edges, sources=30).collect()}
    assert got == pytest.approx({t: r.betweenness for t, r in want.items()}, abs=2e-6)


def test_pivots_estimate_betweenness(edges, want):
    got = {r.term: r.betweenness for r in waves.betweenness(edges, sources=40, pivots=25).collect()}
    best = max(want, key=lambda t: want[t].betweenness)
    assert set(got) == set(want) and got[best] == pytest.approx(want[best].betweenness, rel=0.6)


def test_metrics_of_a_network_beyond_the_bound(spark, edges):
    small = edges.where("term_a like 'u%'")
    want = {tuple(r) for r in graph.metrics(small).collect()}
    assert {tuple(r) for r in graph.metrics(small, most=2).collect()} == want
    none = waves.closeness(edges.where(F.lit(False)))
    assert none.count() == 0
