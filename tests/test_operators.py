import itertools
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspark.operators import dictionary, features, graph, models, relational, stats, technology

DOCS = [("1", "a", 2024, "OpenAI", ["model", "model", "alignment", "scale"]), ("2", "b", 2024, "OpenAI", ["model", "alignment"]), ("3", "c", 2025, "Anthropic", ["safety", "safety", "alignment"]), ("4", "d", 2025, "Anthropic", ["safety", "governance"])]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id string, title string, year int, institution string, filtered_tokens array<string>").withColumn("source", F.lit("s")).withColumn("row_order", F.col("doc_id").cast("long")).persist()


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_keyness_and_groups(corpus):
    found = rows(stats.keyness(corpus, "institution", "OpenAI", "Anthropic", 2), "term")
    assert set(found) == {("safety",), ("model",), ("alignment",)}
    assert (found["safety",].comparison_term_count, found["safety",].baseline_term_count) == (3, 0)
    assert [found[t,].llr for t in ("safety", "model", "alignment")] == [6.160841, 4.573191, 0.248763]
    assert found["alignment",].relative_ratio == 0.6
    groups = rows(stats.group_compare(corpus, "institution", "OpenAI", ["Anthropic"]), "group_value", "term")
    assert (groups["Anthropic", "safety"].term_count, groups["Anthropic", "safety"].document_count, groups["Anthropic", "safety"].baseline_term_count) == (3, 2, 0)
    assert groups["OpenAI", "safety"] if ("OpenAI", "safety") in groups else True


def test_frequency_sums(corpus):
    f = rows(stats.frequency(corpus), "term")
    assert sum(r.tf for r in f.values()) == sum(len(d[4]) for d in DOCS)
    assert (f["alignment",].tf, f["alignment",].df, f["alignment",].first_year, f["alignment",].last_year) == (3, 3, 2024, 2025)


@pytest.mark.parametrize("width", [1, 2, 3, 5])
def test_cooccurrence_brute_force(spark, width):
    docs = [["a", "b", "a", "c", "d", "b"], ["c"], [], ["d", "d", "a"], None]
    want = Counter()
    for d in docs:
        for i in range(len(d or [])):
            want.update(itertools.combinations(sorted(set(d[i : i + width])), 2))
    df = spark.createDataFrame([(str(k), d) for k, d in enumerate(docs)], "doc_id string, filtered_tokens array<string>")
    got = {(r.term_a, r.term_b): r.cooccurrence_count for r in stats.cooccurrence(df, width, 1).collect()}
    assert got == want


def test_tfidf_and_similarity_brute_force(corpus):
    n, df = len(DOCS), Counter(t for d in DOCS for t in set(d[4]))
    want = {}
    for d in DOCS:
        raw = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in Counter(d[4]).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        want[d[0]] = {t: v / norm for t, v in raw.items()}
    w = features.tfidf(corpus)
    for r in w.collect():
        assert r.w == pytest.approx(want[r.doc_id][r.term])
    got = {(r.doc_id_a, r.doc_id_b): r.similarity for r in features.similarity(w, corpus, None, 0.05, 0).collect()}
    for a, b in itertools.combinations("1234", 2):
        s = sum(v * want[b].get(t, 0) for t, v in want[a].items())
        assert got.get((a, b), 0) == (pytest.approx(s, abs=1e-6) if s >= 0.05 else 0)


def test_ranks_without_a_global_window(spark):
    df = spark.createDataFrame([(f"t{k:03d}", float(k % 7)) for k in range(300)], "term string, score double")
    got = [r.term for r in features.ranks(df, "score", "term").orderBy("rank").collect()]
    assert got == [t for t, _ in sorted(((r.term, r.score) for r in df.collect()), key=lambda x: (-x[1], x[0]))]


def test_focus(spark, corpus):
    candidates = spark.createDataFrame([("doc", "risk", 1), ("project", "safety", 1), ("project", "Safety", 2), ("project", "model", 3), ("project", "scale", 4)], "scope string, keyword string, rank int")
    terms = features.focus_candidates(candidates, most=2)
    assert [t.lower() for t in terms] == ["safety", "model"]
    kept = rows(features.focus(corpus, terms), "doc_id")
    assert kept["1",].filtered_tokens == ["model", "model"] and kept["4",].filtered_tokens == ["safety"]
    assert features.focus(corpus, []) is corpus


def test_dictionary_constants_and_join_agree(spark, monkeypatch):
    corpus = spark.createDataFrame([("1", ["the", "gpu", "a", "genai"]), ("2", []), ("3", ["analysis", "GPU"])], "doc_id string, tokens array<string>")
    rules = dictionary.entries(spark, [("stopwords", "the", None), ("stopwords", "a", None), ("standard_terms", "gpu", "graphics processing unit"), ("stopwords", "analysis", None, False)])
    small, audit = dictionary.apply(corpus, rules)
    want = {"1": ["graphics processing unit", "genai"], "2": [], "3": ["analysis", "graphics processing unit"]}
    assert {r.doc_id: r.tokens for r in small.collect()} == want
    assert [r.rule_type for r in audit.where("doc_id = '1'").orderBy("position").collect()] == ["stopwords", "standard_terms", "stopwords"]
    monkeypatch.setattr(dictionary, "MOST_CONSTANTS", 0)
    assert {r.doc_id: r.tokens for r in dictionary.apply(corpus, rules)[0].collect()} == want


def test_relational(spark, corpus):
    table = spark.createDataFrame([("OpenAI", 1), ("Other", 2), ("Other", 3)], "institution string, n int")
    out = relational.route(corpus, table, "corpus_metadata", "institution", "in", ["OpenAI"])
    assert [out[k].count() for k in ("matched_corpus", "unmatched_corpus", "matched_table", "unmatched_table")] == [2, 2, 1, 2]
    assert tuple(out["route_summary"].first()) == ("corpus_metadata", "institution", "in", ["OpenAI"], 2, 2, 4, 3)
    assert tuple(relational.route(None, table, "table", "n", "gte", [2])["route_summary"].first())[4:] == (2, 1, 0, 3)
    metrics = spark.createDataFrame([("silhouette", 0.41), ("davies", 1.2)], "metric string, value double")
    assert relational.gate(metrics, corpus, "silhouette", "gte", 0.5)[0].count() == 0
    assert relational.gate(metrics, corpus, "silhouette", "gte", 0.4)[0].count() == 4
    assert tuple(relational.gate(metrics, corpus, "davies", "lt", 2)[2].first()) == ("davies", "value", "lt", 2.0, 1.2, True, 4)
    wide = spark.createDataFrame([("cluster", 0.1), ("overall", 0.9)], "row_type string, score double").coalesce(1)
    assert relational.gate(wide, None, "score", "gte", 0.0)[2].first().observed_value == 0.1  # a column of that name: the first row
    assert relational.gate(wide, None, "", "gte", 0.5, value_field="score")[2].first().observed_value == 0.9
    assert relational.gate(wide, None, "none", "gte", 0.5)[2].first().passed is False
    tasks = spark.createDataFrame([("r", "open")], "id string, status string")
    assert [relational.review_gate(corpus, tasks, i, on_missing=m)[0].count() for i, m in (("r", "block"), ("x", "pass"), ("x", "block"))] == [0, 4, 0]
    left = spark.createDataFrame([("battery", 4, "l"), (None, 3, "l")], "term string, tf int, g string")
    right = spark.createDataFrame([("battery", 5.1, "r"), (None, 4.3, "r")], "term string, llr double, g string")
    assert relational.join_results(left, right, ["term"]).columns == ["term", "tf", "g", "llr", "g_right"]
    assert relational.join_results(left, right, ["term"]).count() == 2 and relational.join_results(left, right, ["nope"]).count() == 0
    copy = corpus.unionByName(corpus.where("doc_id = '1'").withColumn("doc_id", F.lit("9")))
    assert relational.deduplicate(copy, ["title", "year"]).count() == 4
    parts = Counter(r.split_name for r in relational.split(corpus, relational.parse_splits("train:0.5\ntest:0.5")).collect())
    assert parts == {"train": 2, "test": 2}
    assert sorted(r.doc_id for r in relational.sample(corpus, 2).collect()) == sorted(r.doc_id for r in relational.sample(corpus, 2).collect())


EDGES = [("a", "b", 4), ("b", "c", 3), ("d", "e", 5)]


def test_graph(spark):
    nodes, edges = graph.build_network(spark.createDataFrame(EDGES, "term_a string, term_b string, cooccurrence_count long"))
    m = rows(graph.metrics(edges), "term")
    assert m["b",].degree == 2 and m["b",].betweenness == pytest.approx(1 / 6, abs=1e-6)
    assert m["b",].closeness == pytest.approx(0.5) and sum(r.pagerank for r in m.values()) == pytest.approx(1, abs=1e-4)
    assert {r.community_id for r in graph.communities(edges).collect()} == {0, 1}
    assert graph.communities(edges, "label_propagation").count() == 5
    assert [r.term for r in graph.main_path(edges).orderBy("position").collect()] == ["a", "b", "c"]
    assert graph.main_path(edges, "cooccurrence_backbone").count() == 5
    best = graph.link_prediction(edges, 3).collect()
    assert (best[0].term_a, best[0].term_b, best[0].score) == ("a", "c", 1.0) and len(best) == 3
    with pytest.raises(ValueError):
        graph.bounded(edges, 2)


def test_technology(spark):
    ty = spark.createDataFrame([("x", 2022, 1, 1), ("x", 2024, 7, 2), ("x", 2021, 1, 1), ("old", 2017, 8, 2), ("old", 2023, 7, 3)], "term string, year int, tf_in_year int, df_in_year int")
    found = rows(technology.indicators(ty, None, 2024), "term")
    assert (found["old",].growth_rate, found["old",].recent_tf, found["old",].baseline_tf) == (0.8889, 7, 8)
    one = spark.createDataFrame([("t", 0.9, 0.7, 0.2, 3.0)], "term string, novelty_score double, disruption_score double, maturity_score double, growth_rate double")
    assert technology.classify(one).first().technology_class == "emerging"


def test_cluster_evaluation(spark):
    points = spark.createDataFrame([("1", 0, 0.0, 0.1), ("2", 0, 0.2, 0.0), ("3", 1, 4.8, 5.1), ("4", 1, 5.0, 4.9)], "doc_id string, cluster_id int, x double, y double")
    found = models.evaluate(points, 3).collect()
    assert found[0].silhouette_score > 0.9 and sorted(r.cluster_size for r in found[1:]) == [2, 2]


def test_models(corpus):
    w = features.tfidf(corpus).persist()
    f = features.feature_terms(w, None).persist()
    terms, docs, summary = models.topics(corpus, w, f, 2)
    assert summary.count() == 2 and docs.count() == 4 and terms.count() > 0
    assert models.document_clusters(corpus, w, f, 2).count() == 4
    assert models.keyword_clusters(w, f, corpus, 2).count() == f.count()


def test_technology_order(spark):
    rows = spark.createDataFrame([("b", 0.5, 0.2), ("a", 0.5, 0.2), ("c", 0.5, 0.9), ("d", 0.9, 0.1), ("e", None, 1.0)], "term string, novelty_score double, disruption_score double")
    assert [r.term for r in technology.ranked(rows).collect()] == ["d", "c", "a", "b", "e"]
    assert [r.term for r in technology.ranked(rows, 2).collect()] == ["d", "c"]


def test_sample_ratio_rounds_halves_up(spark):
    # A quarter of 10 rows is 2.5: three, as SQL rounds it.
    rows = spark.range(10).select(F.col("id").cast("string").alias("doc_id"))
    assert relational.sample(rows, ratio=0.25).count() == 3
    assert relational.sample(rows, ratio=0.2).count() == 2


def test_yake_compares_closely_only_what_may_be_alike(monkeypatch):
    from loomspark.operators import yake

    calls = []
    plain = yake.SequenceMatcher.ratio
    monkeypatch.setattr(yake.SequenceMatcher, "ratio", lambda self: calls.append(1) or plain(self))
    words = " ".join("abcdefghij"[k % 10] * (k % 7 + 2) + "klmnopqrst"[k // 10] * (k % 5 + 2) for k in range(100))
    assert len(yake.extract(words, 30, frozenset())) == 30
    assert len(calls) < 200  # all pairs: some thousands
    assert [g for g, _ in yake.extract("battery recycling. battery recyclinx. policy", 9, frozenset(), width=2)].count("battery recyclinx") <= 1


def test_counted_pairs_are_the_pairs_of_the_windows(spark):
    docs = [["b", "a", "b", "é", "z", "a"], [], ["a"], ["x", "x", "x"], ["z", "Z", "z", "\U0001f600", "￿"]]
    df = spark.createDataFrame([(d,) for d in docs], "filtered_tokens array<string>").coalesce(1)
    for width in (2, 3, 5):
        plain = df.select(F.explode(stats.window_pairs(F.col("filtered_tokens"), width)).alias("p")).select("p.a", "p.b")
        want = Counter((r.a, r.b) for r in plain.collect())
        got = {(r.term_a, r.term_b): r.cooccurrence_count for r in stats.cooccurrence(df, width, 1).collect()}
        assert got == dict(want)
        column = df.toArrow().column(0).combine_chunks()
        sums = Counter()
        for a, b, n in stats.counted_pairs(column, width):
            for x, y, m in zip(a.to_pylist(), b.to_pylist(), n.tolist(), strict=True):
                sums[x, y] += m
        assert sums == want


def test_term_document_shuffles_documents_once(corpus):
    found = stats.term_document(corpus.unionByName(corpus))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # the terms are made behind it
    assert {(r.doc_id, r.term): r.term_count_in_doc for r in found.collect()} == {(d, t): 2 * n for d, *_, tokens in DOCS for t, n in Counter(tokens).items()}
