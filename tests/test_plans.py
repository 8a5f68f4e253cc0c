import datetime
import json
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import dictionary
from loomspark.plans import catalog, executors, governance, workflow
from loomspark.schemas import as_corpus, lookup
from loomspark.sinks import writers
from loomspark.sources import mapping, profiles, readers
from loomspark.streaming import streams


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [("1", "Battery recycling", "Battery recycling improves supply chain safety.", 2024, "A"), ("2", "Writing", "Academic writing and citation review of battery safety.", 2023, "B"), ("3", "Battery", "Battery recycling supply risk grows.", 2022, "A")]
    return as_corpus(spark.createDataFrame(docs, "doc_id string, title string, raw_text string, year int, institution string")).withColumn("row_order", F.col("doc_id").cast("long"))


def test_catalog():
    assert len(catalog.NODES) == 49 and set(catalog.NODES) == set(executors.EXECUTORS)
    assert catalog.compatible("CleanCorpus", "TokenCorpus") and not catalog.compatible("TokenCorpus", "CleanCorpus")
    assert catalog.compatible("FrequencyTable", "AnyTable") and not catalog.compatible("CorpusTable", "AnyTable")
    assert catalog.NODES["overlay_dictionary_rules"].defaults()["overlay_rows_text"].count("|") == 3


def test_compile():
    plan = workflow.compile_workflow(workflow.chain("corpus_input", "clean_text", "normalize_text", "tokenize", "filter_terms", "frequency_statistics", "note"))
    assert [n["node_type"] for n in plan.nodes if n["node_type"] != "note"][-1] == "frequency_statistics"
    loop = {"nodes": [{"node_id": i, "node_type": "filter_by_metadata", "config": {}} for i in "ab"], "edges": [{"from_node": x, "from_port": "filtered_corpus", "to_node": y, "to_port": "corpus_in"} for x, y in ("ab", "ba")]}
    with pytest.raises(ValueError, match="cycle"):
        workflow.compile_workflow(loop)
    with pytest.raises(ValueError, match="operator"):
        workflow.compile_workflow({"nodes": [{"node_id": "a", "node_type": "filter_by_metadata", "config": {"operator": "like"}}]})
    alone = workflow.compile_workflow({"nodes": [{"node_id": "a", "node_type": "clean_text"}], "edges": []})
    assert alone.nodes == [] and alone.left_out == ["a"]
    flow = workflow.full_analysis()
    assert workflow.fingerprint(flow) == workflow.fingerprint(flow | {"title": "x"}) != workflow.fingerprint(workflow.variant(flow, {"focus_terms": {"max_terms": 3}}))


def test_run_with_sinks(spark, corpus, tmp_path):
    context = executors.Context(spark, corpus, dictionary.entries(spark, [("stopwords", "and", None), ("phrase_lexicon", "supply chain", None)]), folder=str(tmp_path))
    steps = workflow.chain("corpus_input", "dictionary_input", "clean_text", "normalize_text", "tokenize", "apply_dictionary_rules", "filter_terms", "frequency_statistics", ("save_xlsx", {}, {"table_in": "frequency_statistics.frequency_table"}), ("save_html_report", {}, {"report_in": ["frequency_statistics.frequency_table", "apply_dictionary_rules.audit_table"]}), ("save_csv", {}, {"table_in": "frequency_statistics.frequency_table"}))
    result = workflow.run(steps, context)
    tf = {r.term: r.tf for r in result.table("frequency_table").collect()}
    assert tf["battery"] == 3 and "and" not in tf and tf["supply_chain"] == 1
    back = readers.read_workbook(spark, str(tmp_path / "tables.xlsx"))
    assert {r.term: int(r.tf) for r in back.collect()} == tf
    assert "audit_summary" in (tmp_path / "report.html").read_text()
    again = workflow.experiment(workflow.chain("corpus_input", ("sample_corpus", {"sample_size": 2})), context, {"one": {"sample_corpus": {"sample_size": 1}}, "two": {}}, "sampled_corpus")
    assert sorted(r["count"] for r in again.groupBy("variant_label").count().collect()) == [1, 2]


def test_plugins(tmp_path):
    (tmp_path / "good.py").write_text("from loomspark.plans.catalog import Node, Port\ndef register(r):\n    r.node(Node('mine', 'process', (Port('corpus_in', 'CorpusTable'),), (Port('out', 'CorpusTable'),)), lambda ctx, cfg, i: {'out': i['corpus_in'].limit(1)})\n")
    (tmp_path / "bad.py").write_text("raise RuntimeError('no')\n")
    registry = workflow.Registry().load(str(tmp_path))
    assert "mine" in registry.nodes and len(registry.problems) == 1


def test_governance(spark, corpus):
    before = governance.fingerprints(corpus.where("doc_id <> '2'"))
    assert [r.doc_id for r in governance.changed(corpus, before).collect()] == ["2"]
    flow = workflow.chain("corpus_input", "clean_text", "normalize_text")
    assert governance.dirty(flow, corpus_changed=True) == {"corpus_input", "clean_text", "normalize_text"}
    patches = spark.createDataFrame([("1", "title", "New")], "doc_id string, field string, value string")
    assert {r.doc_id: r.title for r in governance.patched(corpus, patches).collect()}["1"] == "New"
    a, b = (spark.createDataFrame([("t", n)], "name string, row_count long") for n in (3, 8))
    assert governance.compare_runs(a, b).first().row_delta == 5
    assert governance.bundle_kind(["xlsx", "csv"], True) == "tables_only" and governance.bundle_kind(["xlsx", "csv"], False) == "custom"
    assert governance.bundle_kind(["png", "html"], False) == "charts_and_report" and governance.bundle_kind(["png", "html"], True) == "custom"
    records = spark.createDataFrame([("r1", "clean_text", False), ("r2", "clean_text", False), ("r1", "note", False)], "run_id string, node_id string, invalidated boolean")
    assert sorted((r.run_id, r.node_id) for r in governance.invalidated(records, ["clean_text"], "r2").where("invalidated").collect()) == [("r1", "clean_text")]


def test_review_corrections(spark, corpus):
    full = corpus.withColumns({"tokens": F.array(F.lit("t")), "clean_text": F.lit("c"), "raw_hash": F.lit("h"), "status": F.lit("x")})
    tasks = [
        ("a", "document_patch", "resolved", '{"doc_id": "1"}', '{"document_patch": {"title": "", "year": "x", "raw_text": "new"}}', None),
        ("b", "document_patch", "resolved", None, '{"doc_id": "2", "document_patch": {"title": "Other"}}', '{"decision": "reject"}'),
        ("c", "institution_merge", "resolved", None, '{"source_values": ["A"], "canonical_institution": "Z"}', None),
        ("d", "keyword_merge", "resolved", None, '{"source_term": "GPU", "target_term": "gpus"}', '{"target_term": "graphics unit"}'),
        ("e", "dictionary_patch", "resolved", None, '{"dictionary_kind": "stopwords", "entries": [{"source": "of"}, {"source": "and"}]}', None),
        ("f", "cluster_rename", "resolved", '{"cluster_id": "3"}', '{"new_label": "L"}', None), ("g", "cluster_rename", "open", '{"cluster_id": "4"}', '{"label": "M"}', None),
    ]
    tasks = spark.createDataFrame(tasks, "id string, review_type string, status string, target_ref string, payload string, resolution string")
    got = {r.doc_id: r for r in governance.patched(full, governance.document_corrections(tasks, full)).collect()}
    assert (got["1"].title, got["1"].year, got["1"].raw_text, got["1"].tokens, got["1"].clean_text, got["1"].status) == ("Battery recycling", None, "new", [], "", "ready")
    assert got["1"].raw_hash == "22af645d1859cb5ca6da0c484f1f37ea" and got["2"].title == "Writing" and got["3"].tokens == ["t"] and got["3"].raw_hash == "h"
    assert [got[k].institution for k in "123"] == ["Z", "B", "Z"]
    words = dictionary.entries(spark, [("standard_terms", "gpu", "old"), ("stopwords", "and", None)])
    after = {(r.kind, r.source): (r.target, r.enabled) for r in governance.corrected(words, governance.dictionary_corrections(tasks)).collect()}
    assert after == {("standard_terms", "gpu"): ("graphics unit", True), ("stopwords", "and"): (None, True), ("stopwords", "of"): (None, True)}
    assert [tuple(r) for r in governance.cluster_corrections(tasks).collect()] == [("3", "L")]


def test_import(spark, tmp_path):
    (tmp_path / "w.csv").write_text('UT,Article Title,AB,C1,Extra\n1,One,"text, a",Org,x\n2,Two,,Org,y\n3,Three,"text, a",Org,z\n1,One,"text, a",Org,x\n')
    out, issues = mapping.import_records(readers.read(spark, str(tmp_path / "w.csv")), "wos")
    kept = {r.doc_id: r for r in out.collect()}
    assert kept["1"].raw_text == "One\n\ntext, a" and kept["1"].extra_metadata["Extra"] == "x" and set(kept) == {"1", "3"}
    assert sorted((r.row, r.reason) for r in issues.collect()) == [(2, "missing_required_fields"), (4, "duplicate_raw_text")]
    (tmp_path / "t.txt").write_text("whole text")
    assert mapping.import_records(readers.read(spark, str(tmp_path / "t.txt")))[0].first().title == "t"
    (tmp_path / "r.json").write_text('[{"title": "a", "abstract": "b", "year": 2020}]')
    assert mapping.import_records(readers.read(spark, str(tmp_path / "r.json")))[0].first().year == 2020
    with pytest.raises(ValueError):
        readers.read(spark, "x.xls")
    assert profiles.template("scopus").fingerprint() == profiles.template("scopus").fingerprint() != profiles.template("wos").fingerprint()
    assert mapping.resolve(["标题 (中文)"], "标题（中文）") == "标题 (中文)"


def test_store(spark, corpus, tmp_path):
    store = writers.Store(spark, str(tmp_path / "s"))
    for run in ("r1", "r2"):
        store.save(run, {"c": corpus.select("doc_id")})
    assert store.runs() == ["r1", "r2"] and store.preview("r1", "c", 2).count() == 2
    store.purge("r2")
    assert store.runs() == ["r2"] and store.keys("r2") == ["c"]


def test_stream_counts_equal_batch(spark, corpus, tmp_path):
    rows = corpus.select("doc_id", "year", "raw_text")
    for k in (1, 2):
        rows.where(F.col("doc_id").cast("int") % 2 == k - 1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.read_files(spark, str(tmp_path / "in"), rows.schema, maxFilesPerTrigger="1")
    streams.maintain_term_counts(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.term, r.year): (r.tf, r.df) for r in streams.term_counts(spark, str(tmp_path / "out")).collect()}
    batch = streams.cleaned(rows).select("doc_id", "year", F.explode("filtered_tokens").alias("term")).groupBy("term", "year").agg(F.count("*").alias("tf"), F.count_distinct("doc_id").alias("df"))
    assert got == {(r.term, r.year): (r.tf, r.df) for r in batch.collect()}


def test_dictionary_tables(spark, tmp_path):
    words = dictionary.entries(spark, [("stopwords", "and", None), ("stopwords", "of", None), ("custom_lexicon", "x", None)])
    table = json.loads(pathlib.Path(writers.write_dictionary_table(words, "stopwords", "stopwords", str(tmp_path / "t.json"))).read_text())
    assert [e["source"] for e in table["entries"]] == ["and", "of"] and table["kind"] == "stopwords"
    with pytest.raises(ValueError):
        writers.write_dictionary_table(words, "stopwords", "none", str(tmp_path / "n.json"))


def test_definitions_are_checked():
    Node, Param, Port = catalog.Node, catalog.Param, catalog.Port
    assert not [f for n in catalog.NODES.values() for f in n.faults()]
    bad = Node("", "other", (Port("a", ""), Port("b", "AnyTable")), (Port("b", "AnyTable", multiple=True),), (Param("mode", "x", ("y", "z")), Param("mode", "y", ("y",)), Param("n", [1])))
    found = bad.faults()
    assert len(found) == 8 and any("2 times" in f for f in found) and any("category" in f for f in found)
    registry = workflow.Registry()
    registry.node(Node("mine", "process"), None)
    assert "mine" not in registry.nodes and "executor" in registry.problems[0]


def test_plain_json_values():
    odd = {1: float("nan"), "b": [float("inf"), 2.5, None, True], "c": datetime.date(2024, 5, 1), "d": np.float64("nan"), "e": np.arange(2), "f": {"g": (1,)}}
    assert writers.plain(odd) == {"1": None, "b": [None, 2.5, None, True], "c": "2024-05-01", "d": None, "e": [0, 1], "f": {"g": [1]}}


def test_lookup_by_path(spark):
    df = spark.sql("select 7 as plain, named_struct('b', named_struct('c', 5), 'm', map('x.y', 'deep')) as a, map('k', named_struct('v', 2)) as m, map('lab', 'L', 'a.z', 'Z') as extra_metadata")
    want = {"plain": "7", "a.b.c": "5", "a.m.x.y": "deep", "m.k.v": "2", "m.none.v": None, "lab": "L", "extra_metadata.lab": "L", "a.z": "Z", "missing": None}
    row = df.select(*(lookup(df, n).alias(f"c{k}") for k, n in enumerate(want))).first()
    assert list(row) == list(want.values())
