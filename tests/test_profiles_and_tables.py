"""Import profiles one by one, saved specifications, and the small tables around them."""

import json

import pytest
from pyspark.sql import functions as F

from loomspark.operators import dictionary, features
from loomspark.plans import catalog, executors, governance, workflow
from loomspark.sinks import writers
from loomspark.sources import mapping, profiles, readers

RECORDS = {
    "literature": ({"Title": "T", "Abstract": "A", "PY": "2021", "SO": "J", "AU": "X", "C1": "Inst", "DE": "k1; k2", "WC": "Cat", "Volume": "7"}, {"title": "T", "raw_text": "T\n\nA", "year": 2021, "source": "J", "institution": "Inst", "keyword_field": "k1; k2", "category_or_tag": "Cat"}),
    "scopus": ({"EID": "2-s2", "Title": "T", "Abstract": "A", "Author Keywords": "", "Index Keywords": "ik", "Authors": "X", "Affiliations": "Uni", "Year": "2020", "Source title": "J", "Subject areas": "S", "DOI": "10.1"}, {"doc_id": "2-s2", "raw_text": "T\n\nA\n\nik", "year": 2020, "keyword_field": "ik", "institution": "Uni", "category_or_tag": "S"}),
    "patent": ({"pn": "US1", "invention_title": "T", "摘要": "文", "公开（公告）日": "2019-03-04", "assignee": "Co", "发明人": "Y", "IPC": "H01M"}, {"doc_id": "US1", "title": "T", "raw_text": "T\n\n文", "year": 2019, "institution": "Co", "author": "Y", "category_or_tag": "H01M"}),
    "incopat": ({"公开(公告)号": "CN1", "标题 (中文)": "标", "摘要 (中文)": "", "首权翻译": "权", "申请日": "2018-01-02", "申请人": "厂", "IPC": "C22B", "引证次数": "3"}, {"doc_id": "CN1", "title": "标", "raw_text": "标\n\n权", "year": 2018, "institution": "厂", "category_or_tag": "C22B"}),
    "business_reserved": ({"record_id": "r1", "subject": "T", "content": "C", "published_year": "2017", "company": "Co", "topic": "t", "tags": "a,b"}, {"doc_id": "r1", "title": "T", "raw_text": "T\n\nC", "year": 2017, "institution": "Co", "category_or_tag": "t", "keyword_field": "a,b"}),
}


@pytest.mark.parametrize("profile", sorted(RECORDS))
def test_profile(spark, profile):
    record, want = RECORDS[profile]
    schema = ", ".join(f"`{c}` string" for c in record)
    bare = {c: None for c in record}
    out, issues = mapping.import_records(spark.createDataFrame([tuple(record.values()), tuple(bare.values())], schema).coalesce(1), profile)
    rows = out.collect()
    assert len(rows) == 1 and {k: rows[0][k] for k in want} == want and rows[0].source_profile == profile
    assert [r.reason for r in issues.collect()] == ["missing_required_fields"]
    extra = {"literature": {"Volume": "7"}, "scopus": {"DOI": "10.1"}, "incopat": {"引证次数": "3"}}.get(profile, {})
    assert {k: rows[0].extra_metadata[k] for k in extra} == extra


def test_known_documents_and_repeated_ids(spark):
    records = spark.createDataFrame([("1", "old text"), ("2", "new text"), ("2", "other text")], "id string, abstract string").coalesce(1)
    known = spark.createDataFrame([("old text",)], "t string").select(F.md5(F.col("t").cast("binary")).alias("raw_hash"))
    out, issues = mapping.import_records(records, known=known)
    assert [(r.row, r.reason) for r in issues.collect()] == [(1, "duplicate_raw_text")]
    assert sorted(r.doc_id for r in mapping.replace_corpus(out).collect()) == ["2", "2__lang_2"]


def test_specifications_are_saved_and_checked(tmp_path):
    spec = profiles.parse("title*: Name | Title\nraw_text: Body\ntext: Name | Body", "literature", delimiter=" | ", skip_empty=False)
    text = profiles.saved(spec, "mine")
    assert profiles.restored(text) == spec and profiles.restored(text).fingerprint() == spec.fingerprint()
    changed = json.loads(text)
    changed["specification"]["delimiter"] = ","
    with pytest.raises(ValueError, match="mine"):
        profiles.restored(json.dumps(changed))


def test_lexicon_files_and_dictionaries(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("Colour\tcolor hue\ncolour\tcolor hue\n\nplain\n")
    terms = readers.read_term_list(spark, str(tmp_path / "l.tsv"), "synonym_map")
    assert sorted((r.source, r.target or "") for r in terms.collect()) == [("Colour", "color"), ("Colour", "hue"), ("plain", "")]
    terms.write.json(str(tmp_path / "d.json"))
    assert sorted(map(str, readers.read_dictionary(spark, str(tmp_path / "d.json")).collect())) == sorted(map(str, terms.collect()))
    assert readers.stopwords(spark).where("source = 'the'").count() == 1
    words = dictionary.entries(spark, [("stopwords", "the", None), ("synonym_map", "gpu", "Graphics Unit")])
    found = lambda q: sorted(r.source for r in dictionary.search_entries(words, q).collect())
    assert found(" graphics ") == ["gpu"] and found("") == ["gpu", "the"] and found("zz") == []
    hits = words.withColumn("hits", F.when(F.col("kind") == "stopwords", 3).cast("long"))
    assert {(r.kind, r.total_hits) for r in dictionary.total_hits(hits).collect()} == {("stopwords", 3), ("synonym_map", 0)}
    base = dictionary.entries(spark, [("stopwords", "The", "a"), ("stopwords", "of", None)])
    project = dictionary.entries(spark, [("stopwords", "the", "b")])
    assert {(r.source, r.target) for r in dictionary.merged(base, project).collect()} == {("the", "b"), ("of", None)}


def test_corpus_edits_and_reviews(spark):
    corpus = spark.createDataFrame([("1", "a", 2020), ("2", "b", 2021)], "doc_id string, raw_text string, year int")
    new = spark.createDataFrame([("2", "B"), ("3", "c")], "doc_id string, raw_text string")
    assert sorted(tuple(r) for r in governance.upserted(corpus, new).collect()) == [("1", "a", 2020), ("2", "B", None), ("3", "c", None)]
    assert [r.doc_id for r in governance.deleted(corpus, new.select("doc_id")).collect()] == ["1"]
    before = governance.fingerprints(corpus)
    edited = governance.upserted(corpus, new)
    assert sorted(r.doc_id for r in governance.changed_only(edited, before).collect()) == ["2", "3"]
    tasks = spark.createDataFrame([("a", "resolved", "2024"), ("b", "open", "2023"), ("c", "open", "2025")], "id string, status string, updated_at string")
    assert [r.id for r in governance.review_order(tasks).collect()] == ["c", "b", "a"]


def test_institution_topics_and_heatmap(spark):
    corpus = spark.createDataFrame([("1", "A", 2020), ("2", "A", 2020), ("3", "B", 2021), ("4", "", 2021), ("5", None, 2021)], "doc_id string, institution string, year int")
    topics = spark.createDataFrame([(str(k), k % 2) for k in range(1, 6)], "doc_id string, topic_id int")
    terms = spark.createDataFrame([(t, f"topic {t}", r, f"w{t}{r}") for t in (0, 1) for r in (4, 2, 1, 3)], "topic_id int, topic_label string, rank int, term string")
    found = features.institution_topics(corpus, topics, terms)
    rows = {(r.institution, r.topic_id): r for r in found.collect()}
    assert set(rows) == {("A", 1), ("A", 0), ("B", 1)} and rows["A", 1].representative_terms == ["w11", "w12", "w13"] and rows["B", 1].cooccurrence_count == 1
    map_ = {r.institution: (r["0"], r["1"]) for r in features.heatmap(found).collect()}
    assert map_ == {"A": (1, 1), "B": (0, 1)}
    assert [r.institution for r in features.heatmap(found, rows=1).collect()] == ["A"]


def test_snapshots_and_compiler_hooks(spark, tmp_path):
    corpus = spark.createDataFrame([("1", "T", 2020, "s", "x" * 300)], "doc_id string, title string, year int, source string, raw_text string")
    writers.write_snapshot(str(tmp_path / "run"), {"k": float("nan")}, [{"node": "a", "status": "ok"}], corpus)
    assert json.loads((tmp_path / "run" / "params_snapshot.json").read_text()) == {"k": None}
    assert (tmp_path / "run" / "run_log.txt").read_text() == "node=a status=ok\n"
    row = spark.read.json(str(tmp_path / "run" / "corpus_snapshot")).first()
    assert row.full_text and row.text == "x" * 300
    many = corpus.withColumn("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(writers.SNAPSHOT_DOCS)), lambda k: k.cast("string"))))
    assert {(r.full_text, len(r.text)) for r in writers.corpus_snapshot(many).collect()} == {(False, 241)}
    registry = workflow.Registry()
    node = catalog.Node("first_n", "process", (catalog.Port("corpus_in", "CorpusTable"),), (catalog.Port("corpus", "CorpusTable"),), (catalog.Param("n", "2"),))
    registry.node(node, lambda ctx, cfg, i: {"corpus": i["corpus_in"].limit(cfg["n"])}, lambda cfg: cfg | {"n": int(cfg["n"])})
    flow = {"nodes": [{"node_id": "a", "node_type": "corpus_input"}, {"node_id": "b", "node_type": "first_n", "config": {"n": "3"}}], "edges": [{"from_node": "a", "from_port": "corpus", "to_node": "b", "to_port": "corpus_in"}]}
    assert workflow.run(flow, executors.Context(spark, many), registry).table("corpus").count() == 3
