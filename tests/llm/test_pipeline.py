import corpus_pipeline
from loomspark.llm import quality, toxicity

from .test_llm import brute_kept, brute_mix, check_pieces

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.orderBy("doc_id").collect()
        rows = [(r.doc_id, r.text) for r in before]
        if name == "toxicity":
            model = toxicity.train(docs, labels)
            want = [r for r in before if model(r.text or "") < toxicity.THRESHOLD]
        elif name == "quality":
            model = quality.train(docs, labels)
            want = [r for r in before if not model.learnt or model(r.text or "") >= quality.THRESHOLD]
        elif name == "near duplicates":
            want = [before[k] for k in brute_kept(rows)]
        else:
            taken, _ = brute_mix([(r.doc_id, r.text, r.source) for r in before])
            want = [r for r, t in zip(before, taken, strict=True) for _ in range(int(t / max(1, len((r.text or "").split())) + 0.5))]
        out = corpus_pipeline.stored(stage(spark, docs, SF))
        assert out.columns == docs.columns, name
        assert sorted(map(str, out.collect())) == sorted(map(str, want)), name
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in docs.collect()], 4096)


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
