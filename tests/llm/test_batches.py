"""Texts go to Python workers in small Arrow batches."""

import corpus_pipeline
from loomspark.llm import simhash
from loomspark.llm.common import BATCH, BATCH_BYTES, extended

ROWS, WORDS = 400, 2000


def long_texts(spark):
    """Pairs of near copies of about 20 KB, 8 MB in one partition."""
    rows = [(k, " ".join(f"w{(k // 2) * 7919 + i}" for i in range(WORDS)) + f" end{k}", "en", "a", 1) for k in range(ROWS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1)


def test_near_copies_hold_few_texts_at_once(spark):
    docs = long_texts(spark)
    spark.conf.unset(BATCH)
    kept = sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").select("doc_id").collect())
    assert kept == list(range(0, ROWS, 2))
    size = extended(docs, ["doc_id", "text"], lambda b: [[b.nbytes] * b.num_rows], "bytes bigint").agg({"bytes": "max"}).first()[0]
    assert size <= BATCH_BYTES + 20 * WORDS


def test_batches_change_no_result_and_own_sizes_stay(spark):
    docs = long_texts(spark).where("doc_id < 40")
    try:
        spark.conf.set(BATCH, "1k")
        kept = sorted(r.doc_id for r in simhash.deduplicated(docs).collect())
        assert spark.conf.get(BATCH) == "1k"
    finally:
        spark.conf.unset(BATCH)
    assert kept == list(range(0, 40, 2))
