"""TF-IDF features, keywords, similarity, focus terms and institution links.

TF-IDF stays in long form (doc_id, term, w); a vector is built only where a
model asks for one.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import text, values
from ..storage import dropped, stored
from . import blocks
from .stats import TOKENS


def tfidf(corpus: DataFrame) -> DataFrame:
    """doc_id, term, w: tf * (ln((1 + N) / (1 + df)) + 1), each document to length 1.

    Tokens with blanks count as several terms here. N counts all documents,
    empty ones too. One shuffle by (document, term), one by term, one by document.
    """
    words = corpus.select("doc_id", F.explode_outer(F.split(F.array_join(TOKENS, " "), " +")).alias("term")).where("term <> ''")
    tf = words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = corpus.agg(F.count("*").alias("docs"))  # one row
    raw = tf.join(df, "term").join(F.broadcast(n)).select("doc_id", "term", (F.col("tf") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1)).alias("raw"))
    # A window holds one document's distinct terms.
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("raw") / norm).alias("w"))


def feature_terms(weights: DataFrame, count: int | None = 1000, digits: int | None = None) -> DataFrame:
    """term, score (sum of weights), selected (the best `count`), source, rank.

    Ranks are dealt over value ranges: counts of each range give the offset, so
    no single task sees all terms.
    """
    score = F.sum("w") if digits is None else F.round(F.sum("w"), digits)
    ranked = ranks(weights.groupBy("term").agg(score.alias("score")), "score", "term")
    selected = F.lit(True) if count is None else F.col("rank") <= count
    return ranked.select("term", "score", selected.alias("selected"), F.lit("auto").alias("source"), "rank")


def ranks(df: DataFrame, score: str, tie: str) -> DataFrame:
    """Adds rank (from 1): by falling score, then by tie; without a global window.

    Rows are range-partitioned by both, so equal scores (the long tail of rare
    terms) are spread too; a row's rank is its place in its partition and the
    rows of the partitions before. The rows are stored first, for dealing them by
    ranges reads them twice.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.desc(score), tie)
    given = stored(df)
    ranged = given.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = stored(ranged.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__line")))
    dropped(given)
    sizes = placed.groupBy("__p").agg(F.count("*").alias("n"), F.min("__line").alias("first"))  # one row a partition
    before = F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__p", (before - F.col("first")).alias("__move"))
    return placed.join(F.broadcast(sizes), "__p").withColumn("rank", (F.col("__line") + F.col("__move") + 1).cast("int")).drop("__p", "__line", "__move")


def document_keywords(weights: DataFrame, corpus: DataFrame, top: int = 10) -> DataFrame:
    """doc_id, keyword, score, rank: the best normalized terms of each document
    by weight. Documents whose terms are no keywords take what is one among their
    `top` most frequent tokens, with the counts as scores."""
    named = weights.select("doc_id", "term", text.keyword(F.col("term")).alias("keyword"), F.round("w", 6).alias("score")).where("keyword is not null")
    once = named.groupBy("doc_id", "keyword").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "keyword"))).where(F.col("rank") <= top)
    # A local test: the weights' terms are the blank-separated parts of the tokens.
    # Two letters or a CJK sign make a keyword, so hardly a text is looked at closely.
    joined = F.array_join(TOKENS, " ")
    none = ~F.exists(F.filter(F.split(joined, " +"), lambda t: t != ""), lambda t: text.keyword(t).isNotNull())
    bare = corpus.where(~F.regexp_like(joined, F.lit(f"[A-Za-z]{{2}}|[{text.CJK}]")) & none)
    bare = bare.select("doc_id", F.posexplode_outer(TOKENS).alias("at", "term")).where("term is not null")
    counts = bare.groupBy("doc_id", "term").agg(F.count("*").cast("double").alias("score"), F.min("at").alias("at"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "at"))
    best = counts.withColumn("at", place).where(F.col("at") <= top).select("doc_id", text.keyword(F.col("term")).alias("keyword"), "score", "at").where("keyword is not null")
    rest = best.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy("at")))
    return ranked.select("doc_id", "keyword", "score", "rank").unionByName(rest.select("doc_id", "keyword", "score", "rank"))


def project_keywords(keywords: DataFrame, top: int = 100) -> DataFrame:
    """keyword, score, rank over all documents: mean score times 1 + ln(documents + 1)."""
    sums = keywords.groupBy("keyword").agg(F.sum("score").alias("total"), F.count("*").alias("docs"), F.max("score").alias("best"))
    score = F.round(F.col("total") / F.col("docs") * (1 + F.log(F.col("docs") + 1)), 6)
    best = sums.select("keyword", score.alias("score"), "docs", F.round("best", 6).alias("best")).orderBy(F.desc("score"), F.desc("docs"), F.desc("best"), "keyword").limit(top)
    place = F.row_number().over(W.orderBy(F.desc("score"), F.desc("docs"), F.desc("best"), "keyword"))  # `top` rows
    return best.select("keyword", "score", place.alias("rank"))


def keywords(corpus: DataFrame, method: str = "auto", top_doc: int = 10, top_project: int = 100, weights: DataFrame | None = None) -> DataFrame:
    """scope, doc_id, keyword, score, rank by TF-IDF (of the weights given, or
    made here) or YAKE; `auto`, as declared for the node, takes TF-IDF from 2000
    documents or 150,000 tokens on."""
    if method == "auto":
        size = corpus.agg(F.count("*").alias("docs"), F.sum(F.size(TOKENS)).alias("tokens")).first()
        method = "tfidf" if size["docs"] >= 2000 or (size["tokens"] or 0) >= 150_000 else "yake"
    if method == "tfidf":
        own = document_keywords(tfidf(corpus) if weights is None else weights, corpus, top_doc)
    else:
        from . import yake

        own = yake.document_keywords(corpus, top_doc)
    project = project_keywords(own, top_project)
    doc = own.select(F.lit("doc").alias("scope"), F.col("doc_id").cast("string").alias("doc_id"), "keyword", "score", "rank")
    return doc.unionByName(project.select(F.lit("project").alias("scope"), F.lit(None).cast("string").alias("doc_id"), "keyword", "score", "rank"))


def similarity(weights: DataFrame, corpus: DataFrame, features: DataFrame | None = None, least: float = 0.2, top: int = 200) -> DataFrame:
    """Document pairs by the inner product of their weights over the selected
    terms: all pairs of at least `least`, best `top` (0: all).

    Up to blocks.TERMS selected terms blocks of vectors are multiplied. Beyond,
    an exact inverted-index join with prefix filtering: in each document terms
    stand by falling document frequency; those at the front whose squared
    weights sum to less than the squared threshold can't reach it alone (both
    vectors have at most length 1), so a pair must share a term behind them,
    and the frequent terms never index pairs. Candidates are the pairs that
    share an indexed term; only they are scored in full.

    With least 0 the threshold falls until `top` pairs are above it; what is then
    still missing are pairs of score 0, the first in the order of ids. Without a
    `top`, least must be above 0: pairs of score 0 are all pairs.
    """
    if least <= 0:
        return _all_pairs(weights, corpus, features, top)
    have = [c for c in ("title", "year", "institution") if c in corpus.columns]
    chosen = None if features is None else [r["term"] for r in features.where("selected").select("term").limit(blocks.TERMS + 1).collect()]
    if chosen is not None and len(chosen) <= blocks.TERMS:
        chosen = sorted(chosen)
        if top > 0:
            pairs = blocks.similar(weights, corpus.select("doc_id").distinct(), chosen, least, top).select(F.col("p.doc_id").alias("doc_id_a"), F.col("q.doc_id").alias("doc_id_b"), "similarity")
            return _about(pairs.orderBy(F.desc("similarity"), "doc_id_a", "doc_id_b").limit(top), corpus)
        pairs = blocks.similar(weights, corpus.select("doc_id", *have), chosen, least)
        columns = (F.col(f"{s}.{c}").alias(f"{c}_{k}") for c in ("doc_id", *have) for s, k in (("p", "a"), ("q", "b")))
        return pairs.select(*columns, "similarity", F.lit("cosine").alias("similarity_method"))
    w = weights if features is None else weights.join(features.where("selected").select("term"), "term", "left_semi")
    df = w.groupBy("term").agg(F.count("*").alias("df"))
    placed = w.join(df.where("df > 1"), "term")
    order = W.partitionBy("doc_id").orderBy(F.desc("df"), "term").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("mass", F.sum(F.col("w") * F.col("w")).over(order))
    indexed = placed.where(F.col("mass") >= least * least * (1 - 1e-9)).select("doc_id", "term")
    # A pair's first shared indexed term: the other document holds the term anywhere.
    left = indexed.select(F.col("doc_id").alias("x"), "term")
    right = placed.select(F.col("doc_id").alias("y"), "term")
    pairs = left.join(right, "term").where("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()
    # The other terms that both hold count too: one row a candidate and term of its first document.
    a = w.select(F.col("doc_id").alias("doc_id_a"), "term", F.col("w").alias("wa"))
    b = w.select(F.col("doc_id").alias("doc_id_b"), "term", F.col("w").alias("wb"))
    both = pairs.join(a, "doc_id_a").join(b, ["doc_id_b", "term"])
    scored = both.groupBy("doc_id_a", "doc_id_b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), 6).alias("similarity")).where(F.col("similarity") >= least)
    if top > 0:
        scored = scored.orderBy(F.desc("similarity"), "doc_id_a", "doc_id_b").limit(top)
    return _about(scored, corpus)


def _all_pairs(weights: DataFrame, corpus: DataFrame, features: DataFrame | None, top: int) -> DataFrame:
    """The `top` most similar pairs without a threshold."""
    if top <= 0:
        raise ValueError("least must be above 0: pairs of score 0 are all pairs")
    for least in (0.5, 0.2, 0.05, 1e-9):
        found = similarity(weights, corpus, features, least, top).select("doc_id_a", "doc_id_b", "similarity")
        rows = [tuple(r) for r in found.collect()]  # at most `top`
        if len(rows) >= top:
            break
    # The first documents' pairs: if there are more documents than these, the first one has pairs enough.
    have = {(a, b) for a, b, _ in rows}
    ids = [r[0] for r in corpus.select("doc_id").orderBy("doc_id").limit(2 * top + 2).collect()]
    free = ((a, b, 0.0) for a, b in itertools.combinations(ids, 2) if (a, b) not in have)
    rows += itertools.islice(free, max(0, top - len(rows)))
    kind = corpus.schema["doc_id"].dataType.simpleString()
    return _about(corpus.sparkSession.createDataFrame(rows, f"doc_id_a {kind}, doc_id_b {kind}, similarity double"), corpus)


def _about(scored: DataFrame, corpus: DataFrame) -> DataFrame:
    """The pairs with what is known about their documents."""
    have = [c for c in ("title", "year", "institution") if c in corpus.columns]
    for side in ("a", "b"):
        about = corpus.select(F.col("doc_id").alias(f"doc_id_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in have))
        scored = scored.join(about, f"doc_id_{side}")
    return scored.select("doc_id_a", "doc_id_b", *(f"{c}_{s}" for c in have for s in "ab"), "similarity", F.lit("cosine").alias("similarity_method"))


def focus_candidates(candidates: DataFrame, field: str = "auto", selected_only: bool = True, project_only: bool = True, most: int = 80, prefer: str = "term") -> list[str]:
    """The first `most` candidate terms in rank order, one for each spelling."""
    names = [field] if field != "auto" else [c for c in (("keyword", "term") if prefer == "keywords" else ("term", "keyword")) if c in candidates.columns]
    rows = candidates
    if selected_only and "selected" in rows.columns:
        rows = rows.where("selected")
    if project_only and "scope" in rows.columns:
        rows = rows.where("scope = 'project'")
    term = F.trim(F.coalesce(*(F.when(F.col(n) != "", F.col(n)) for n in names)))
    order = [c for c in ("rank",) if c in rows.columns]
    rows = rows.select(term.alias("t"), *order).where("t <> ''").withColumn("s", text.focus_signature(F.col("t")))
    first = rows.groupBy("s").agg(F.min(F.struct(*order, "t")).alias("r"))
    best = first.orderBy("r").limit(most) if most > 0 else first.orderBy("r")
    return [r["r"]["t"] for r in best.collect()]


def focus(corpus: DataFrame, terms: Sequence[str], on_empty: str = "pass_through") -> DataFrame:
    """Tokens that share a spelling with one of the terms.

    The spellings are a short list of constants (at most `most` terms).
    """
    if not terms and on_empty == "pass_through":
        return corpus
    spark = corpus.sparkSession
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select(F.explode(text.focus_variants(F.col("t"))).alias("v")).distinct().collect()
    allowed = F.array(*(F.lit(r["v"]) for r in rows)) if rows else F.array().cast("array<string>")
    return corpus.withColumn(TOKENS, F.filter(TOKENS, lambda t: F.arrays_overlap(text.focus_variants(t), allowed)))


def focus_summary(before: DataFrame, after: DataFrame, terms: Sequence[str], candidates: DataFrame, most: int = 80, on_empty: str = "pass_through", source: str = "auto", field: str = "auto") -> DataFrame:
    """One row about what the focus kept."""
    n = before.agg(F.count("*").alias("document_count"), F.coalesce(F.sum(F.size(TOKENS)), F.lit(0)).alias("tokens_before"))
    m = after.agg(F.coalesce(F.sum(F.size(TOKENS)), F.lit(0)).alias("tokens_after"))
    rows = n.join(m).join(candidates.agg(F.count("*").alias("candidate_row_count")))  # one row each
    return rows.select(
        "candidate_row_count", F.lit(len(terms)).alias("selected_term_count"), "document_count", "tokens_before", "tokens_after",
        F.round(F.col("tokens_after") / F.greatest("tokens_before", F.lit(1)), 6).alias("token_retention_ratio"), F.lit(most).alias("max_terms"),
        F.lit(source).alias("term_source"), F.lit(field).alias("term_field"), F.lit(on_empty).alias("on_empty"), F.lit(" / ".join(terms[:8])).alias("selected_terms_preview"),
    )


def institution_keywords(corpus: DataFrame, doc_keywords: DataFrame) -> DataFrame:
    """institution, keyword, cooccurrence_count, year, score."""
    docs = corpus.where(F.coalesce("institution", F.lit("")) != "").select("doc_id", "institution", "year")
    counts = docs.join(doc_keywords.select("doc_id", "keyword"), "doc_id").groupBy("institution", "keyword", "year").agg(F.count("*").alias("cooccurrence_count"))
    return counts.select("institution", "keyword", "cooccurrence_count", "year", values.log_score(F.col("cooccurrence_count")).alias("score"))


def institution_topics(corpus: DataFrame, doc_topics: DataFrame, topic_terms: DataFrame) -> DataFrame:
    """institution, topic_id, topic_label, cooccurrence_count, representative_terms, year."""
    docs = corpus.where(F.coalesce("institution", F.lit("")) != "").select("doc_id", "institution", "year")
    counts = docs.join(doc_topics.select("doc_id", "topic_id"), "doc_id").groupBy("institution", "topic_id", "year").agg(F.count("*").alias("cooccurrence_count"))
    first = F.sort_array(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "term"))))["term"]
    labels = topic_terms.groupBy("topic_id").agg(F.max("topic_label").alias("topic_label"), first.alias("representative_terms"))
    return counts.join(labels, "topic_id", "left").select("institution", "topic_id", "topic_label", "cooccurrence_count", "representative_terms", "year")


def heatmap(institution_topic: DataFrame, rows: int = 10, columns: int = 8) -> DataFrame:
    """Institution by topic counts: the largest rows and columns."""
    total = F.sum("cooccurrence_count")
    top = lambda c, n: [r[0] for r in institution_topic.groupBy(c).agg(total.alias("t")).orderBy(F.desc("t"), c).limit(n).collect()]
    inst, topics = top("institution", rows), top("topic_id", columns)
    kept = institution_topic.where(F.col("institution").isin(inst) & F.col("topic_id").isin(topics))
    return kept.groupBy("institution").pivot("topic_id", sorted(topics)).sum("cooccurrence_count").na.fill(0)
