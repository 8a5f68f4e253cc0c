"""What each node does: inputs (DataFrames by port) to outputs, all lazy plans."""

from __future__ import annotations

import datetime
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, tokens
from ..operators import dictionary, features, graph, models, phrases, relational, segmentation, stats, technology
from ..sinks import writers


@dataclass
class Context:
    """What nodes without inputs read: the project's corpus, dictionary and review tasks, and the folder of exports."""

    spark: SparkSession
    corpus: DataFrame | None = None
    dictionary: DataFrame | None = None
    reviews: DataFrame | None = None
    folder: str = "."
    shared: dict = field(default_factory=dict)
    held: list = field(default_factory=list)

    def once(self, key: tuple, make: Callable):
        """A shared subplan, made once a run: equal inputs give the same DataFrame, which Spark plans once."""
        if key not in self.shared:
            self.shared[key] = make()
        return self.shared[key]

    def kept(self, df: DataFrame) -> DataFrame:
        """df stored (in memory or on disk) until `release`: several nodes read it."""
        self.held.append(df.persist())
        return df

    def release(self) -> None:
        for df in self.held:
            df.unpersist()
        self.held.clear()
        self.shared.clear()

    def weights(self, corpus: DataFrame) -> DataFrame:
        return self.once(("tfidf", id(corpus)), lambda: self.kept(features.tfidf(corpus)))

    def features(self, corpus: DataFrame, count) -> DataFrame:
        n = None if count in (None, "", "all") else int(count)
        return self.once(("features", id(corpus), n), lambda: self.kept(features.feature_terms(self.weights(corpus), n)))


EXECUTORS: dict[str, Callable[[Context, dict, dict], dict]] = {}


def node(name: str):
    def keep(f):
        EXECUTORS[name] = f
        return f

    return keep


def listed(value) -> list[str]:
    return [v.strip() for v in str(value or "").replace("\n", ",").split(",") if v.strip()]


@node("corpus_input")
def corpus_input(ctx, cfg, inputs):
    df = ctx.corpus
    if cfg["mode"] == "filtered_subset":
        df = relational.scope(df, cfg.get("sources", ()), cfg.get("institutions", ()), cfg.get("categories", ()), cfg["year_from"], cfg["year_to"])
    elif cfg["mode"] == "selected_documents":
        df = relational.scope(df, doc_ids=cfg.get("selected_doc_ids", []))
    return {"corpus": df}


@node("dictionary_input")
def dictionary_input(ctx, cfg, inputs):
    off = [k for k, p in (("custom_lexicon", "use_custom_lexicon"), ("phrase_lexicon", "use_phrase_lexicon"), ("regex_rules", "apply_regex_rules"), *((r, f"apply_{r}") for r in (*dictionary.RULES, "stopwords", "exclusion_terms"))) if not cfg[p]]
    df = ctx.dictionary if ctx.dictionary is not None else dictionary.entries(ctx.spark, [])
    return {"dictionary_set": df.where(~F.col("kind").isin(off)) if off else df}


@node("merge_corpora")
def merge_corpora(ctx, cfg, inputs):
    return {"corpus": relational.merge_corpora(inputs["corpus_in"], cfg["strategy"])}


@node("select_dictionary_tables")
def select_dictionary_tables(ctx, cfg, inputs):
    return {"dictionary_set": dictionary.select_tables(inputs["dictionary_set_in"], listed(cfg["selected_table_ids_text"]))}


@node("overlay_dictionary_rules")
def overlay_dictionary_rules(ctx, cfg, inputs):
    return {"dictionary_set": dictionary.overlay(inputs["dictionary_set_in"], cfg["overlay_rows_text"])}


@node("normalize_metadata")
def normalize_metadata(ctx, cfg, inputs):
    a = relational.parse_aliases
    corpus, audit = relational.normalize_metadata(inputs["corpus_in"], a(cfg["institution_aliases_text"]), a(cfg["country_aliases_text"]), a(cfg["category_aliases_text"]), cfg["split_delimiters"], cfg["keep_first_institution"], cfg["year_source_field"])
    return {"normalized_corpus": corpus, "metadata_audit_table": audit}


@node("filter_by_metadata")
def filter_by_metadata(ctx, cfg, inputs):
    rules = cfg.get("conditions") or [(cfg["field"], cfg["operator"], listed(cfg["values_text"]))]
    return {"filtered_corpus": relational.filter_by_metadata(inputs["corpus_in"], rules)}


@node("deduplicate_documents")
def deduplicate_documents(ctx, cfg, inputs):
    return {"deduped_corpus": relational.deduplicate(inputs["corpus_in"], listed(cfg["dedupe_keys_text"]))}


@node("sample_corpus")
def sample_corpus(ctx, cfg, inputs):
    return {"sampled_corpus": relational.sample(inputs["corpus_in"], cfg["sample_size"], cfg["sample_ratio"], cfg["seed"])}


@node("clean_text")
def clean_text(ctx, cfg, inputs):
    df = inputs["corpus_in"].withColumn("clean_text", text.clean(F.coalesce("raw_text", F.lit("")), **{k: cfg[k] for k in text.CLEANING}))
    return {"clean_corpus": df.withColumn("status", F.when(F.col("clean_text") == "", "warning").otherwise(F.coalesce("status", F.lit("ready"))) if "status" in df.columns else F.when(F.col("clean_text") == "", "warning").otherwise("ready"))}


def _dictionary(ctx, inputs) -> DataFrame | None:
    own = inputs.get("dictionary_set_in")
    return own if own is not None else ctx.dictionary


@node("normalize_text")
def normalize_text(ctx, cfg, inputs):
    rules = _dictionary(ctx, inputs)
    pairs = dictionary.pairs(rules, "regex_rules") if cfg["apply_regex_rules"] and rules is not None else []
    c = text.normalize(F.col("clean_text"), cfg["convert_traditional_to_simplified"], cfg["normalize_numbers"], cfg["normalize_time_expr"], pairs, cfg["regex_rule_priority"] == "first_match")
    return {"normalized_corpus": inputs["corpus_in"].withColumn("normalized_text", c)}


@node("tokenize")
def tokenize(ctx, cfg, inputs):
    rules = _dictionary(ctx, inputs)
    listed_phrases = rules if rules is not None and cfg["use_phrase_lexicon"] and cfg["preserve_domain_phrases"] else None
    few = dictionary.few_pairs(listed_phrases, "phrase_lexicon", phrases.FOLDED) if listed_phrases is not None else []
    c, df, targets = F.col("normalized_text"), inputs["corpus_in"], None
    if few is None:
        df = df.withColumn("__phrases", phrases.protect(df, "normalized_text", phrases.parts_of(listed_phrases)))
        found, targets = F.col("__phrases.hits"), F.col("__phrases.targets")
        c, few = F.col("__phrases.text"), []
    else:
        found = text.phrase_hits(c, few) if few else F.array().cast("array<string>")
    rule = (cfg["normalize_camel_case"], cfg["split_hyphenated_terms"], cfg["split_slash_terms"], cfg["min_token_length_before_filter"])
    # Without phrases a token is a matter of signs alone, told in Arrow batches.
    plain = not few and targets is None
    df = df.withColumn("tokens", tokens.tokens(c, *rule) if plain else text.tokenize(c, few, *rule, targets)).withColumn("phrase_hits", found)
    df = df.drop("__phrases")
    lexicon = None
    kinds = ["standard_terms", "synonym_map", "near_synonym_map", *(["custom_lexicon"] if cfg["use_custom_lexicon"] else []), *(["phrase_lexicon"] if cfg["use_phrase_lexicon"] else [])]
    if rules is not None:
        lexicon = rules.where(F.col("kind").isin(kinds))
    if cfg["language_mode"] != "en":
        # Words are learnt from all tokens before they are cut, so the tokens are read more than once.
        df = segmentation.segmented(ctx.kept(df), "tokens", lexicon)
    df = df.withColumn("tokens", F.filter("tokens", lambda t: F.length(t) >= cfg["min_token_length_before_filter"])) if cfg["min_token_length_before_filter"] > 1 else df
    if cfg["enable_ngrams"]:
        df = df.withColumn("tokens", text.ngrams(F.col("tokens"), cfg["ngram_min"], cfg["ngram_max"]))
    return {"token_corpus": df}


@node("conditional_router")
def conditional_router(ctx, cfg, inputs):
    own = inputs.get("corpus_in")
    return relational.route(ctx.corpus if own is None else own, inputs.get("table_in"), cfg["source_kind"], cfg["field"], cfg["operator"], listed(cfg["values_text"]))


@node("apply_dictionary_rules")
def apply_dictionary_rules(ctx, cfg, inputs):
    off = [k for k in (*dictionary.RULES, "stopwords", "exclusion_terms") if not cfg[f"apply_{k}"]]
    corpus, audit = dictionary.apply(inputs["token_corpus_in"], inputs["dictionary_set_in"], off)
    return {"token_corpus": corpus, "audit_table": audit}


@node("filter_terms")
def filter_terms(ctx, cfg, inputs):
    rules = _dictionary(ctx, inputs)
    important = [s for s, _ in dictionary.pairs(rules.where(F.char_length("source") == 1), "custom_lexicon")] if rules is not None and cfg["keep_single_char_important_terms"] else []
    # All analyses read the filtered tokens; the texts stay behind.
    return {"filtered_token_corpus": ctx.kept(stats.filter_terms(inputs["token_corpus_in"], cfg["min_token_length"], cfg["min_term_frequency"], cfg["filter_numeric_tokens"], important).drop("raw_text", "clean_text", "normalized_text", "tokens"))}


@node("focus_terms")
def focus_terms(ctx, cfg, inputs):
    corpus, candidates = inputs["token_corpus_in"], inputs["term_table_in"]
    terms = features.focus_candidates(candidates, cfg["term_field"], cfg["selected_only"], cfg["project_keywords_only"], cfg["max_terms"], cfg["term_source"])
    kept = features.focus(corpus, terms, cfg["on_empty"])
    return {"focused_token_corpus": kept, "focus_term_summary": features.focus_summary(corpus, kept, terms, candidates, cfg["max_terms"], cfg["on_empty"], cfg["term_source"], cfg["term_field"])}


@node("manual_review_gate")
def manual_review_gate(ctx, cfg, inputs):
    tasks = inputs.get("review_tasks_in")
    tasks = tasks if tasks is not None else ctx.reviews if ctx.reviews is not None else ctx.spark.createDataFrame([], "id string, status string")
    a, b, s = relational.review_gate(inputs["payload_in"], tasks, cfg["review_id"], cfg["required_status"], cfg["on_missing"])
    return {"approved_payload": a, "blocked_payload": b, "review_gate_summary": s}


@node("split_corpus")
def split_corpus(ctx, cfg, inputs):
    return {"split_assignment_table": relational.split(inputs["corpus_in"], relational.parse_splits(cfg["splits_text"].replace(";", "\n")), cfg["seed"])}


@node("bucket_by_time")
def bucket_by_time(ctx, cfg, inputs):
    return {"time_bucket_table": relational.bucket_by_time(inputs["corpus_in"], cfg["field"], cfg["granularity"])}


@node("frequency_statistics")
def frequency_statistics(ctx, cfg, inputs):
    return {"frequency_table": stats.frequency(inputs["token_corpus_in"])}


@node("term_document_analysis")
def term_document_analysis(ctx, cfg, inputs):
    return {"term_document_table": stats.term_document(inputs["token_corpus_in"])}


@node("term_year_analysis")
def term_year_analysis(ctx, cfg, inputs):
    return {"term_year_table": stats.term_year(inputs["token_corpus_in"])}


@node("cooccurrence_analysis")
def cooccurrence_analysis(ctx, cfg, inputs):
    return {"cooccurrence_table": stats.cooccurrence(inputs["token_corpus_in"], cfg["cooccurrence_window"], cfg["min_cooccurrence"])}


@node("feature_term_selection")
def feature_term_selection(ctx, cfg, inputs):
    return {"feature_term_table": ctx.features(inputs["token_corpus_in"], cfg["feature_term_count"])}


@node("group_compare")
def group_compare(ctx, cfg, inputs):
    return {"group_metric_table": stats.group_compare(inputs["token_corpus_in"], cfg["group_field"], cfg["baseline_group"], listed(cfg["comparison_groups_text"]), cfg["min_frequency"])}


@node("similarity_analysis")
def similarity_analysis(ctx, cfg, inputs):
    corpus = inputs["token_corpus_in"]
    return {"similarity_table": features.similarity(ctx.weights(corpus), corpus, ctx.features(corpus, cfg["feature_term_count"]), cfg["min_similarity"], cfg["similarity_top_k"])}


@node("keyword_extraction")
def keyword_extraction(ctx, cfg, inputs):
    corpus = inputs["token_corpus_in"]
    weights = ctx.weights(corpus) if cfg["method"] == "tfidf" else None
    return {"keyword_table": features.keywords(corpus, cfg["method"], cfg["top_k_per_doc"], cfg["top_k_project"], weights)}


@node("keyword_clustering")
def keyword_clustering(ctx, cfg, inputs):
    corpus = inputs["token_corpus_in"]
    return {"keyword_cluster_table": models.keyword_clusters(ctx.weights(corpus), inputs["feature_term_table_in"], corpus, cfg["keyword_cluster_k"])}


def _topics(ctx, corpus, algorithm, k, top):
    return ctx.once(("topics", id(corpus), algorithm, k, top), lambda: models.topics(corpus, ctx.weights(corpus), ctx.features(corpus, 1000), k, algorithm, top))


@node("topic_modeling")
def topic_modeling(ctx, cfg, inputs):
    a, b, c = _topics(ctx, inputs["token_corpus_in"], cfg["topic_algorithm"], cfg["topic_model_k"], cfg["top_terms_per_topic"])
    return {"topic_term_table": a, "document_topic_table": b, "topic_summary_table": c}


@node("institution_keyword_analysis")
def institution_keyword_analysis(ctx, cfg, inputs):
    return {"institution_keyword_table": features.institution_keywords(inputs["corpus_in"], inputs["keyword_table_in"].where("scope = 'doc'"))}


@node("institution_topic_analysis")
def institution_topic_analysis(ctx, cfg, inputs):
    corpus = inputs["token_corpus_in"]
    terms, docs, _ = _topics(ctx, corpus, "nmf", cfg["topic_model_k"], 5)
    return {"institution_topic_table": features.institution_topics(corpus, docs, terms)}


@node("keyness_analysis")
def keyness_analysis(ctx, cfg, inputs):
    return {"keyness_table": stats.keyness(inputs["token_corpus_in"], cfg["group_field"], cfg["baseline_group"], cfg["comparison_group"], cfg["min_frequency"])}


@node("document_clustering")
def document_clustering(ctx, cfg, inputs):
    corpus = inputs["token_corpus_in"]
    return {"document_cluster_table": models.document_clusters(corpus, ctx.weights(corpus), ctx.features(corpus, 1000), cfg["document_cluster_k"])}


@node("build_network")
def build_network(ctx, cfg, inputs):
    nodes, edges = graph.build_network(inputs["cooccurrence_table_in"], cfg["min_edge_weight"], cfg["max_edges"])
    return {"graph_node_table": nodes, "graph_edge_table": ctx.kept(edges)}


@node("graph_metrics")
def graph_metrics(ctx, cfg, inputs):
    return {"graph_metric_table": graph.metrics(inputs["graph_edge_table_in"])}


@node("community_detection")
def community_detection(ctx, cfg, inputs):
    return {"community_table": graph.communities(inputs["graph_edge_table_in"], cfg["community_method"])}


@node("cluster_evaluation")
def cluster_evaluation(ctx, cfg, inputs):
    return {"cluster_evaluation_table": models.evaluate(inputs["document_cluster_table_in"])}


@node("main_path_analysis")
def main_path_analysis(ctx, cfg, inputs):
    return {"main_path_table": graph.main_path(inputs["graph_edge_table_in"], cfg["main_path_mode"])}


@node("link_prediction")
def link_prediction(ctx, cfg, inputs):
    return {"link_prediction_table": graph.link_prediction(inputs["graph_edge_table_in"], cfg["link_prediction_top_n"])}


@node("technology_indicators")
def technology_indicators(ctx, cfg, inputs):
    year = cfg["indicator_current_year"] or datetime.date.today().year
    return {"technology_indicator_table": technology.indicators(inputs["term_year_table_in"], inputs.get("graph_metric_table_in"), int(year))}


@node("technology_classification")
def technology_classification(ctx, cfg, inputs):
    return {"technology_classification_table": technology.classify(inputs["technology_indicator_table_in"], **{k: cfg[f"threshold_{k}"] for k in technology.THRESHOLDS})}


@node("join_results")
def join_results(ctx, cfg, inputs):
    return {"joined_table": relational.join_results(inputs["left_table_in"], inputs["right_table_in"], listed(cfg["join_keys_text"]), cfg["join_type"])}


@node("result_gate")
def result_gate(ctx, cfg, inputs):
    a, b, s = relational.gate(inputs["metric_table_in"], inputs.get("payload_in"), cfg["metric_name"], cfg["operator"], cfg["threshold"], cfg["metric_name_field"], cfg["metric_field"])
    return {"passed_table": a, "blocked_table": b, "gate_summary": s}


def _export(ctx, cfg, tables: dict, kind: str) -> dict:
    path = os.path.join(ctx.folder, cfg["file_prefix"])
    if not cfg[f"export_{'html_report' if kind == 'html' else kind}"]:
        return {"artifact": {}}
    os.makedirs(ctx.folder, exist_ok=True)
    if kind == "csv":
        return {"artifact": writers.write_csv(tables, path)}
    if kind == "xlsx":
        return {"artifact": {"workbook": writers.write_workbook(tables, f"{path}.xlsx")}}
    if kind == "png":
        return {"artifact": writers.write_charts(tables, path, cfg["chart_dpi"])}
    audit = next((t for k, t in tables.items() if "rule_type" in t.columns), None) if cfg["include_audit"] else None
    return {"artifact": {"report": writers.write_report(tables, f"{path}.html", audit=audit)}}


for _name, _kind, _port in (("save_csv", "csv", "table_in"), ("save_xlsx", "xlsx", "table_in"), ("save_png", "png", "render_in"), ("save_html_report", "html", "report_in")):
    EXECUTORS[_name] = lambda ctx, cfg, inputs, kind=_kind, port=_port: _export(ctx, cfg, inputs[port], kind)
for _name in ("note", "group"):
    EXECUTORS[_name] = lambda ctx, cfg, inputs: {}
