"""The node catalog: ports, parameters and their defaults.

A line is `type @category: inputs -> outputs | parameters`. A port is
`name Type`, with `*` if it takes several edges and `?` if it may stay open;
a parameter is `name=default`, enumerations as `name=default{a,b}`; T and F are
booleans, an empty default is an empty string, `null` is none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Names of nodes, ports, port types and parameters, and defaults.
CATALOG = """
corpus_input @input: -> corpus CorpusTable | resource_mode=project_corpus{project_corpus}, mode=all_documents{all_documents,filtered_subset,selected_documents}, year_from=null, year_to=null
dictionary_input @input: -> dictionary_set DictionarySet | resource_mode=project_dictionary{project_dictionary}, resource_id=project:dictionary_set, use_custom_lexicon=T, use_phrase_lexicon=T, apply_regex_rules=T, apply_standard_terms=T, apply_synonym_map=T, apply_near_synonym_map=T, apply_stopwords=T, apply_exclusion_terms=T
merge_corpora @process: corpus_in CorpusTable* -> corpus CorpusTable | strategy=append{append,dedupe}
select_dictionary_tables @process: dictionary_set_in DictionarySet -> dictionary_set DictionarySet | selected_table_ids_text=standard-project,synonym_map
overlay_dictionary_rules @process: dictionary_set_in DictionarySet -> dictionary_set DictionarySet | overlay_rows_text=standard_terms|llm|large language model|true
normalize_metadata @process: corpus_in CorpusTable -> normalized_corpus CorpusTable, metadata_audit_table MetadataAuditTable | institution_aliases_text=, country_aliases_text=, category_aliases_text=, split_delimiters=;；|, keep_first_institution=T, year_source_field=year
filter_by_metadata @process: corpus_in CorpusTable -> filtered_corpus CorpusTable | field=institution, operator=in{in,not_in,contains,eq}, values_text=OpenAI
deduplicate_documents @process: corpus_in CorpusTable -> deduped_corpus CorpusTable | dedupe_keys_text=title,year, strategy=keep_first{keep_first}
sample_corpus @process: corpus_in CorpusTable -> sampled_corpus CorpusTable | sample_mode=random{random}, sample_size=200, sample_ratio=null, seed=42
clean_text @process: corpus_in CorpusTable -> clean_corpus CleanCorpus | strip_html=T, strip_urls=T, strip_email=F, strip_phone=F, normalize_whitespace=T, normalize_punctuation=T, full_half_width_normalize=T, lowercase_english=T, remove_emoji=F, remove_special_chars=F
normalize_text @process: corpus_in CleanCorpus, dictionary_set_in DictionarySet? -> normalized_corpus NormalizedCorpus | convert_traditional_to_simplified=F, normalize_numbers=F, normalize_time_expr=F, apply_regex_rules=T, regex_rule_priority=rule_order{rule_order,first_match}
tokenize @process: corpus_in NormalizedCorpus, dictionary_set_in DictionarySet? -> token_corpus TokenCorpus | language_mode=mixed{auto,zh,en,mixed}, tokenizer_backend=default{default}, use_custom_lexicon=T, use_phrase_lexicon=T, preserve_domain_phrases=T, split_hyphenated_terms=T, split_slash_terms=F, normalize_camel_case=T, keep_original_order=T, min_token_length_before_filter=1, enable_ngrams=F, ngram_min=2, ngram_max=2
conditional_router @process: corpus_in CorpusTable?, table_in AnyTable? -> matched_corpus CorpusTable, unmatched_corpus CorpusTable, matched_table AnyTable, unmatched_table AnyTable, route_summary AnyTable | source_kind=corpus_metadata{corpus_metadata,table_field,comparison_result}, field=institution, operator=in{in,not_in,contains,eq,neq,gt,gte,lt,lte}, values_text=OpenAI
apply_dictionary_rules @process: token_corpus_in TokenCorpus, dictionary_set_in DictionarySet -> token_corpus TokenCorpus, audit_table AuditTable | apply_standard_terms=T, apply_synonym_map=T, apply_near_synonym_map=T, apply_stopwords=T, apply_exclusion_terms=T, conflict_resolution=priority{priority,first_match}
filter_terms @process: token_corpus_in TokenCorpus, dictionary_set_in DictionarySet? -> filtered_token_corpus FilteredTokenCorpus | min_term_frequency=1, min_token_length=2, filter_numeric_tokens=F, filter_by_pos=F, keep_single_char_important_terms=T
focus_terms @process: token_corpus_in FilteredTokenCorpus, term_table_in AnyTable -> focused_token_corpus FilteredTokenCorpus, focus_term_summary AnyTable | term_source=auto{auto,feature_terms,keywords}, term_field=auto, max_terms=80, selected_only=T, project_keywords_only=T, on_empty=pass_through{pass_through,empty}
manual_review_gate @process: payload_in AnyTable, review_tasks_in AnyTable? -> approved_payload AnyTable, blocked_payload AnyTable, review_gate_summary AnyTable | review_id=, required_status=resolved{resolved,open}, on_missing=block{block,pass}
split_corpus @analysis: corpus_in CorpusTable -> split_assignment_table AnyTable | split_strategy=ratio{ratio}, splits_text=train:0.7;test:0.3, seed=42
bucket_by_time @analysis: corpus_in CorpusTable -> time_bucket_table AnyTable | field=year, granularity=year{year,5_year,decade}
frequency_statistics @analysis: token_corpus_in FilteredTokenCorpus -> frequency_table FrequencyTable | top_n=200
term_document_analysis @analysis: token_corpus_in FilteredTokenCorpus -> term_document_table TermDocumentTable |
term_year_analysis @analysis: token_corpus_in FilteredTokenCorpus -> term_year_table TermYearTable |
cooccurrence_analysis @analysis: token_corpus_in FilteredTokenCorpus -> cooccurrence_table CooccurrenceTable | cooccurrence_window=5, min_cooccurrence=2
feature_term_selection @analysis: token_corpus_in FilteredTokenCorpus -> feature_term_table FeatureTermTable | feature_term_count=1000{100,500,1000,all}
group_compare @analysis: token_corpus_in FilteredTokenCorpus -> group_metric_table AnyTable | group_field=institution, baseline_group=OpenAI, comparison_groups_text=Anthropic,Google, min_frequency=1
similarity_analysis @analysis: token_corpus_in FilteredTokenCorpus -> similarity_table AnyTable | similarity_method=cosine{cosine}, min_similarity=0.2, similarity_top_k=200, feature_term_count=1000
keyword_extraction @analysis: token_corpus_in FilteredTokenCorpus -> keyword_table KeywordTable | method=auto{auto,tfidf,yake}, top_k_per_doc=10, top_k_project=100
keyword_clustering @analysis: feature_term_table_in FeatureTermTable, token_corpus_in FilteredTokenCorpus -> keyword_cluster_table KeywordClusterTable | keyword_cluster_k=4, topic_model_k=4
topic_modeling @analysis: token_corpus_in FilteredTokenCorpus -> topic_term_table AnyTable, document_topic_table AnyTable, topic_summary_table AnyTable | topic_algorithm=nmf{nmf,lda}, topic_model_k=4, top_terms_per_topic=5
institution_keyword_analysis @analysis: keyword_table_in KeywordTable, corpus_in CorpusTable -> institution_keyword_table InstitutionKeywordTable |
keyness_analysis @analysis: token_corpus_in FilteredTokenCorpus -> keyness_table AnyTable | group_field=institution, baseline_group=OpenAI, comparison_group=Anthropic, min_frequency=2
institution_topic_analysis @analysis: token_corpus_in FilteredTokenCorpus -> institution_topic_table InstitutionTopicTable | topic_model_k=4
document_clustering @analysis: token_corpus_in FilteredTokenCorpus -> document_cluster_table DocumentClusterTable | document_cluster_k=4
build_network @analysis: cooccurrence_table_in CooccurrenceTable -> graph_node_table GraphNodeTable, graph_edge_table GraphEdgeTable | min_edge_weight=1, max_edges=5000
graph_metrics @analysis: graph_node_table_in GraphNodeTable, graph_edge_table_in GraphEdgeTable -> graph_metric_table GraphMetricTable |
community_detection @analysis: graph_node_table_in GraphNodeTable, graph_edge_table_in GraphEdgeTable -> community_table CommunityTable | community_method=greedy_modularity{greedy_modularity,label_propagation}
cluster_evaluation @analysis: document_cluster_table_in DocumentClusterTable -> cluster_evaluation_table AnyTable |
main_path_analysis @analysis: graph_node_table_in GraphNodeTable, graph_edge_table_in GraphEdgeTable -> main_path_table MainPathTable | main_path_mode=directed_citation_or_weighted_backbone{directed_citation_or_weighted_backbone,cooccurrence_backbone}
link_prediction @analysis: graph_node_table_in GraphNodeTable, graph_edge_table_in GraphEdgeTable -> link_prediction_table LinkPredictionTable | link_prediction_top_n=200
technology_indicators @analysis: term_year_table_in TermYearTable, graph_metric_table_in GraphMetricTable? -> technology_indicator_table TechnologyIndicatorTable | indicator_current_year=null
technology_classification @analysis: technology_indicator_table_in TechnologyIndicatorTable -> technology_classification_table TechnologyClassificationTable | threshold_emerging_novelty=0.65, threshold_emerging_growth=1.5, threshold_disruptive=0.65, threshold_core=0.65, threshold_declining_growth=0.75, threshold_declining_maturity=0.4
join_results @analysis: left_table_in AnyTable, right_table_in AnyTable -> joined_table AnyTable | left_artifact=frequency_table, right_artifact=keyness_table, join_keys_text=term, join_type=inner{inner,left,right,outer}
result_gate @analysis: metric_table_in AnyTable, payload_in AnyTable -> passed_table AnyTable, blocked_table AnyTable, gate_summary AnyTable | metric_artifact=cluster_evaluation_table, metric_name=silhouette_score, metric_name_field=metric, metric_field=value, operator=gte{gte,gt,lte,lt,eq,neq}, threshold=0.5
save_csv @output: table_in AnyTable* -> artifact ExportArtifact | file_prefix=tables, export_csv=T
save_xlsx @output: table_in AnyTable* -> artifact ExportArtifact | file_prefix=tables, export_xlsx=T
save_png @output: render_in AnyRenderable* -> artifact ExportArtifact | file_prefix=charts, export_png=T, chart_dpi=320
save_html_report @output: report_in AnyAnalysisResult* -> artifact ExportArtifact | file_prefix=report, export_html_report=T, include_audit=T
note @utility: -> | text=备注
group @utility: -> | title=分组
"""
#: Corpus port types from early to late: an earlier stage may feed a later port.
LADDER = ("CorpusTable", "ProjectCorpus", "ScopedCorpus", "CleanCorpus", "NormalizedCorpus", "TokenCorpus", "FilteredTokenCorpus")
TABLES = frozenset(
    "FrequencyTable TermDocumentTable TermYearTable CooccurrenceTable FeatureTermTable KeywordTable KeywordClusterTable InstitutionKeywordTable InstitutionTopicTable DocumentClusterTable "
    "AuditTable MetadataAuditTable GraphNodeTable GraphEdgeTable GraphMetricTable CommunityTable MainPathTable LinkPredictionTable TechnologyIndicatorTable TechnologyClassificationTable".split()
)
RENDERABLE = frozenset("FrequencyTable KeywordTable TermYearTable CooccurrenceTable DocumentClusterTable KeywordClusterTable InstitutionTopicTable AnyTable".split())

CATEGORIES = ("input", "process", "analysis", "output", "utility")


@dataclass(frozen=True)
class Port:
    name: str
    type: str
    multiple: bool = False
    optional: bool = False


@dataclass(frozen=True)
class Param:
    name: str
    default: object
    options: tuple[str, ...] = ()


@dataclass(frozen=True)
class Node:
    type: str
    category: str
    inputs: tuple[Port, ...] = ()
    outputs: tuple[Port, ...] = ()
    params: tuple[Param, ...] = field(default=())

    def defaults(self) -> dict:
        return {p.name: p.default for p in self.params}

    def faults(self) -> list[str]:
        """What is wrong with the definition itself."""
        out = [] if self.type.strip() else ["a node needs a type"]
        if self.category not in CATEGORIES:
            out.append(f"category {self.category!r} is not one of {', '.join(CATEGORIES)}")
        ports = (*self.inputs, *self.outputs)
        out += [f"port {p.name!r}: needs a name and a type" for p in ports if not (p.name.strip() and p.type.strip())]
        out += [f"output {p.name!r}: only inputs may be multiple or optional" for p in self.outputs if p.multiple or p.optional]
        for kind, names in (("port", [p.name for p in ports]), ("parameter", [p.name for p in self.params])):
            out += [f"{kind} {n!r}: is there {names.count(n)} times" for n in dict.fromkeys(names) if names.count(n) > 1]
        for p in self.params:
            if not p.name.strip():
                out.append("a parameter needs a name")
            if not isinstance(p.default, str | bool | int | float | None):
                out.append(f"parameter {p.name!r}: a default is text, a number, a boolean or none")
            elif p.options and str(p.default) not in p.options:
                out.append(f"parameter {p.name!r}: its default {p.default!r} is not one of its options")
        return out

    def problems(self, config: dict) -> list[str]:
        """What is wrong with a configuration: unknown options and kinds that don't fit."""
        out = []
        for p in self.params:
            v = config.get(p.name, p.default)
            if p.options and str(v) not in p.options:
                out.append(f"{p.name}: {v!r} is not one of {', '.join(p.options)}")
            elif isinstance(p.default, bool) and not isinstance(v, bool):
                out.append(f"{p.name}: {v!r} is no boolean")
        return out


def _default(text: str) -> object:
    if text in ("T", "F"):
        return text == "T"
    if text == "null":
        return None
    return int(text) if re.fullmatch(r"-?\d+", text) else float(text) if re.fullmatch(r"-?\d+\.\d+", text) else text


def _port(text: str) -> Port:
    name, kind = text.split()
    return Port(name, kind.rstrip("*?"), "*" in kind, "?" in kind)


def parse_node(line: str) -> Node:
    head, rest = line.split(":", 1)
    kind, category = head.split(" @")
    ports, params = rest.split(" |", 1) if " |" in rest else (rest, "")
    inputs, outputs = (tuple(_port(p) for p in side.split(",") if p.strip()) for side in ports.split("->"))
    found = []
    for part in re.split(r", (?=\w+=)", params.strip()):
        if part:
            name, value = part.split("=", 1)
            m = re.fullmatch(r"(.*)\{(.*)\}", value)
            found.append(Param(name, _default(m[1] if m else value), tuple(m[2].split(",")) if m else ()))
    return Node(kind, category, inputs, outputs, tuple(found))


NODES = {n.type: n for n in map(parse_node, filter(None, CATALOG.splitlines()))}


def compatible(source: str, target: str) -> bool:
    """Whether an output of one port type may feed an input of another."""
    if source == target:
        return True
    if target == "AnyTable":
        return source in TABLES
    if target == "AnyRenderable":
        return source in RENDERABLE
    if target == "AnyAnalysisResult":
        return source in TABLES or source == "AnyTable"
    if source in LADDER and target in LADDER:
        return LADDER.index(source) <= LADDER.index(target)
    return False
