"""Governed dictionaries: selection, overlays, rules over tokens, audit and hits.

Entries are a small governed table (a lexicon, not data that grows with the
corpus); its size is checked before its maps go into a plan as constants
(MOST_CONSTANTS), and larger ones are joined instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..schemas import DICTIONARY

MOST_CONSTANTS = 5_000
RULES = ("standard_terms", "synonym_map", "near_synonym_map")


def entries(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """A dictionary of (kind, source, target[, enabled[, table_id]]) rows."""
    full = [(f"{r[0]}-{k}", r[0], "project", r[4] if len(r) > 4 else r[0], r[1], r[2], r[3] if len(r) > 3 else True, 0, [], None, k) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, DICTIONARY)


def select_tables(dictionary: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Entries of the tables or kinds named, whatever their case."""
    names = [w.strip().lower() for w in wanted if w.strip()]
    return dictionary.where(F.lower("table_id").isin(names) | F.lower("kind").isin(names))


def overlay(dictionary: DataFrame, text: str) -> DataFrame:
    """The dictionary and `kind|source|target|enabled` lines after it, which win over equal sources."""
    rows = []
    for line in filter(None, (x.strip() for x in text.splitlines())):
        kind, source, target, enabled = [*(p.strip() for p in line.split("|")), "", "", ""][:4]
        if kind and source:
            rows.append((kind, source, target or None, enabled.lower() not in ("false", "0", "no", "off"), "overlay"))
    if not rows:
        return dictionary
    top = dictionary.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("__top"))
    added = entries(dictionary.sparkSession, rows).join(F.broadcast(top)).withColumn("ordinal", F.col("ordinal") + F.col("__top") + 1).drop("__top")
    return dictionary.unionByName(added)


def flattened(dictionary: DataFrame) -> DataFrame:
    """Enabled entries, each (kind, source, target) once whatever its case."""
    on = dictionary.where(F.coalesce("enabled", F.lit(True)) & (F.trim("source") != ""))
    place = F.row_number().over(W.partitionBy("kind", F.lower("source"), F.lower(F.coalesce("target", F.lit("")))).orderBy("ordinal"))
    return on.withColumn("__place", place).where("__place = 1").drop("__place")


def rule_table(dictionary: DataFrame) -> DataFrame:
    """kind, source (lower-case), target: of equal sources the last entry wins."""
    on = flattened(dictionary).select("kind", F.lower("source").alias("source"), "target", "ordinal")
    return on.groupBy("kind", "source").agg(F.max_by("target", "ordinal").alias("target"))


def few_pairs(dictionary: DataFrame, kind: str, most: int) -> list[tuple[str, str]] | None:
    """(source, target) of a kind in order; None if there are more than `most`."""
    rows = flattened(dictionary).where(F.col("kind") == kind).orderBy("ordinal").select("source", "target").limit(most + 1).collect()
    return None if len(rows) > most else [(r["source"], r["target"] or "") for r in rows]


def pairs(dictionary: DataFrame, kind: str) -> list[tuple[str, str]]:
    """(source, target) of a kind in order, for pattern rules, which run one after the other; ValueError beyond the bound."""
    rows = few_pairs(dictionary, kind, MOST_CONSTANTS)
    if rows is None:
        raise ValueError(f"more than {MOST_CONSTANTS} enabled entries of {kind}")
    return rows


def decided(token: Column, maps: dict[str, Column], on: set[str]) -> Column:
    """struct(source, target, rule, key, action) of a token under the rule maps."""
    low = F.lower(token)

    def has(kind: str, key: Column) -> Column:
        return F.map_contains_key(maps[kind], key) if kind in maps and kind in on else F.lit(False)

    def made(target: Column, rule: Column | str, key: Column, action: str) -> Column:
        rule = F.lit(rule) if isinstance(rule, str) else rule
        return F.struct(token.alias("source"), target.alias("target"), rule.alias("rule"), key.alias("key"), F.lit(action).alias("action"))

    none = F.lit(None).cast("string")
    rule, target = F.lit("keep"), token
    for kind in reversed(RULES):
        rule = F.when(has(kind, low), F.lit(kind)).otherwise(rule)
        value = F.try_element_at(maps[kind], low) if kind in maps else none
        target = F.when(has(kind, low), F.coalesce(F.when(value != "", value), token)).otherwise(target)
    stopped = made(target, "stopwords", F.lower(target), "drop")
    kept = F.when(rule == "keep", made(target, "keep", token, "keep")).otherwise(made(target, rule, low, "replace"))
    return F.when(has("exclusion_terms", low), made(none, "exclusion_terms", low, "drop")).otherwise(F.when(has("stopwords", F.lower(target)), stopped).otherwise(kept))


def decisions(corpus: DataFrame, dictionary: DataFrame, off: Sequence[str] = (), tokens: str = "tokens") -> DataFrame:
    """The corpus with the column `decisions`: one struct a token, in order.

    Small dictionaries are looked up as constants inside generated code, with no
    shuffle; larger ones than MOST_CONSTANTS by a join of the corpus's distinct
    tokens, whose decisions are then joined back token by token.
    """
    kinds = (*RULES, "stopwords", "exclusion_terms")
    on = set(kinds) - set(off)
    rules = rule_table(dictionary).where(F.col("kind").isin(list(on)))
    rows = rules.limit(MOST_CONSTANTS + 1).collect()
    if len(rows) <= MOST_CONSTANTS:
        maps = {}
        for kind in kinds:
            own = [(r["source"], r["target"]) for r in rows if r["kind"] == kind]
            if own:
                maps[kind] = F.map_from_arrays(F.array(*(F.lit(s) for s, _ in own)), F.array(*(F.lit(t).cast("string") for _, t in own)))
        return corpus.withColumn("decisions", F.transform(tokens, lambda t: decided(t, maps, on)))
    wide = rules.groupBy("source").pivot("kind", list(kinds)).agg(F.first(F.struct("target")))
    vocabulary = corpus.select(F.explode(tokens).alias("token")).distinct()
    joined = vocabulary.join(wide, F.lower("token") == wide["source"], "left")
    maps = {k: F.when(F.col(k).isNotNull(), F.create_map(F.lower("token"), F.col(k)["target"])).otherwise(F.create_map().cast("map<string,string>")) for k in kinds}
    stop = wide.where(F.col("stopwords").isNotNull()).select(F.col("source").alias("stop"))
    first = joined.select("token", decided(F.col("token"), maps, on - {"stopwords"}).alias("d"))
    first = first.join(stop, F.lower(F.col("d.target")) == F.col("stop"), "left")
    d = F.when(F.col("stop").isNotNull() & (F.col("d.rule") != "exclusion_terms"), F.struct(F.col("d.source").alias("source"), F.col("d.target").alias("target"), F.lit("stopwords").alias("rule"), F.col("stop").alias("key"), F.lit("drop").alias("action"))).otherwise(F.col("d"))
    table = first.select("token", d.alias("d"))
    placed = corpus.select("doc_id", F.posexplode(tokens).alias("pos", "token")).join(table, "token")
    listed = placed.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "d"))).alias("l")).select("doc_id", F.col("l.d").alias("decisions"))
    return corpus.join(listed, "doc_id", "left").withColumn("decisions", F.coalesce("decisions", F.array().cast(listed.schema["decisions"].dataType)))


def apply(corpus: DataFrame, dictionary: DataFrame, off: Sequence[str] = (), tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """The corpus with ruled tokens, and the audit of replaced and dropped ones."""
    both = decisions(corpus, dictionary, off, tokens)
    kept = F.transform(F.filter("decisions", lambda d: d["action"] != "drop"), lambda d: d["target"])
    # Only what changed leaves the array; explode_outer doesn't compute it twice.
    changed = F.filter(F.transform("decisions", lambda d, i: F.struct(i.alias("position"), d.alias("d"))), lambda x: x["d"]["action"] != "keep")
    audit = both.select("doc_id", F.explode_outer(changed).alias("x")).where("x is not null").select("doc_id", "x.position", "x.d")
    audit = audit.select(
        "doc_id", F.col("position").cast("int").alias("position"), F.col("d.source").alias("source_term"), F.col("d.target").alias("target_term"),
        F.col("d.rule").alias("rule_type"), F.concat(F.col("d.rule"), F.lit(".json")).alias("rule_source"), F.col("d.key").alias("rule_key"), F.col("d.action").alias("action"),
    )
    return both.withColumn(tokens, kept).drop("decisions"), audit


def hits(audit: DataFrame) -> DataFrame:
    """Hits of each rule."""
    return audit.groupBy("rule_type", "rule_key").agg(F.count("*").alias("hits"))


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("rule_type", "action").agg(F.count("*").alias("count"))


def search_entries(dictionary: DataFrame, query: str) -> DataFrame:
    """Entries that hold the query in source, target, notes or a tag."""
    q = query.strip().lower()
    has = lambda c: F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False))
    return dictionary.where(has("source") | has("target") | has("notes") | F.coalesce(F.exists("tags", lambda t: F.lower(t).contains(q)), F.lit(False))) if q else dictionary


def total_hits(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("kind", "table_id").agg(F.sum(F.coalesce("hits", F.lit(0))).alias("total_hits"))


def merged(baseline: DataFrame, project: DataFrame) -> DataFrame:
    """Baseline entries with the project's over them, by kind, table and source."""
    both = baseline.withColumn("__level", F.lit(0)).unionByName(project.withColumn("__level", F.lit(1)))
    place = F.row_number().over(W.partitionBy("kind", "table_id", F.lower("source")).orderBy(F.desc("__level"), F.desc("ordinal")))
    return both.withColumn("__place", place).where("__place = 1").drop("__place", "__level")
