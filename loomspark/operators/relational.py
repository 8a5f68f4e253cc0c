"""Filters, routing, gates, joins, set operations, sampling and metadata.

All of them are declarative plans. Those whose result depends on an order use
row_order where it is there and doc_id else, with a hash as the last tie-break,
so a result never depends on how rows were dealt.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values
from ..schemas import lookup

# --- predicates --------------------------------------------------------------


def text_of(c: Column) -> Column:
    """A value for metadata comparisons: null, zero and false count as empty."""
    t = c.cast("string")
    return F.when(t.isNull() | t.isin("0", "0.0", "false"), "").otherwise(t)


def condition(df: DataFrame, field: str, operator: str, wanted: Sequence) -> Column:
    """in, not_in, contains (any of them), eq (the first) on a field as text."""
    c, wanted = text_of(lookup(df, field)), [str(v) for v in wanted]
    if operator == "in":
        return c.isin(wanted)
    if operator == "not_in":
        return ~c.isin(wanted)
    if operator == "contains":
        return reduce(lambda a, b: a | b, (c.contains(v) for v in wanted), F.lit(False))
    if operator == "eq":
        return c == (wanted[0] if wanted else "")
    raise ValueError(f"unknown operator {operator}")


def filter_by_metadata(df: DataFrame, conditions: Sequence[tuple[str, str, Sequence]]) -> DataFrame:
    """Rows that meet all (field, operator, values); a field that is no column is looked up in extra_metadata."""
    return reduce(lambda d, c: d.where(condition(df, *c)), conditions, df)


def comparison(df: DataFrame, field: str, operator: str, wanted: Sequence) -> Column:
    """The router's comparisons: those above and neq, gt, gte, lt, lte, by number
    where both sides are numbers and by text else; never null."""
    if operator in ("in", "not_in", "contains"):
        return F.coalesce(condition(df, field, operator, wanted), F.lit(False))
    c, target = lookup(df, field), str(wanted[0]) if wanted else ""
    kind = df.schema[field].dataType.simpleString() if field in df.columns else "string"
    a, b = values.number(F.col(field) if field in df.columns else c, kind), values.number(F.lit(target))
    both, x, y = a.isNotNull() & b.isNotNull(), F.coalesce(c, F.lit("")), F.lit(target)
    signs = {
        "eq": (a == b, x == y), "neq": (a != b, x != y), "gt": (a > b, x > y), "gte": (a >= b, x >= y), "lt": (a < b, x < y), "lte": (a <= b, x <= y),
    }
    by_number, by_text = signs[operator]
    return F.coalesce(F.when(both, by_number).otherwise(by_text if operator in ("eq", "neq") else F.lit(False)), F.lit(False))


def route(corpus: DataFrame | None, table: DataFrame | None, kind: str, field: str, operator: str, wanted: Sequence) -> dict[str, DataFrame]:
    """matched_ and unmatched_ rows of the corpus and of the table, each of which
    the condition is put to, and a one-row summary. Its counts are the corpus's,
    or the table's where there are no documents."""
    out: dict[str, DataFrame] = {}
    zero = (corpus if corpus is not None else table).sparkSession.range(1).select(F.lit(field).alias("field"))
    for name, df in (("corpus", corpus), ("table", table)):
        if df is None:
            zero = zero.withColumns({f"{name}_matched": F.lit(0).cast("long"), f"{name}_unmatched": F.lit(0).cast("long")})
            continue
        fits = comparison(df, field, operator, wanted)
        out[f"matched_{name}"], out[f"unmatched_{name}"] = df.where(fits), df.where(~fits)
        counts = df.agg(F.count_if(fits).alias(f"{name}_matched"), F.count_if(~fits).alias(f"{name}_unmatched"))
        zero = zero.join(F.broadcast(counts))  # one row each
    some = F.col("corpus_matched") + F.col("corpus_unmatched") > 0
    count = lambda side: F.when(some, F.col(f"corpus_{side}")).otherwise(F.col(f"table_{side}")).alias(f"{side}_count")
    out["route_summary"] = zero.select(
        F.lit(kind).alias("source_kind"), "field", F.lit(operator).alias("operator"), F.array(*(F.lit(str(v)) for v in wanted)).cast("array<string>").alias("values"),
        count("matched"), count("unmatched"), (F.col("corpus_matched") + F.col("corpus_unmatched")).alias("corpus_input_count"),
        (F.col("table_matched") + F.col("table_unmatched")).alias("table_input_count"),
    )
    return out


def gate(metrics: DataFrame, payload: DataFrame | None, name: str, operator: str, threshold: float, name_field: str = "metric", value_field: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole payload (without one, the metrics) passes or none of it: passed,
    blocked, summary.

    The metric row is the first whose name_field is `name`; else, where `name` is
    a column, the first row; else the first with row_type overall; else the first.
    Its value is that of value_field, or of the column `name` where that is null.
    Rows are in the order in which they are read. One row is broadcast; the
    payload isn't collected.
    """
    rows = metrics.withColumn("__at", F.monotonically_increasing_id())
    rank = F.lit(3)
    if "row_type" in metrics.columns:
        rank = F.when(F.lower(F.col("row_type")) == "overall", 2).otherwise(rank)
    if name and name in metrics.columns:
        rank = F.lit(1)
    if name:
        rank = F.when(lookup(metrics, name_field) == name, 0).otherwise(rank)
    shown = F.coalesce(lookup(metrics, value_field), *([F.col(name).cast("string")] if name and name in metrics.columns else []))
    first = rows.agg(F.min_by(F.struct(shown.alias("v")), F.struct(rank, "__at"))["v"].alias("observed"))
    a, b = F.col("observed").try_cast("double"), F.lit(float(threshold))
    numbers = {"gte": a >= b, "gt": a > b, "lte": a <= b, "lt": a < b, "eq": a == b, "neq": a != b}[operator]
    words = {"eq": F.col("observed") == F.lit(str(threshold)), "neq": F.coalesce(F.col("observed"), F.lit("")) != F.lit(str(threshold))}.get(operator, F.lit(False))
    one = first.withColumn("passed", F.coalesce(F.when(a.isNotNull(), numbers).otherwise(words), F.lit(False)))
    payload = metrics if payload is None else payload
    both = payload.join(F.broadcast(one.select(F.col("passed").alias("__passed"))))
    size = payload.agg(F.count("*").alias("input_count"))
    summary = one.join(F.broadcast(size)).select(  # one row each
        F.lit(name or value_field).alias("metric"), F.lit(value_field).alias("metric_field"), F.lit(operator).alias("operator"), b.alias("threshold"), a.alias("observed_value"), "passed", "input_count",
    )
    return both.where("__passed").drop("__passed"), both.where("not __passed").drop("__passed"), summary


def review_gate(payload: DataFrame, tasks: DataFrame, review_id: str, required: str = "resolved", on_missing: str = "block") -> tuple[DataFrame, DataFrame, DataFrame]:
    """approved, blocked, summary: the payload passes if the review task has the required status (or is missing and may be)."""
    one = tasks.where(F.col("id") == review_id).agg(F.min("status").alias("status"))
    one = one.withColumn("passed", F.when(F.col("status").isNull(), F.lit(on_missing == "pass")).otherwise(F.col("status") == required))
    both = payload.join(F.broadcast(one.select(F.col("passed").alias("__passed"))))
    summary = one.select(F.lit(review_id).alias("review_id"), F.lit(required).alias("required_status"), F.coalesce("status", F.lit("missing")).alias("review_status"), "passed")
    return both.where("__passed").drop("__passed"), both.where("not __passed").drop("__passed"), summary


def scope(df: DataFrame, sources: Sequence[str] = (), institutions: Sequence[str] = (), categories: Sequence[str] = (), year_from: int | None = None, year_to: int | None = None, doc_ids: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """The corpus scope: value lists, an inclusive year range (a null year fails it), or chosen documents."""
    for field, wanted in (("source", sources), ("institution", institutions), ("category_or_tag", categories)):
        if wanted:
            df = df.where(F.col(field).isin(list(wanted)))
    if year_from is not None:
        df = df.where(F.col("year") >= year_from)
    if year_to is not None:
        df = df.where(F.col("year") <= year_to)
    if isinstance(doc_ids, DataFrame):
        return df.join(doc_ids.select("doc_id"), "doc_id", "left_semi")
    return df if doc_ids is None else df.where(F.col("doc_id").isin([str(i) for i in doc_ids]))


def view(df: DataFrame, spec: dict) -> DataFrame:
    """A saved view: {field: value | list | {operator, value(s)}}, all of them met."""
    for field, rule in spec.items():
        if isinstance(rule, dict):
            wanted = rule.get("values", rule.get("value", []))
            rule = (rule.get("operator", "eq"), wanted if isinstance(wanted, (list, tuple)) else [wanted])
        else:
            rule = ("in", rule) if isinstance(rule, (list, tuple)) else ("eq", [rule])
        df = df.where(condition(df, field, *rule))
    return df


def search(df: DataFrame, query: str, fulltext: bool = False, fields: Sequence[str] = ("title", "institution", "source", "category_or_tag")) -> DataFrame:
    """Documents that hold the query, whatever its case; a blank query finds all."""
    query = query.strip().lower()
    if not query:
        return df
    names = [*fields, *(["raw_text"] if fulltext else [])]
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(F.lower(lookup(df, n)).contains(query), F.lit(False)) for n in names)))


def page(df: DataFrame, number: int, size: int = 12, order: Sequence[str | Column] = ("row_order",)) -> DataFrame:
    """One page of the rows in order, pages counted from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


# --- joins and set operations ------------------------------------------------


def join_results(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on named keys where null meets null; clashing right columns get the suffix _right.

    Without keys, or with a key that one side lacks, the result is empty; an unknown kind of join is inner.
    """
    keys = [k.strip() for k in keys if k.strip()]
    own = [c for c in left.columns if c not in keys]
    names = {c: f"{c}_right" if c in own else c for c in right.columns if c not in keys}
    if not keys or not set(keys) <= set(left.columns) or not set(keys) <= set(right.columns):
        return left.limit(0)
    how = how if how in ("inner", "left", "right", "outer") else "inner"
    a, b = left.alias("l"), right.alias("r")
    on = reduce(lambda x, y: x & y, (F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys))
    joined = a.join(b, on, how)
    key = {"right": lambda k: F.col(f"r.`{k}`"), "outer": lambda k: F.coalesce(F.col(f"l.`{k}`"), F.col(f"r.`{k}`"))}.get(how, lambda k: F.col(f"l.`{k}`"))
    first = [key(c).alias(c) if c in keys else F.col(f"l.`{c}`") for c in left.columns]
    return joined.select(*first, *(F.col(f"r.`{c}`").alias(n) for c, n in names.items()))


def in_order(df: DataFrame) -> list[Column]:
    """The corpus order."""
    names = [c for c in ("row_order", "doc_id") if c in df.columns]
    plain = [c for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]
    return [F.col(c) for c in names] + [F.xxhash64(*plain)]


def first_per(df: DataFrame, keys: Sequence[Column], order: Sequence[Column] | None = None) -> DataFrame:
    """The first row of each key in order; null equals null."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*(order or in_order(df))))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def merge_corpora(inputs: Sequence[DataFrame], strategy: str = "append") -> DataFrame:
    """All inputs one after the other; `dedupe` keeps the first input's row of a doc_id."""
    tagged = (d.withColumn("__input", F.lit(k)) for k, d in enumerate(inputs))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    if strategy == "dedupe":
        both = first_per(both, [F.col("doc_id")], [F.col("__input"), *in_order(both)])
    return both.drop("__input")


def deduplicate(df: DataFrame, keys: Sequence[str] = ("title", "year")) -> DataFrame:
    """The first document of each key tuple; a key that is no column is looked up in extra_metadata."""
    return first_per(df, [F.coalesce(F.trim(lookup(df, k)), F.lit("")) for k in keys if k.strip()])


def difference(left: DataFrame, right: DataFrame, limit: int = 25) -> tuple[DataFrame, DataFrame]:
    """Rows only in right (added) and only in left (removed), sorted, at most `limit` each."""
    added, removed = right.exceptAll(left), left.exceptAll(right)
    return tuple(d.orderBy(*d.columns).limit(limit) for d in (added, removed))


# --- samples, splits, buckets ------------------------------------------------


def draw(df: DataFrame, seed: int) -> Column:
    """A row's place in the shuffled order of a seed: 60 bits of an MD5."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def sample(df: DataFrame, size: int | None = 200, ratio: float | None = None, seed: int = 42) -> DataFrame:
    """The rows with the least draws: `ratio` of all (halves up, at least one) or `size` of them.

    The draw of the last row is found by counting passes; rows below it stay
    where they are, and only those that share it (an id's repeats) are cut.
    """
    n = df.count()
    want = max(1, math.floor(n * min(1.0, ratio) + 0.5)) if ratio else max(0, size or 0)
    if want >= n:
        return df
    if not want:
        return df.limit(0)
    drawn = df.withColumn("__u", draw(df, seed))
    last = _nth(drawn, "__u", want)
    below = drawn.where(F.col("__u") < last)
    return below.unionByName(drawn.where(F.col("__u") == last).limit(want - below.count())).drop("__u")


def parse_splits(text: str) -> list[tuple[str, float]]:
    """`name:ratio` lines; ratios are made to sum to 1."""
    pairs = [line.split(":", 1) for line in text.replace(",", "\n").splitlines() if ":" in line]
    found = [(n.strip(), float(r)) for n, r in pairs if float(r) > 0]
    total = sum(r for _, r in found)
    return [(n, r / total) for n, r in found]


def split(df: DataFrame, splits: Sequence[tuple[str, float]] = (("train", 0.7), ("test", 0.3)), seed: int = 42) -> DataFrame:
    """doc_id, title, split_name: a seeded draw cut at exact counts, the last split takes the remainder.

    The cut draws come from a few counting passes: no global window, rows are labelled where they are.
    """
    n = df.count()
    ends, at = [], 0.0
    for _, ratio in splits[:-1]:
        at += ratio
        ends.append(math.floor(n * at + 1e-9))
    u = df.select("doc_id", "title", draw(df, seed).alias("__u"))
    cuts = [_nth(u, "__u", e) for e in ends]
    label = F.lit(splits[-1][0])
    for (name, _), cut in reversed(list(zip(splits[:-1], cuts, strict=True))):
        label = F.when(F.lit(False) if cut is None else F.col("__u") <= cut, name).otherwise(label)
    return u.select("doc_id", "title", label.alias("split_name"))


def _nth(df: DataFrame, column: str, n: int) -> int | None:
    """The n-th smallest value of a long column, found by narrowing a histogram: exact, with a few counting passes."""
    if n <= 0:
        return None
    low, high, want = -(1 << 63), (1 << 63) - 1, n
    while high - low > 0:
        width = max(1, (high - low) // 1024 + 1)
        part = df.where(F.col(column).between(low, high))
        cell = F.expr(f"cast((cast({column} as decimal(38,0)) - cast({low} as decimal(38,0))) div cast({width} as decimal(38,0)) as int)")
        cells = sorted((r["c"], r["n"]) for r in part.groupBy(cell.alias("c")).agg(F.count("*").alias("n")).collect())
        for c, k in cells:
            if want <= k:
                low, high = low + c * width, min(high, low + (c + 1) * width - 1)
                break
            want -= k
        if k == 1:
            return df.where(F.col(column).between(low, high)).agg(F.max(column)).first()[0]
    return low


def bucket_by_time(df: DataFrame, field: str = "year", granularity: str = "year") -> DataFrame:
    """doc_id, title, year, time_bucket; rows without a whole number are left out."""
    bucket = values.year_bucket(lookup(df, field), granularity)
    return df.select("doc_id", "title", lookup(df, field).try_cast("int").alias("year"), bucket.alias("time_bucket")).where("time_bucket is not null")


# --- metadata ----------------------------------------------------------------

#: Country names and codes.
COUNTRIES = {"CN": "China", "中国": "China", "China": "China", "US": "United States", "USA": "United States", "United States": "United States", "美国": "United States"}


def parse_aliases(text: str) -> dict[str, str]:
    """`from<tab or |>to` lines."""
    lines = (line.strip() for line in text.splitlines())
    pairs = [line.split("\t") if "\t" in line else line.split("|") for line in lines if line]
    return {p[0].strip(): p[1].strip() for p in pairs if len(p) > 1}


def mapped(c: Column, aliases: dict[str, str]) -> Column:
    if not aliases:
        return c
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.coalesce(F.try_element_at(table, c), c)


def normalize_metadata(df: DataFrame, institutions: dict[str, str] | None = None, countries: dict[str, str] | None = None, categories: dict[str, str] | None = None, delimiters: str = ";；|", keep_first: bool = True, year_field: str = "year") -> tuple[DataFrame, DataFrame]:
    """The corpus with normalized institution, country, year and category, and the
    audit (doc_id, field, old, new) of what changed; built-in country names win
    over aliases."""
    signs = "".join("\\" + c for c in delimiters) or ";"
    institution = F.trim(F.regexp_replace(F.coalesce("institution", F.lit("")), f"[{signs}]", ";"))
    names = F.filter(F.transform(F.split(institution, ";"), lambda p: F.trim(p)), lambda p: p != "")
    names = F.slice(names, 1, 1) if keep_first else names
    table = F.create_map(*(F.lit(x) for kv in institutions.items() for x in kv)) if institutions else None
    if table is not None:
        names = F.transform(names, lambda p: F.coalesce(F.try_element_at(table, p), p))
    country, category = F.trim("country_or_region"), F.trim("category_or_tag")
    year = values.year_of(lookup(df, year_field))
    new = {
        "institution": F.when(institution != "", F.array_join(names, "; ")).otherwise(F.col("institution")),
        "country_or_region": F.when(country != "", mapped(country, (countries or {}) | COUNTRIES)).otherwise(F.col("country_or_region")),
        "year": F.coalesce(year, F.col("year")).cast("int"),
        "category_or_tag": F.when(category != "", mapped(category, categories or {})).otherwise(F.col("category_or_tag")),
    }
    old = {"institution": institution, "country_or_region": country, "year": F.col("year").cast("string"), "category_or_tag": category}
    before = {"country_or_region": country, "category_or_tag": category}
    rows = df.select("*", *(c.alias(f"__{n}") for n, c in new.items()))
    changes = F.array(*(F.when(~F.col(f"__{n}").eqNullSafe(before.get(n, F.col(n))) & F.col(f"__{n}").isNotNull(), F.struct(F.lit(n).alias("field"), old[n].alias("old"), F.col(f"__{n}").cast("string").alias("new"))) for n in new))
    audit = rows.select("doc_id", F.explode(F.array_compact(changes)).alias("c")).select("doc_id", "c.field", "c.old", "c.new")
    return rows.select(*(F.col(f"__{c}").alias(c) if c in new else F.col(c) for c in df.columns)), audit
