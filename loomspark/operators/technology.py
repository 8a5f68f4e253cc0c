"""Technology indicators and classes of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_up(c: Column) -> Column:
    """Four digits; the last bits of a double don't decide a tie."""
    return F.round(F.round(c, 10), 4)


def indicators(term_year: DataFrame, metrics: DataFrame | None, year: int) -> DataFrame:
    """Growth, novelty, disruption and maturity of each term at a year: one pass
    of conditional sums over the term-year table, graph metrics joined (0 if missing)."""
    tf = F.col("tf_in_year")
    recent, base = F.col("year").between(year - 2, year), F.col("year").between(year - 7, year - 3)
    terms = term_year.where("year is not null and term <> ''").groupBy("term").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum(tf).alias("total_tf"), F.sum("df_in_year").alias("total_df"),
        F.sum(F.when(recent, tf).otherwise(0)).alias("recent_tf"), F.sum(F.when(base, tf).otherwise(0)).alias("baseline_tf"),
    )
    if metrics is None:
        terms = terms.withColumn("betweenness", F.lit(0.0)).withColumn("pagerank", F.lit(0.0))
    else:
        terms = terms.join(metrics.select("term", "betweenness", "pagerank"), "term", "left").na.fill(0.0, ["betweenness", "pagerank"])
    one = F.lit(1.0)
    total = F.greatest(F.col("total_tf"), F.lit(1))
    growth = (F.col("recent_tf") + 1) / (F.col("baseline_tf") + 1)
    fresh = F.when(F.col("first_year") >= year - 3, 1.0).otherwise(0.3)
    novelty = F.least(one, fresh * (1 / (1 + F.col("baseline_tf") / total)) * (1 + F.col("recent_tf") / total))
    bridge = F.least(one, F.col("betweenness") * 5 + F.col("pagerank") * 2)
    disruption = F.least(one, growth / (1 + growth) * 0.7 + bridge * 0.3)
    span = F.col("last_year") - F.col("first_year") + 1
    maturity = F.least(one, span / 10 * 0.4 + F.col("baseline_tf") / total * 0.6)
    return terms.select(
        "term", "first_year", "last_year", "total_tf", "total_df", "recent_tf", "baseline_tf", half_up(growth).alias("growth_rate"), half_up(novelty).alias("novelty_score"),
        half_up(disruption).alias("disruption_score"), half_up(maturity).alias("maturity_score"), F.round("betweenness", 6).alias("betweenness"), F.round("pagerank", 6).alias("pagerank"),
    )


def ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    """The terms by falling novelty, then disruption, ties by term: a range sort, or
    the first `top` of every partition merged. Tables are kept unsorted; sinks and
    readers that need the order ask for it here."""
    out = rows.orderBy(F.desc("novelty_score"), F.desc("disruption_score"), "term")
    return out if top is None else out.limit(top)


THRESHOLDS = {"emerging_novelty": 0.65, "emerging_growth": 1.5, "disruptive": 0.65, "core": 0.65, "declining_growth": 0.75, "declining_maturity": 0.4}


def classify(rows: DataFrame, **thresholds: float) -> DataFrame:
    """emerging, disruptive, core, declining or monitor, in this order, with confidence and reason."""
    t = THRESHOLDS | thresholds
    n, d, m, g = (F.col(c) for c in ("novelty_score", "disruption_score", "maturity_score", "growth_rate"))

    def said(pattern: str, *args: Column) -> Column:
        return F.format_string(pattern, *args)

    half = lambda a, b: a * 0.5 + b * 0.5
    cases = [
        ("emerging", (n >= t["emerging_novelty"]) & (g >= t["emerging_growth"]), half(n / t["emerging_novelty"], g / t["emerging_growth"]),
         said(f"novelty %.2f >= {t['emerging_novelty']} and growth %.2f >= {t['emerging_growth']}", n, g)),
        ("disruptive", d >= t["disruptive"], d / t["disruptive"], said(f"disruption %.2f >= {t['disruptive']}", d)),
        ("core", m >= t["core"], m / t["core"], said(f"maturity %.2f >= {t['core']}", m)),
        ("declining", (g <= t["declining_growth"]) & (m >= t["declining_maturity"]), half(t["declining_growth"] / F.greatest(g, F.lit(0.01)), m / t["declining_maturity"]),
         said(f"growth %.2f <= {t['declining_growth']} and maturity %.2f >= {t['declining_maturity']}", g, m)),
    ]
    name, sure, why = F.lit("monitor"), F.lit(0.5), F.lit("between the thresholds: keep watching")
    for label, fits, confidence, reason in reversed(cases):
        name, sure, why = F.when(fits, label).otherwise(name), F.when(fits, F.least(F.lit(1.0), confidence)).otherwise(sure), F.when(fits, reason).otherwise(why)
    return rows.select("term", name.alias("technology_class"), half_up(sure).alias("confidence"), why.alias("primary_reason"), "novelty_score", "disruption_score", "maturity_score", "growth_rate")
