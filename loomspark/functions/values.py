"""Numbers, dates and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def log_likelihood_ratio(a: Column, a_total: Column, b: Column, b_total: Column) -> Column:
    """Dunning's G2 of a term's counts in two groups, never below 0."""
    a, b, c, d = (x.cast("double") for x in (a, b, a_total - a, b_total - b))
    cells = xlogx(a) + xlogx(b) + xlogx(c) + xlogx(d)
    rows, columns = xlogx(a + b) + xlogx(c + d), xlogx(a + c) + xlogx(b + d)
    return F.greatest(F.lit(0.0), 2 * (cells + xlogx(a + b + c + d) - rows - columns))


def year_of(c: Column) -> Column:
    """The year in a value: a plain number, else a date in one of the usual notations, else null."""
    text = F.trim(c.cast("string"))
    dates = [F.year(F.try_to_timestamp(text, F.lit(f))) for f in ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM", "yyyy/M/d", "yyyy.M.d", "M/d/yyyy", "MMM d, yyyy", "d MMM yyyy", "yyyyMMdd")]
    number = F.when(F.regexp_like(text, F.lit(r"^[+-]?\d{1,6}(\.0*)?$")), text.try_cast("double").cast("int"))
    return F.coalesce(number, *dates).cast("int")


def year_bucket(c: Column, granularity: str = "year") -> Column:
    """`2024`, `2021-2025` (5_year) or `2020s` (decade); null if it is no whole number."""
    y = c.try_cast("int")
    if granularity == "5_year":
        start = y - F.pmod(y - 1, F.lit(5))
        return F.concat(start.cast("string"), F.lit("-"), (start + 4).cast("string"))
    if granularity == "decade":
        return F.concat((y - F.pmod(y, F.lit(10))).cast("string"), F.lit("s"))
    return y.cast("string")


def number(c: Column, kind: str = "string") -> Column:
    """A value as a number for comparisons: booleans 0 or 1, blank or non-finite null."""
    if kind == "boolean":
        return c.cast("double")
    n = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def log_score(count: Column) -> Column:
    return F.round(F.log(count + 1), 4)
