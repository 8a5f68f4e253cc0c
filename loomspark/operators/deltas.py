"""Term statistics kept up to date by signed deltas.

The tables of this module are sums over documents, so a document that changed
takes its old part out (sign -1) and puts its new part in (+1); one that is gone
or new does only the one or the other. Only changed documents are tokenized and
counted again; what is read of the rest is the tables. From them come whole
results, the same as a recount of all documents: first and last years too,
because terms are counted by year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..schemas import lookup
from .stats import TOKENS, counted, window_pairs

#: The tables: keys and counts.
TABLES = {"terms": (("term", "year"), ("tf", "df")), "pairs": (("term_a", "term_b"), ("n",)), "groups": (("g", "term"), ("n", "docs"))}


def signed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old versions of documents with sign -1 and new ones with +1, in one table."""
    return old.withColumn("__sign", F.lit(-1)).unionByName(new.withColumn("__sign", F.lit(1)), allowMissingColumns=True)


def versions(old: DataFrame, new: DataFrame, columns: tuple[str, ...] = (TOKENS, "year")) -> tuple[DataFrame, DataFrame]:
    """The old rows that are changed or gone and the new rows that are changed or
    new, told by a hash of the columns that are counted."""
    mark = F.xxhash64(*(c for c in columns if c in old.columns and c in new.columns)).alias("__mark")
    a, b = old.select("doc_id", mark), new.select("doc_id", mark)
    out = old.select("*", mark).join(b, ["doc_id", "__mark"], "left_anti").drop("__mark")
    into = new.select("*", mark).join(a, ["doc_id", "__mark"], "left_anti").drop("__mark")
    return out, into


def _counts(docs: DataFrame, field: str, width: int, sign: Column) -> dict[str, DataFrame]:
    tagged = docs.withColumn("__g", F.trim(F.coalesce(lookup(docs, field), F.lit("")))).withColumn("__s", sign.cast("long"))
    tagged = tagged if "year" in docs.columns else tagged.withColumn("year", F.lit(None).cast("int"))
    terms = counted(tagged, "__s", "year").groupBy("term", "year").agg(F.sum(F.col("n") * F.col("__s")).alias("tf"), F.sum("__s").alias("df"))
    each = tagged.select("__s", F.explode_outer(window_pairs(F.col(TOKENS), width)).alias("p")).where("p is not null")
    pairs = each.groupBy(F.col("p.a").alias("term_a"), F.col("p.b").alias("term_b")).agg(F.sum("__s").alias("n"))
    own = counted(tagged.where("__g <> ''"), "__s", "__g")
    groups = own.groupBy(F.col("__g").alias("g"), "term").agg(F.sum(F.col("n") * F.col("__s")).alias("n"), F.sum("__s").alias("docs"))
    return {"terms": terms, "pairs": pairs, "groups": groups}


def summaries(docs: DataFrame, field: str = "institution", width: int = 5) -> dict[str, DataFrame]:
    """The tables of all documents (doc_id, filtered_tokens, year, the group's field)."""
    return _counts(docs, field, width, F.lit(1))


def updated(tables: dict[str, DataFrame], old: DataFrame, new: DataFrame, field: str = "institution", width: int = 5) -> dict[str, DataFrame]:
    """The tables after old versions of documents gave way to new ones (`versions`);
    field and width are those that the tables were made with."""
    change = _counts(signed(old, new), field, width, F.col("__sign"))
    out = {}
    for name, (keys, counts) in TABLES.items():
        both = tables[name].select(*keys, *counts).unionByName(change[name].select(*keys, *counts))
        summed = both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counts))
        out[name] = summed.where(F.col(counts[0]) != 0)
    return out


def frequency(terms: DataFrame) -> DataFrame:
    """The frequency table of the counts by term and year."""
    one = terms.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    total = terms.agg(F.sum("tf").alias("__total"))  # one row
    return one.join(F.broadcast(total)).select(
        "term", "tf", "df", "first_year", "last_year", (F.col("tf") / F.col("__total")).alias("ratio"),
        F.length("term").alias("word_length"), (F.col("tf") / F.col("df")).alias("avg_per_doc"),
    )


def term_year(terms: DataFrame) -> DataFrame:
    """The term-year table of the counts by term and year."""
    dated = terms.where("year is not null")
    totals = dated.groupBy("year").agg(F.sum("tf").alias("__total"))  # one row a year
    return dated.join(totals, "year").select("term", "year", F.col("tf").alias("tf_in_year"), F.col("df").alias("df_in_year"), (F.col("tf") / F.col("__total")).alias("ratio_in_year"))


def cooccurrence(pairs: DataFrame, least: int = 2) -> DataFrame:
    """The co-occurrence table of the counts of pairs."""
    kept = pairs.where(F.col("n") >= least).withColumnRenamed("n", "cooccurrence_count")
    return kept.withColumn("score", values.log_score(F.col("cooccurrence_count")))


def group_shares(groups: DataFrame) -> DataFrame:
    """group_value, term, term_count, document_count, total_terms, normalized_frequency of the counts by group."""
    sizes = groups.groupBy("g").agg(F.sum("n").alias("total_terms"))  # one row a group
    return groups.join(sizes, "g").select(F.col("g").alias("group_value"), "term", F.col("n").alias("term_count"), F.col("docs").alias("document_count"), "total_terms", F.round(F.col("n") / F.col("total_terms"), 6).alias("normalized_frequency"))
