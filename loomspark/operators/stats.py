"""Term statistics over filtered tokens.

Everything starts from one explode of token arrays; counts are pre-aggregated
before they are shuffled, so a frequent term sends one row a task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values
from ..schemas import lookup
from ..storage import dropped, stored

TOKENS = "filtered_tokens"


def exploded(corpus: DataFrame, *columns: str, tokens: str = TOKENS) -> DataFrame:
    """One row a token: the columns named, and term.

    explode() would make Spark test the array's size below it, and so compute
    the tokens twice; explode_outer() doesn't, and empty documents go after it.
    """
    return corpus.select(*columns, F.explode_outer(tokens).alias("term")).where("term is not null")


def counted(corpus: DataFrame, *columns: str, tokens: str = TOKENS) -> DataFrame:
    """One row for each document and term with its count n. A row's terms are
    counted in Arrow batches; rows of the same document are then added up."""
    return row_counts(corpus, "doc_id", *columns, tokens=tokens).groupBy("doc_id", *columns, "term").agg(F.sum("n").alias("n"))


def row_counts(corpus: DataFrame, *columns: str, tokens: str = TOKENS) -> DataFrame:
    """The columns named, term and its count n in the row, for each row's distinct terms."""
    rows = corpus.select(*columns, tokens)
    whole = T.StructType([*rows.schema.fields[:-1], T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in itertools.chain.from_iterable(map(parts, batches)):
            for part in terms_of(b).to_batches():
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(part["row"]) for k in range(b.num_columns - 1)), part["term"], part["count_all"]], names=whole.names)

    return rows.mapInArrow(run, whole)


#: Tokens of a batch that are counted together (a row with more is counted alone).
TOGETHER = 200_000


def parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch, whose last column are token arrays, in parts of about TOGETHER tokens."""
    ends, start = np.cumsum(pc.fill_null(pc.list_value_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False)), 0
    while start < b.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
        yield b.slice(start, stop - start)
        start = stop


def terms_of(b: pa.RecordBatch) -> pa.Table:
    """row, term, count_all of each row's distinct terms."""
    lists = b.column(b.num_columns - 1)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    of = pa.table({"row": np.repeat(np.arange(b.num_rows), lengths), "term": lists.flatten()}).filter(pc.field("term").is_valid())
    return of.group_by(["row", "term"]).aggregate([([], "count_all")]).combine_chunks()


def tallied(corpus: DataFrame, *columns: str, tokens: str = TOKENS) -> DataFrame:
    """Rows (the columns named, term, n tokens, docs) whose sums over the columns and
    terms are the tokens and documents of each.

    A document that is one row is counted where it lies, and batches add up their
    documents before anything is shuffled. Only rows of ids that stand in several
    rows go through (document, term) pairs.
    """
    ids = stored(corpus.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
    single = corpus
    if again := not ids.isEmpty():
        single = corpus.join(ids, corpus["doc_id"].eqNullSafe(ids["doc_id"]), "left_anti")
    rows = single.select(*columns, tokens)
    whole = T.StructType([*rows.schema.fields[:-1], T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("docs", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in itertools.chain.from_iterable(map(parts, batches)):
            n = terms_of(b)
            keys = {f"k{k}": b.column(k).take(n["row"].combine_chunks()) for k in range(b.num_columns - 1)}
            sums = pa.table(keys | {"term": n["term"], "n": n["count_all"]}).group_by([*keys, "term"]).aggregate([("n", "sum"), ("n", "count")])
            for part in sums.select([*keys, "term", "n_sum", "n_count"]).combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays(part.columns, names=whole.names)

    out = rows.mapInArrow(run, whole)
    if again:
        several = corpus.join(ids, corpus["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
        out = out.unionByName(counted(several, *columns, tokens=tokens).groupBy(*columns, "term").agg(F.sum("n").alias("n"), F.count("*").alias("docs")))
    else:
        dropped(ids)
    return out


#: Tokens of a document that are held against one list of rare terms.
CHUNK = 1000


def filter_terms(corpus: DataFrame, shortest: int = 2, least: int = 1, numeric: bool = False, important: Sequence[str] = (), tokens: str = "tokens") -> DataFrame:
    """Adds filtered_tokens: tokens of the shortest length (or single important
    characters), no numbers where `numeric` says so, and with a corpus frequency
    of at least `least`, counted before any other filter.

    The length and number rules are local. The frequency rule joins rare terms
    back to the documents that hold some, a list for every CHUNK tokens, so a
    token is held against at most CHUNK terms however long its document is.
    """
    single = [t for t in important if len(t) == 1]

    def fits(t: Column) -> Column:
        ok = F.length(t) >= shortest
        ok = ok | t.isin(single) if single else ok
        return ok & ~F.regexp_like(t, F.lit(r"(?U)^\d+$")) if numeric else ok

    if least <= 1:
        return corpus.withColumn(TOKENS, F.filter(tokens, fits))
    placed = corpus.select("doc_id", F.posexplode_outer(tokens).alias("at", "term")).where("term is not null")
    # Used twice: its shuffle is made once and reused.
    pairs = placed.groupBy("doc_id", F.floor(F.col("at") / CHUNK).cast("int").alias("chunk"), "term").agg(F.count("*").alias("n"))
    rare = pairs.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") < least).select("term")
    found = pairs.join(rare, "term").groupBy("doc_id", "chunk").agg(F.collect_set("term").alias("rare"))
    lists = found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("chunk", "rare"))).alias("m"), F.max("chunk").alias("last"))
    lists = lists.select("doc_id", F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.try_element_at("m", k)).alias("__rare"))
    joined = corpus.join(lists, "doc_id", "left")
    rare_here = lambda t, i: F.coalesce(F.array_contains(F.get("__rare", F.floor(i / CHUNK).cast("int")), t), F.lit(False))
    kept = F.when(F.col("__rare").isNull(), F.col(tokens)).otherwise(F.filter(tokens, lambda t, i: ~rare_here(t, i)))
    return joined.withColumn(TOKENS, F.filter(kept, fits)).drop("__rare")


def frequency(corpus: DataFrame, top: int | None = None) -> DataFrame:
    """term, tf, df, first_year, last_year, ratio, word_length, avg_per_doc; all terms, or the `top` of them in order.

    Documents are counted where they lie (see tallied), so a frequent term
    never needs a set of ids in one place.
    """
    has_year = "year" in corpus.columns
    year = F.min("year") if has_year else F.lit(None).cast("int")
    last = F.max("year") if has_year else F.lit(None).cast("int")
    rows = tallied(corpus, *(["year"] if has_year else []))
    terms = stored(rows.groupBy("term").agg(F.sum("n").alias("tf"), F.sum("docs").alias("df"), year.alias("first_year"), last.alias("last_year")))
    total = terms.agg(F.sum("tf").alias("__total"))  # one row
    out = terms.join(F.broadcast(total)).select(
        "term", "tf", "df", "first_year", "last_year", (F.col("tf") / F.col("__total")).alias("ratio"),
        F.length("term").alias("word_length"), (F.col("tf") / F.col("df")).alias("avg_per_doc"),
    )
    return out if top is None else out.orderBy(F.desc("tf"), F.desc("df"), "term").limit(top)


def term_document(corpus: DataFrame) -> DataFrame:
    """Counts by term, document, title, year and source; rows with a null among them are left out.

    Whole documents are shuffled, not their terms with a title each; where their
    tokens lie together the terms are counted without another shuffle.
    """
    keys = ["doc_id", "title", "year", "source"]
    whole = corpus.dropna(subset=keys).select(*keys, TOKENS).repartition(*keys)
    return exploded(whole, *keys).dropna(subset=["term"]).groupBy("term", *keys).agg(F.count("*").alias("term_count_in_doc"))


def term_year(corpus: DataFrame) -> DataFrame:
    """term, year, tf_in_year, df_in_year, ratio_in_year of documents with a year."""
    dated = corpus.where("year is not null")
    terms = stored(tallied(dated, "year").groupBy("term", "year").agg(F.sum("n").alias("tf_in_year"), F.sum("docs").alias("df_in_year")))
    totals = terms.groupBy("year").agg(F.sum("tf_in_year").alias("__total"))  # one row a year
    return terms.join(totals, "year").select("term", "year", "tf_in_year", "df_in_year", (F.col("tf_in_year") / F.col("__total")).alias("ratio_in_year"))


def window_pairs(tokens: Column, width: int) -> Column:
    """The unordered pairs (a < b) of distinct terms of every window of `width` tokens, window by window.

    Windows start at each token and may be shorter at the end. No window is
    larger than `width`, so a token yields at most width * (width - 1) / 2 pairs.
    """
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens))).otherwise(F.array().cast("array<int>"))
    empty = F.array().cast("array<struct<a:string,b:string>>")

    def at(window: Column) -> Column:
        return F.flatten(F.transform(window, lambda a, i: F.transform(F.slice(window, i + 2, F.lit(width)), lambda b: F.struct(a.alias("a"), b.alias("b")))))

    windows = F.transform(starts, lambda i: F.array_sort(F.array_distinct(F.slice(tokens, i, width))))
    return F.coalesce(F.flatten(F.transform(windows, at)), empty)


#: Windows whose pairs are counted at once.
WINDOWS = 500_000


def counted_pairs(tokens: pa.ListArray, width: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(a, b, windows) of the pairs of `window_pairs` over a batch of token arrays,
    each pair once for at most WINDOWS windows."""
    words = tokens.flatten().dictionary_encode()
    lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    # Ids in the order of the terms' bytes.
    known = words.dictionary.to_pylist()
    order = sorted(range(len(known)), key=lambda k: known[k].encode())
    rank = np.full(len(known) + 1, -1, np.int64)  # the last one is for null tokens
    rank[order] = np.arange(len(known))
    ids = rank[words.indices.fill_null(len(known)).to_numpy(zero_copy_only=False)]
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(ids))  # tokens up to the document's end
    names, offsets = words.dictionary.take(pa.array(order, pa.int64())), list(itertools.combinations(range(width), 2))
    for start in range(0, len(ids), WINDOWS):
        end = min(start + WINDOWS, len(ids))
        keys = np.full((end - start, len(offsets)), -1, np.int64)
        for column, (p, q) in enumerate(offsets):
            at = np.flatnonzero(left[start:end] > q)
            x, y = ids[start + at + p], ids[start + at + q]
            good = (x != y) & (x >= 0) & (y >= 0)
            keys[at[good], column] = np.minimum(x, y)[good] * len(known) + np.maximum(x, y)[good]
        keys.sort(axis=1)  # a pair counts once a window
        keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
        found, n = np.unique(keys[keys >= 0], return_counts=True)
        a, b = np.divmod(found, max(1, len(known)))
        yield names.take(pa.array(a)), names.take(pa.array(b)), n


def cooccurrence(corpus: DataFrame, width: int = 5, least: int = 2) -> DataFrame:
    """term_a < term_b, cooccurrence_count, score of pairs that share at least `least` windows."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, c, n in counted_pairs(b.column(0), width):
                yield pa.RecordBatch.from_arrays([a, c, pa.array(n)], names=["term_a", "term_b", "n"])

    pairs = corpus.select(TOKENS).mapInArrow(counted, "term_a string, term_b string, n bigint")
    counts = pairs.groupBy("term_a", "term_b").agg(F.sum("n").alias("cooccurrence_count")).where(F.col("cooccurrence_count") >= least)
    return counts.withColumn("score", values.log_score(F.col("cooccurrence_count")))


def group_terms(corpus: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """(group, term, n, docs), stored for it is read several times, and (group, total); documents without a group are left out."""
    tagged = corpus.select("doc_id", F.trim(F.coalesce(lookup(corpus, field), F.lit(""))).alias("g"), TOKENS).where("g <> ''")
    terms = stored(tallied(tagged, "g").groupBy("g", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    return terms, terms.groupBy("g").agg(F.sum("n").alias("total"))


#: Groups that meet a term in one bucket of the grid.
GRID = 1000


def group_compare(corpus: DataFrame, field: str, baseline: str, groups: Sequence[str] = (), least: int = 1) -> DataFrame:
    """Each group's use of every term against the baseline group's, zero counts included.

    The groups compared are named or, without any that exists, all of them. Rows
    with counts are the groups' own; a row without can only reach `least` by the
    baseline's count, so just the baseline's frequent terms are laid out over the
    groups, in buckets of about GRID groups each.
    """
    terms, totals = group_terms(corpus, field)
    wanted = [g for g in dict.fromkeys([baseline, *groups]) if g]
    named = F.col("g").isin(wanted) if wanted else F.lit(False)
    # One row: whether a named group exists, the baseline's size, and the number of groups.
    about = totals.agg(F.max(named).alias("some"), F.coalesce(F.sum(F.when(F.col("g") == baseline, F.col("total"))), F.lit(0)).alias("bt"), F.count("*").alias("groups"))
    chosen = totals.join(F.broadcast(about)).where(named | ~F.coalesce("some", F.lit(False)))
    base = terms.where(F.col("g") == baseline).select("term", F.col("n").alias("bn"), F.col("docs").alias("bdocs"))
    own = terms.join(chosen.select("g"), "g", "left_semi").select("term", "g", "n", "docs")
    # The part of the grid that can hold rows without counts.
    laid = (terms.select("term").distinct() if least <= 0 else base.where(F.col("bn") >= least).select("term")).join(F.broadcast(about.select("groups")))
    buckets = F.ceil(F.col("groups") / GRID).cast("int")
    laid = laid.select("term", F.explode(F.sequence(F.lit(0), F.greatest(buckets, F.lit(1)) - 1)).alias("bucket"))
    dealt = chosen.select("g", F.pmod(F.xxhash64("g"), F.greatest(buckets, F.lit(1))).cast("int").alias("bucket"))
    zero = F.lit(0).cast("long")
    none = laid.join(dealt, "bucket").select("term", "g").join(own, ["term", "g"], "left_anti").select("term", "g", zero.alias("n"), zero.alias("docs"))
    rows = own.unionByName(none).join(base, "term", "left").join(chosen.select("g", F.col("total").alias("t"), "bt"), "g").na.fill(0, ["bn", "bdocs"])
    share = F.col("n") / F.col("t")
    base_share = F.when(F.col("bt") > 0, F.col("bn") / F.col("bt")).otherwise(0.0)
    return rows.where(F.col("n") + F.col("bn") >= least).select(
        F.lit(field).alias("group_field"), F.col("g").alias("group_value"), F.lit(baseline).alias("baseline_group"), "term", F.col("n").alias("term_count"),
        F.col("docs").alias("document_count"), F.col("t").alias("total_terms"), F.round(share, 6).alias("normalized_frequency"),
        F.col("bn").alias("baseline_term_count"), F.col("bdocs").alias("baseline_document_count"), F.col("bt").alias("baseline_total_terms"),
        F.round(base_share, 6).alias("baseline_normalized_frequency"), F.round((share + 1e-9) / (base_share + 1e-9), 6).alias("ratio_vs_baseline"),
    )


def keyness(corpus: DataFrame, field: str, baseline: str, comparison: str, least: int = 2, digits: int = 6) -> DataFrame:
    """Log-likelihood ratio of each term between a comparison group and the baseline."""
    terms, totals = group_terms(corpus, field)
    count = lambda g, c: F.coalesce(F.sum(F.when(F.col("g") == g, F.col(c))), F.lit(0))
    wide = terms.where(F.col("g").isin(baseline, comparison)).groupBy("term").agg(count(comparison, "n").alias("a"), count(baseline, "n").alias("b"), count(comparison, "docs").alias("da"), count(baseline, "docs").alias("db"))
    size = lambda g: F.sum(F.when(F.col("g") == g, F.col("total")))
    both = totals.agg(size(comparison).alias("ta"), size(baseline).alias("tb")).where("ta > 0 and tb > 0")  # one row
    rows = wide.where(F.col("a") + F.col("b") >= least).join(F.broadcast(both))
    ra, rb = F.col("a") / F.col("ta"), F.col("b") / F.col("tb")
    return rows.select(
        F.lit(field).alias("group_field"), F.lit(comparison).alias("comparison_group"), F.lit(baseline).alias("baseline_group"), "term",
        F.col("a").alias("comparison_term_count"), F.col("b").alias("baseline_term_count"), F.col("da").alias("comparison_document_count"), F.col("db").alias("baseline_document_count"),
        F.round(ra, 6).alias("comparison_normalized_frequency"), F.round(rb, 6).alias("baseline_normalized_frequency"),
        F.round((ra + 1e-9) / (rb + 1e-9), 6).alias("relative_ratio"), F.round(values.log_likelihood_ratio(F.col("a"), F.col("ta"), F.col("b"), F.col("tb")), digits).alias("llr"),
    )
