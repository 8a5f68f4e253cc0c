"""Document fingerprints as Merkle trees (operator 3), in DataFrame functions only.

A text is cut into sections (at empty lines), a section into paragraphs (at line
ends), a paragraph into leaves of a word each (with the blank or mark behind it),
so a leaf's ends are told by the text around them alone and leaves behind an
insertion stay the same. A leaf's node is the SHA-256
of its text, a paragraph's that of its leaves' nodes, a section's that of its
paragraphs', the root that of the sections': equal roots mean equal texts, and
where two trees differ, the differing branches locate the edits: the paragraphs
between what the two have in common at their beginning and at their end (so what
is put in or taken out moves nothing else), each told by section and paragraph.

The fingerprint is the root and, behind a colon, an entry for each leaf in order:
DIGITS hexadecimal digits of its node and a letter for its length (a: one code
point). The likeness of two fingerprints is the length of the leaves that both
hold, wherever they stand and counted as often as they occur in both, divided by
the length of all leaves of the longer one. It is the same wherever in a text an
edit of a given size is made.

The successor of each document is found without a global window: cut values of
doc_id deal the rows to order buckets, and the first row of a bucket is also
sent, as a guest, to the bucket before it (to the last one from the first). One
shuffle carries each text once; a bucket is sorted by its task, on disk if need be.

Null texts are empty; a text without leaves (empty, or line ends only) is like
one with the same root (1.0) and no other (0.0). Equal doc_ids are ordered by a
hash of the text; a null doc_id comes first; a single document is its own
successor; an empty table gives an empty result; extra columns are left out.
doc_id is numeric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import literal, parts, range_bounds, range_bucket, table

DIGITS, BUCKET_ROWS, MOST_BUCKETS = 5, 2_000, 100_000
#: Up to LONGEST signs and the blank or CJK mark behind them.
LONGEST, MARKS = 24, "。、，"
LEAF = f"[^\\n {MARKS}]{{1,{LONGEST}}}[ {MARKS}]?|[ {MARKS}]"
#: The same for paragraphs without CJK marks, several times faster.
PLAIN = f"[^\\n ]{{1,{LONGEST}}}+ ?+| "


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_nodes(text: Column) -> Column:
    """node and size of the leaves by section and paragraph: array<array<array<struct>>>."""

    def cut(paragraph: Column) -> Column:
        marked = paragraph.contains(MARKS[0]) | paragraph.contains(MARKS[1]) | paragraph.contains(MARKS[2])
        found = F.when(marked, F.regexp_extract_all(paragraph, F.lit(LEAF), F.lit(0))).otherwise(F.regexp_extract_all(paragraph, F.lit(PLAIN), F.lit(0)))
        return F.transform(found, lambda x: F.struct(sha(x).alias("node"), F.length(x).alias("size")))

    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), cut))


def tree(nodes: Column) -> Column:
    """The paragraphs' nodes by section: array<array<string>>."""
    return F.transform(nodes, lambda s: F.transform(s, lambda p: sha(F.array_join(p["node"], ""))))


def root(nodes: Column) -> Column:
    """The root of a tree."""
    return sha(F.array_join(F.transform(nodes, lambda ps: sha(F.array_join(ps, ""))), ""))


def entries(nodes: Column) -> Column:
    """The leaves' entries in order."""
    return F.transform(F.flatten(F.flatten(nodes)), lambda x: F.concat(F.substring(x["node"], 1, DIGITS), F.char(x["size"] + 96)))


def fingerprint(nodes: Column, leaves: Column) -> Column:
    """The fingerprint of a tree and its leaves' entries."""
    return F.concat(root(nodes), F.lit(":"), F.array_join(leaves, ""))


def entries_of(print_: Column) -> Column:
    """The leaves' entries of a fingerprint."""
    return F.regexp_extract_all(F.substring(print_, 66, 2**31 - 1), F.lit(f".{{{DIGITS + 1}}}"), F.lit(0))


def size_of(leaves: Column) -> Column:
    """The length of entries together."""
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda n, x: n + F.ascii(F.substring(x, DIGITS + 1, 1)) - 96)


def numbered(digests: Column) -> Column:
    """Distinct values that stand for the digests: the n-th of equal ones gets its number."""

    def told(ordered: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return F.get(F.transform(F.array(starts), lambda at: runs(ordered, at)), F.lit(0))

    def runs(ordered: Column, at: Column) -> Column:
        def run(start: Column, k: Column) -> Column:
            last = F.coalesce(F.get(at, k + 1), F.size(ordered)) - 1
            return F.transform(F.sequence(start, last), lambda i: F.when(i == start, F.get(ordered, i)).otherwise(F.concat(F.get(ordered, i), (i - start).cast("string"))))

        return F.flatten(F.transform(at, run))

    repeated = F.get(F.transform(F.array(F.sort_array(digests)), told), F.lit(0))
    return F.when(F.size(F.array_distinct(digests)) == F.size(digests), digests).otherwise(repeated)


def likeness(a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """Share of the length of the leaves that two numbered lists have in common, 0 to 1; null if neither has any."""
    return size_of(F.array_intersect(a, b)) / F.nullif(F.greatest(size_a, size_b), F.lit(0))


def differences(a: Column, b: Column) -> Column:
    """The branches of tree b that differ from tree a, as places "section.paragraph" (from 1)."""
    old, new = F.flatten(a), F.flatten(b)
    text = lambda i: (i + 1).cast("string")
    places = F.flatten(F.transform(b, lambda ps, s: F.transform(ps, lambda p, k: F.concat(text(s), F.lit("."), text(k)))))

    def alike(x: Column, y: Column) -> Column:
        """How many first elements are equal."""
        first = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)
        return F.when(first == 0, F.size(x)).otherwise(first - 1).cast("int")

    def middle(t: Column) -> Column:
        old, new, places = t["old"], t["new"], t["places"]
        return F.filter(places, lambda _, i: (i >= t["head"]) & (i < F.size(new) - t["tail"]) & ~F.get(new, i).eqNullSafe(F.when(i < F.size(old) - t["tail"], F.get(old, i))))

    def ends(t: Column) -> Column:
        head = alike(t["old"], t["new"])
        tail = F.least(alike(F.reverse(t["old"]), F.reverse(t["new"])), F.least(F.size(t["old"]), F.size(t["new"])) - head)
        return F.struct(t["old"].alias("old"), t["new"].alias("new"), t["places"].alias("places"), head.alias("head"), tail.alias("tail"))

    # Lists of one element hold what is used more than once.
    lists = F.array(F.struct(old.alias("old"), new.alias("new"), places.alias("places")))
    return F.get(F.transform(F.transform(lists, ends), middle), F.lit(0))


def shown(rows: DataFrame, text: str, prefix: str) -> DataFrame:
    """rows with the tree, entries, numbered (entries) and size of a text column, under names with the prefix."""
    rows = rows.withColumn("__nodes", leaf_nodes(F.col(text)))
    rows = rows.withColumn(f"{prefix}tree", tree(F.col("__nodes"))).withColumn(f"{prefix}entries", entries(F.col("__nodes"))).drop("__nodes")
    # No leaf holds a line end, and everything else is in some leaf.
    size = F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))).cast("long")
    return rows.withColumn(f"{prefix}numbered", numbered(F.col(f"{prefix}entries"))).withColumn(f"{prefix}size", size)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, tree, entries, numbered, size of every row of docs and next_text, next_numbered, next_size of its successor."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    buckets = min(MOST_BUCKETS, max(parts(spark), -(-docs.count() // BUCKET_ROWS)))
    bounds = range_bounds(docs, "doc_id", buckets)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("bucket", range_bucket(F.col("doc_id"), bounds, kind, F.col("tie")))
    place = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "tie")
    # One row a bucket: its number comes to the driver, its first text goes to the bucket before it.
    first = rows.groupBy("bucket").agg(F.min_by(F.struct("doc_id", "text", "tie"), place).alias("first"))
    have = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())
    before = [0] * (len(bounds) + 1)
    for k, b in enumerate(have):
        before[b] = have[k - 1]
    guests = first.select("first.*", F.get(literal(before, "int"), F.col("bucket")).alias("bucket"), F.lit(1).alias("guest"))
    placed = rows.withColumn("guest", F.lit(0)).unionByName(guests).repartition(len(bounds) + 1, "bucket")
    placed = shown(placed, "text", "")
    order = W.partitionBy("bucket").orderBy("guest", "doc_id", "tie")
    both = placed.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "numbered", "size")))
    return both.where("guest = 0").drop("bucket", "guest", "tie")


def compared(docs: DataFrame) -> DataFrame:
    """The fingerprints of every row of docs (doc_id, text) and of its edited
    text, their likeness, that to the next document's, and the places of the edits."""
    rows = with_next(docs)
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - part), F.substring("next_text", F.lit(1), part)))
    rows = shown(rows, "edited", "edited_")

    def near(other: str, text: str) -> Column:
        return F.coalesce(likeness(F.col("numbered"), F.col(f"{other}numbered"), F.col("size"), F.col(f"{other}size")), (F.col("text") == F.col(text)).cast("double"))

    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        sha(F.col("edited")).alias("edited_sha256"),
        fingerprint(F.col("tree"), F.col("entries")).alias("fingerprint"),
        fingerprint(F.col("edited_tree"), F.col("edited_entries")).alias("edited_fingerprint"),
        near("edited_", "edited").alias("near_edited"),
        near("next_", "next_text").alias("near_next"),
        F.array_join(differences(F.col("tree"), F.col("edited_tree")), ",").alias("edits"),
    )


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compared(table(spark, sf_dir, "documents"))


_ENTRIES = "list_transform(regexp_extract_all({0}, '{1}'), lambda x: sha256(x)[1:5] || chr(CAST(96 + length(x) AS INTEGER)))"
_TREE = r"list_transform(string_split({0}, E'\n\n'), lambda s: list_transform(string_split(s, E'\n'), lambda p: sha256(array_to_string(list_transform(regexp_extract_all(p, '{1}'), lambda x: sha256(x)), ''))))"
OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), n AS (
  SELECT doc_id, text, length(text) AS n_chars,
    coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST), first_value(text) OVER (ORDER BY doc_id NULLS FIRST)) AS next_text FROM d
), e AS (
  SELECT *, substr(text, 1, n_chars - n_chars // 4) || substr(next_text, 1, n_chars // 4) AS edited FROM n
), t AS (
  SELECT *, {_TREE.format("text", LEAF)} AS a, {_TREE.format("edited", LEAF)} AS b,
    {_ENTRIES.format("text", LEAF)} AS l, {_ENTRIES.format("edited", LEAF)} AS m, {_ENTRIES.format("next_text", LEAF)} AS k,
    length(replace(text, E'\n', '')) AS sl, length(replace(edited, E'\n', '')) AS sm, length(replace(next_text, E'\n', '')) AS sk FROM e
), h AS (
  SELECT *, list_aggregate(l, 'histogram') AS hl, list_aggregate(m, 'histogram') AS hm, list_aggregate(k, 'histogram') AS hk,
    flatten(a) AS fa, flatten(b) AS fb,
    flatten(list_transform(b, lambda s, i: list_transform(s, lambda x, j: i || '.' || j))) AS places FROM t
), c AS (
  SELECT *,
    coalesce(list_sum(list_transform(map_keys(hl), lambda x: (ord(x[6]) - 96) * least(hl[x], coalesce(hm[x], 0)))), 0) AS in_edited,
    coalesce(list_sum(list_transform(map_keys(hl), lambda x: (ord(x[6]) - 96) * least(hl[x], coalesce(hk[x], 0)))), 0) AS in_next,
    coalesce(nullif(list_position(list_transform(list_zip(fa, fb), lambda z: z[1] IS DISTINCT FROM z[2]), true), 0) - 1, len(fa)) AS head,
    coalesce(nullif(list_position(list_transform(list_zip(list_reverse(fa), list_reverse(fb)), lambda z: z[1] IS DISTINCT FROM z[2]), true), 0) - 1, len(fa)) AS back FROM h
), f AS (
  SELECT *, least(back, least(len(fa), len(fb)) - head) AS tail FROM c
)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256,
  sha256(array_to_string(list_transform(a, lambda p: sha256(array_to_string(p, ''))), '')) || ':' || array_to_string(l, '') AS fingerprint,
  sha256(array_to_string(list_transform(b, lambda p: sha256(array_to_string(p, ''))), '')) || ':' || array_to_string(m, '') AS edited_fingerprint,
  CASE WHEN greatest(sl, sm) = 0 THEN CAST(text = edited AS DOUBLE) ELSE in_edited / greatest(sl, sm) END AS near_edited,
  CASE WHEN greatest(sl, sk) = 0 THEN CAST(text = next_text AS DOUBLE) ELSE in_next / greatest(sl, sk) END AS near_next,
  array_to_string(list_transform(list_filter(range(head + 1, len(fb) - tail + 1), lambda i: fb[i] IS DISTINCT FROM CASE WHEN i <= len(fa) - tail THEN fa[i] END), lambda i: places[i]), ',') AS edits
FROM f
"""
