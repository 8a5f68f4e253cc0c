"""The prefix trie of conversations from chained digests (operator 11).

A prefix of d turns is named by a cryptographic digest that is chained from turn
to turn, so equal prefixes have equal digests and a digest holds its parent's.
Every conversation is exploded to all its prefixes; prefixes grouped by (depth,
digest) are the trie's nodes.

Sums over subtrees come from a second explosion. Every node belongs to its
smallest member; the nodes that a conversation owns are the lower end of its own
path, for below a node that it owns it is the smallest too. So what the nodes of
a subtree hold is a sum over the subtree's members of what each owns there, and
each conversation's owned nodes are exploded to all their ancestors at once:
one row a prefix, with the sum of the owned nodes below it. That makes as many
rows as there are turns, where single nodes exploded to their ancestors would
make the square of a conversation's length.

No conversation goes through one task. Turns are hashed where they are read, and
only digests are shuffled; their places in a conversation come from a global sort
by ranges; the chain is cut into blocks of BLOCK turns, chained in themselves,
and blocks are chained to each other, so 10^9 turns of one conversation leave a
list of 10^6 block digests. The root and hot prefixes are pre-aggregated before
they are shuffled. The ids that end in a node are sorted by ranges and joined to
long strings there, so one digest over many ids only streams those strings.

Turns are ordered by turn (null first), equal turn numbers by role and the
turn's digest; null roles and texts are empty; repeated rows are turns of their
own. Rows of a null conv_id take no part. A base id is c - c % 100 with the sign
of c (% as in SQL). An empty table has no node; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import dropped, joined_hot, parts, stored, table

#: Turns of a block; signs of a joined string of ids.
BLOCK, PIECE = 1024, 1 << 16
ROOT = hashlib.sha256(b"").digest()
LONGEST_HEAD = 5


def binary_sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, chars of every turn; the texts stay where they are."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id IS NOT NULL")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), binary_sha(whole).alias("digest"), F.char_length(text).cast("long").alias("chars"))


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, at (the turn's place in its conversation, from 0), digest, chars,
    from a sort by ranges: a long conversation lies in many of them."""
    order = ["conv_id", "turn", "role", "digest"]
    rows = stored(turns)
    ranged = rows.repartitionByRange(parts(turns.sparkSession), *order).sortWithinPartitions(*order)
    ranged = stored(ranged.select("conv_id", "digest", "chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("line")))
    dropped(rows)
    held = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    held = held.select("conv_id", "part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return ranged.join(held, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("line") - F.col("first")).alias("at"), "digest", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id of all conversations; conv_id, at, digest, chars of their turns)
    after each took the first turns of its hundred's first conversation."""
    rows = stored(placed(turns))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(LONGEST_HEAD + 1))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = stored(sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base")))
    heads = rows.where((F.col("conv_id") % 100 == 0) & (F.col("at") < LONGEST_HEAD)).withColumnRenamed("conv_id", "base")
    shared = convs.select("conv_id", "h", "base").join(heads, "base").where("at < h").select("conv_id", "at", "digest", "chars")
    # A conversation's own turns move up by what its base is short of.
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("base_n"))
    moved = convs.join(bases, "base", "left").select("conv_id", "h", (F.least("h", F.coalesce("base_n", F.lit(0))) - F.col("h")).alias("move"))
    own = rows.join(moved, "conv_id").where("at >= h").select("conv_id", (F.col("at") + F.col("move")).alias("at"), "digest", "chars")
    return convs.select("conv_id"), shared.unionByName(own)


def chained(rows: DataFrame) -> DataFrame:
    """conv_id, first (the depth of the block's first turn), parent (the prefix
    before the block), after (characters of later blocks), last (whether no block
    follows), chain (of each turn: digest chained inside the block, chars, below:
    the characters from it to the block's end)."""
    turns = F.array_sort(F.collect_list(F.struct("at", "digest", "chars")))
    grouped = rows.groupBy("conv_id", F.floor(F.col("at") / BLOCK).alias("block")).agg(turns.alias("turns"))
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("chars", pa.int64()), ("below", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for turns in b.column("turns").to_pylist():
                now, below, chain = b"", sum(t["chars"] for t in turns), []
                for t in turns:
                    now = hashlib.sha256(now + t["digest"]).digest()
                    chain.append({"digest": now, "chars": t["chars"], "below": below})
                    below -= t["chars"]
                out.append(chain)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), pa.array(out, kind)], names=["conv_id", "block", "chain"])

    blocks = stored(grouped.mapInArrow(run, "conv_id bigint, block bigint, chain array<struct<digest:binary,chars:bigint,below:bigint>>"))
    # The chain over the blocks: only conversations of several blocks have one.
    tops = blocks.select("conv_id", "block", F.element_at("chain", -1)["digest"].alias("digest"), F.element_at("chain", 1)["below"].alias("chars"))
    tops = tops.join(tops.where("block > 0").select("conv_id").distinct(), "conv_id", "left_semi")
    tops = tops.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "digest", "chars"))).alias("tops"))
    names = ["conv_id", "block", "parent", "after", "last"]
    arrow = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()), strict=True)))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, tops in zip(b.column("conv_id").to_pylist(), b.column("tops").to_pylist(), strict=True):
                now, after, out = ROOT, sum(t["chars"] for t in tops), []
                for t in tops:
                    after -= t["chars"]
                    out.append((key, t["block"], now, after, t is tops[-1]))
                    now = hashlib.sha256(now + t["digest"]).digest()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    begun = tops.mapInArrow(starts, "conv_id bigint, block bigint, parent binary, after bigint, last boolean")
    return blocks.join(begun, ["conv_id", "block"], "left").select(
        "conv_id",
        (F.col("block") * BLOCK + 1).alias("first"),
        F.coalesce("parent", F.lit(ROOT)).alias("parent"),
        F.coalesce("after", F.lit(0)).alias("after"),
        F.coalesce("last", F.lit(True)).alias("last"),
        "chain",
    )


def prefixes(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, depth, digest, parent (the shorter prefix), chars (of the last
    turn), below (characters from it to the conversation's end), ends (whether it
    is the whole conversation): every prefix of every conversation, the empty one too."""
    blocks = stored(chained(rows))
    turns = blocks.select("*", F.posexplode("chain").alias("i", "t"))
    digest = binary_sha(F.concat("parent", "t.digest"))
    shorter = F.when(F.col("i") == 0, F.col("parent")).otherwise(binary_sha(F.concat("parent", F.get("chain", F.col("i") - 1)["digest"])))
    ends = F.col("last") & (F.col("i") == F.size("chain") - 1)
    turns = turns.select("conv_id", (F.col("first") + F.col("i")).alias("depth"), digest.alias("digest"), shorter.alias("parent"), "t.chars", (F.col("after") + F.col("t.below")).alias("below"), ends.alias("ends"))
    totals = blocks.where("first = 1").select("conv_id", (F.col("after") + F.element_at("chain", 1)["below"]).alias("below"))
    root = convs.join(totals, "conv_id", "left").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("chars"), F.coalesce("below", F.lit(0)).alias("below"), F.col("below").isNull().alias("ends"),
    )
    return root.unionByName(turns)


def ends_digests(paths: DataFrame) -> DataFrame:
    """digest, ends_sha256: of the ids whose conversations are that whole prefix, ascending and joined by commas."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, ids, size = None, None, [], 0
        schema = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
        for b in batches:
            out = []
            for digest, key in zip(b.column("digest").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if digest != now or size >= PIECE:
                    if ids:
                        out.append((now, first, ",".join(ids)))
                    now, first, ids, size = digest, key, [], 0
                ids.append(str(key))
                size += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((now, first, ",".join(ids)), schema, strict=True)], schema=schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, schema = None, None, pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])
        for b in batches:
            out = []
            for digest, ids in zip(b.column("digest").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if digest != now:
                    if sha:
                        out.append((now, sha.hexdigest()))
                    now, sha = digest, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((now, sha.hexdigest()), schema, strict=True)], schema=schema)

    own = paths.where("ends").select("digest", "conv_id").repartitionByRange(parts(paths.sparkSession), "digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    pieces = own.mapInArrow(joined, "digest binary, first bigint, ids string")
    return pieces.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(hashed, "digest binary, ends_sha256 string")


def trie(conversations: DataFrame, shared: bool = False) -> DataFrame:
    """The nodes of the conversations' trie: depth, digest, parent (digest), conv_id,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    With `shared`, conversations first take the first turns of their hundred's first one."""
    turns = turn_rows(conversations)
    if shared:
        convs, rows = rebuilt(turns)
    else:
        rows = stored(placed(turns))
        convs = rows.select("conv_id").distinct()
    paths = stored(prefixes(convs, rows))
    members = paths.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("chars").alias("chars"), F.sum("below").alias("all_chars"))
    members = stored(members)
    children = members.where("parent IS NOT NULL").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = stored(members.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # What each conversation owns: the nodes from depth `since` on, their characters, and the leaf at its end if that is one.
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("since"), F.sum("chars").alias("own"), (F.max_by("n_children", "depth") == 0).cast("long").alias("leaf"))
    below = F.when(F.col("depth") >= F.col("since"), F.col("below")).otherwise(F.col("own"))
    exploded = paths.select("conv_id", "depth", "digest", "below").join(owned, "conv_id").select("depth", "digest", below.alias("own"), "leaf")
    sums = exploded.groupBy("depth", "digest").agg(F.sum("own").alias("own"), F.sum("leaf").alias("n_leaves"))
    nodes = nodes.join(sums, ["depth", "digest"]).withColumn("saved_tokens", F.col("all_chars") - F.col("own")).drop("all_chars", "own", "chars")
    nodes = stored(nodes.join(ends_digests(paths), "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(ROOT.hex()))))
    above = nodes.where("n_children > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("rows"))
    inner = joined_hot(nodes.where("parent IS NOT NULL"), above, "parent", "rows", nodes.count())
    return inner.unionByName(nodes.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all rebuilt conversations' trie."""
    nodes = trie(table(spark, sf_dir, "conversations"), shared=True)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY pos) AS turns FROM t GROUP BY conv_id
), h AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT),
    lambda crc, b: list_reduce([xor(crc, b)] || range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h FROM c
), rebuilt AS (
  SELECT h.conv_id, coalesce(b.turns[1:h.h], []) || h.turns[h.h + 1:] AS turns FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100
), prefixes AS (
  SELECT conv_id, len(turns) AS n, d AS depth, CAST(to_json(turns[1:d]) AS VARCHAR) AS prefix, CASE WHEN d > 0 THEN CAST(to_json(turns[1:d - 1]) AS VARCHAR) END AS parent,
    CASE WHEN d > 0 THEN length(turns[d].text) ELSE 0 END AS chars FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT depth, prefix, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM prefixes GROUP BY depth, prefix
), children AS (
  SELECT parent AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent
), whole AS (
  SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (prefix)
), above AS (
  SELECT p.prefix, w.n_children, w.n_convs, w.chars FROM whole w
  JOIN prefixes q ON q.conv_id = w.conv_id AND q.depth = w.depth JOIN prefixes p ON p.conv_id = w.conv_id AND p.depth <= w.depth
), sums AS (
  SELECT prefix, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens FROM above GROUP BY prefix
)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM whole w LEFT JOIN whole p ON p.prefix = w.parent JOIN sums ON sums.prefix = w.prefix
"""
