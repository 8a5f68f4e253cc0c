"""SimHash near-duplicates through vantage-point trees (operator 1).

Fingerprints that differ in at most `radius` bits are linked; a document's
component is the smallest doc_id that links reach.

Exact search. The 64 bits are cut into three blocks; two fingerprints with at
most 4 differing bits differ in at most one bit in some block (three blocks with
two or more would make six). For each block a vantage-point tree over the
block's codes, built from a bounded sample of fingerprints, deals the distinct
fingerprints to shards: left of a vantage point if the Hamming distance d is
below the median, right otherwise. By the triangle inequality a code within one
bit lies left only if d - 1 < median and right only if d + 1 >= median; a
fingerprint is at home in one shard and visits those that its ball overlaps.
Short codes keep that ball small (about a third of the rows cross a vantage
point's border), where a ball of radius 4 over all 64 bits would cross nearly
every border. In a shard the same tree goes on in memory down to leaves that
are compared in vectorised blocks over all 64 bits.

The sample steers only the balance: any tree gives the same links. Shards above
`cell_rows` are cut into (home part, visitor part) cells that together meet
every pair. A cell returns a spanning forest of its links instead of the pairs,
and blocks that are one component already aren't compared, so a large group of
copies costs neither pairs nor memory. Equal fingerprints meet once, as one row.

Null and blank texts have fingerprint zero and are linked like others; repeated
rows share their component; an empty table gives an empty result; a null doc_id
keeps its row and counts in a component only if no other id is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_copies
from .common import extended, free_name, joined_hot, released, small_batches, stored, table, texts
from .components import components

RADIUS, SHINGLE = 4, 4
#: Shift and width of the blocks; RADIUS // 3 is the radius in a block.
BLOCKS = ((0, 22), (22, 21), (43, 21))
NEAR = RADIUS // len(BLOCKS)
SAMPLE_ROWS, SHARDS, SHARD_ROWS, CELL_ROWS = 20_000, 64, 50_000, 100_000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The text's 64-bit SimHash: a bit is 1 if set in over half the shingles' XXH64."""
    return near_copies.majority(near_copies.shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def made(b: pa.RecordBatch) -> list:
        return [np.array([fingerprint(t, width) for t in texts(b)], np.uint64).view(np.int64)]

    return extended(docs.select("doc_id", "text"), ["doc_id"], made, "fp bigint")


# --- vantage-point trees -----------------------------------------------------


def grow(codes: np.ndarray, leaves: int, rng: np.random.Generator) -> list[tuple]:
    """A tree as a list of nodes: (vantage, median, left, right), or (-1, leaf number)."""
    nodes: list[tuple] = []
    count = 0

    def split(part: np.ndarray, want: int) -> int:
        nonlocal count
        here = len(nodes)
        nodes.append(())
        best = None
        if want > 1 and len(part) > 1:
            for vantage in rng.choice(part, 8):
                d = np.bitwise_count(part ^ vantage)
                median = int(np.median(d)) or 1
                left = int((d < median).sum())
                crossing = ((d >= median - NEAR) & (d < median + NEAR)).sum()
                cost = abs(2 * left - len(part)) + crossing
                if 0 < left < len(part) and (best is None or cost < best[0]):
                    best = (cost, int(vantage), median, d < median)
        if best is None:
            nodes[here] = (-1, count)
            count += 1
            return here
        _, vantage, median, left = best
        a = split(part[left], want // 2)
        b = split(part[~left], want - want // 2)
        nodes[here] = (vantage, median, a, b)
        return here

    split(codes, leaves)
    return nodes


def deal(nodes: list[tuple], codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, positions, at home) for all leaves that the codes' balls overlap."""
    todo = [(0, np.arange(len(codes)), np.ones(len(codes), bool))]
    while todo:
        k, at, home = todo.pop()
        if not len(at):
            continue
        if nodes[k][0] == -1:
            yield nodes[k][1], at, home
            continue
        vantage, median, a, b = nodes[k]
        d = np.bitwise_count(codes[at] ^ np.uint64(vantage)).astype(np.int16)
        for child, fits, own in ((a, d - NEAR < median, d < median), (b, d + NEAR >= median, d >= median)):
            todo.append((child, at[fits], (home & own)[fits]))


def block(fps: np.ndarray, number: int) -> np.ndarray:
    shift, width = BLOCKS[number]
    return (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)


# --- links inside a cell -----------------------------------------------------


class Forest:
    """Union-find over positions, in vectorised steps."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.parent[at]
        while True:
            up = self.parent[r]
            if (up == r).all():
                self.parent[at] = r
                return r
            r = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            new = ra != rb
            a, b, ra, rb = a[new], b[new], ra[new], rb[new]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def compare(fps: np.ndarray, home: np.ndarray, guests: np.ndarray, forest: Forest, radius: int) -> None:
    """Links of the home rows to the guests (home rows among them)."""
    for anchor in home[:: max(1, len(home) // 4)][:4]:  # joins dense groups first
        near = guests[np.bitwise_count(fps[guests] ^ fps[anchor]) <= radius]
        forest.link(np.full(len(near), anchor), near)
    home = home[np.argsort(forest.roots(home), kind="stable")]
    guests = guests[np.argsort(forest.roots(guests), kind="stable")]
    for i in range(0, len(home), 256):
        h = home[i : i + 256]
        for j in range(0, len(guests), 4096):
            g = guests[j : j + 4096]
            rh, rg = forest.roots(h), forest.roots(g)
            if (rh == rh[0]).all() and (rg == rh[0]).all():
                continue
            x, y = np.nonzero(np.bitwise_count(fps[h][:, None] ^ fps[g][None, :]) <= radius)
            forest.link(h[x], g[y])


def links(fps: np.ndarray, home: np.ndarray, number: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (position, root), of the links between home rows
    and all rows that differ in at most NEAR bits of the block."""
    codes, forest = block(fps, number), Forest(len(fps))
    todo = [(np.flatnonzero(home), np.arange(len(fps)))]
    while todo:
        h, g = todo.pop()
        if not len(h) or len(g) < 2:
            continue
        d, split = None, False
        if len(h) > 256:
            for vantage in codes[h[:: max(1, len(h) // 3)][:3]]:
                d = np.bitwise_count(codes[h] ^ vantage).astype(np.int16)
                median = max(1, int(np.median(d)))
                if split := bool((d < median).any() and (d >= median).any()):
                    break
        if not split:
            compare(fps, h, g, forest, radius)
            continue
        e = np.bitwise_count(codes[g] ^ vantage).astype(np.int16)
        todo.append((h[d < median], g[e - NEAR < median]))
        todo.append((h[d >= median], g[e + NEAR >= median]))
    root = forest.roots(np.arange(len(fps)))
    at = np.flatnonzero(root != np.arange(len(fps)))
    return at, root[at]


def similar(distinct: DataFrame, shards: int = SHARDS, shard_rows: int = SHARD_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) that connect all links between the distinct fingerprints fp."""
    n = distinct.count()
    every = max(1, n // SAMPLE_ROWS)
    sample = distinct.where(F.pmod(F.xxhash64("fp", F.lit("tree")), F.lit(every)) == 0).select("fp").limit(2 * SAMPLE_ROWS)
    seen = np.sort(np.array([r[0] for r in sample.collect()], np.int64)).view(np.uint64)
    rng = np.random.default_rng(7)
    leaves = max(shards, -(-n // shard_rows))
    trees = [grow(block(seen, k), leaves, rng) for k in range(len(BLOCKS))]

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = b["fp"].to_numpy(np.int64)
            for number, nodes in enumerate(trees):
                found = list(deal(nodes, block(fps.view(np.uint64), number)))
                if found:
                    at = np.concatenate([x[1] for x in found])
                    shard = np.repeat([number + len(BLOCKS) * x[0] for x in found], [len(x[1]) for x in found])
                    yield pd.DataFrame({"shard": shard, "fp": fps[at], "home": np.concatenate([x[2] for x in found])})

    rows = stored(distinct.select("fp").mapInPandas(dealt, "shard bigint, fp bigint, home boolean"))
    # Parts of home rows and of visitors for each shard: one row a shard, as many as the trees have leaves.
    sizes = rows.groupBy("shard").agg(F.count_if("home").alias("own"), F.count_if(~F.col("home")).alias("more"))
    cells = sizes.select("shard", F.ceil(F.col("own") / cell_rows).alias("hs"), F.ceil((F.col("own") + F.col("more")) / (4 * cell_rows)).alias("vs"))
    cells = cells.select("shard", F.greatest("hs", F.lit(1)).cast("int").alias("hs"), F.greatest("vs", F.lit(1)).cast("int").alias("vs"))
    h = F.pmod(F.xxhash64("fp", F.lit("h")), F.col("hs")).cast("int")
    v = F.pmod(F.xxhash64("fp", F.lit("v")), F.col("vs")).cast("int")
    all_h, all_v = F.sequence(F.lit(0), F.col("hs") - 1), F.sequence(F.lit(0), F.col("vs") - 1)

    def cell(x, y, own):
        return F.struct(x.alias("hc"), y.alias("vc"), F.lit(own).alias("home"))

    own = F.transform(all_v, lambda y: cell(h, y, True))
    guest = F.transform(F.when(F.col("home"), F.array_remove(all_h, h)).otherwise(all_h), lambda x: cell(x, v, False))
    cut = rows.join(cells, "shard").select("shard", "fp", F.explode(F.when(F.col("home"), F.concat(own, guest)).otherwise(guest)).alias("c"))

    def linked(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy(np.int64)
        at, root = links(fps.view(np.uint64), pdf["home"].to_numpy(bool), int(key[0]) % len(BLOCKS))
        return pd.DataFrame({"a": fps[at], "b": fps[root]})

    cut = cut.select("shard", "fp", "c.hc", "c.vc", "c.home")
    return cut.groupBy("shard", "hc", "vc").applyInPandas(linked, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, **options) -> DataFrame:
    """doc_id, fp, component_id of every row of docs (doc_id, text)."""
    fps = stored(fingerprints(docs, width))
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows")))
    group = components(similar(distinct, **options))
    found = stored(distinct.join(group, distinct["fp"] == group["node"], "left").select("fp", "least", "n_rows", F.coalesce("root", "fp").alias("root")))
    ids = found.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    member = joined_hot(found.select("root", "fp", "n_rows"), stored(ids), "root", "n", found.count())
    return joined_hot(fps, stored(member.select("fp", "component_id", "n_rows")), "fp", "n_rows", fps.count()).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, width: int = near_copies.WIDTH, similarity: float = near_copies.SIMILARITY) -> DataFrame:
    """docs with one row for each component of near copies: that with its smallest doc_id.

    Near copies are texts whose `width`-word shingles have at least that Jaccard
    similarity. The SimHash search over the same shingles finds candidates, which
    are confirmed exactly; a join adds the links that fingerprints don't show (see
    near_copies). Rows are told
    apart by a hash of all their columns, so null and repeated doc_ids keep a row
    for every component; of a component's rows with the same smallest doc_id the
    one with the smallest hash stays.
    """
    small_batches(docs.sparkSession)
    found = near_copies.sets(docs, width, similarity)
    released(docs.sparkSession)
    first = near_copies.seeds(found, stored(similar(stored(found.select("fp").distinct()))))
    released(docs.sparkSession)
    group = components(near_copies.links(docs, found, first, width, similarity))
    released(docs.sparkSession)
    named = found.join(group, found["key"] == group["node"], "left").select(F.coalesce("root", "key").alias("root"), "best")
    mark = free_name("mark", docs.columns)
    kept = stored(named.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.mark").alias(mark)))
    # The kept rows grow with the corpus, so they are never broadcast: the same plan at every size.
    both = docs.withColumn(mark, near_copies.row_mark(docs)).join(kept.hint("merge"), mark)
    return both.dropDuplicates([mark]).select(*docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
