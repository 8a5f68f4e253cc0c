"""Centrality of networks of any size: waves of joins from blocks of sources.

Nothing of the network leaves the executors. Each wave is a join with the links
and a partial aggregation, stored in the shared folder; the wave before it is
deleted then, so plans stay short and a lost executor repeats one wave.

Closeness: a block holds 64 * WORDS sources, one bit each. A wave carries the
bits of the sources that have just reached a term to its neighbours; distances
are the same both ways, so the bits that are new at a term in wave d are the terms at
distance d from it. A row a term serves 64 * WORDS sources at once.

Betweenness: weights are lengths. Waves of relaxation give the lengths of the
shortest paths from each source of a block; the links that lie on some of them
make an acyclic network, in which paths are counted, and shares passed back, by
the number of links: the sum over all numbers of links is the whole, and no
order of the terms has to be known.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, stored
from .features import ranks

#: 64-bit words of a block of sources (closeness); sources of a block (betweenness); lengths that differ by less are equal.
WORDS, SOURCES, EQUAL = 16, 64, 1e-12


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, v: numbers from 0) and (src, dst, weight) between numbers, both ways."""
    terms = edges.select(F.explode(F.array("term_a", "term_b")).alias("term")).distinct()
    ids = stored(ranks(terms.withColumn("__s", F.lit(0)), "__s", "term").select("term", (F.col("rank") - 1).cast("long").alias("v")))
    a, b = ids.select(F.col("term").alias("term_a"), F.col("v").alias("src")), ids.select(F.col("term").alias("term_b"), F.col("v").alias("dst"))
    one = edges.join(a, "term_a").join(b, "term_b").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    turned = one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return ids, stored(one.unionByName(turned))


def closeness(edges: DataFrame, words: int = WORDS) -> DataFrame:
    """term, closeness by numbers of links, scaled by the size of the component."""
    ids, links = numbered(edges)
    n = ids.count()
    names = [f"w{k}" for k in range(words)]
    parts = []
    for begin in range(0, n, 64 * words):
        place = F.col("v") - begin
        bit = [F.when(F.floor(place / 64) == k, F.expr(f"shiftleft(1L, cast((v - {begin}) % 64 AS int))")).otherwise(F.lit(0).cast("long")).alias(w) for k, w in enumerate(names)]
        zero = F.lit(0).cast("long")
        own = ids.where((place >= 0) & (place < 64 * words)).select("v", *bit)
        # What has been seen at a term, what is new there, the sums, and how many are new.
        state = stored(own.select("*", *(F.col(w).alias(f"new_{w}") for w in names), zero.alias("reached"), zero.alias("total"), F.lit(1).cast("long").alias("c")))
        wave = 0
        while not state.where("c > 0").isEmpty():
            wave += 1
            front = state.where("c > 0").select(F.col("v").alias("src"), *(F.col(f"new_{w}").alias(f"x_{w}") for w in names))
            come = links.join(front, "src").groupBy(F.col("dst").alias("v")).agg(*(F.bit_or(f"x_{w}").alias(f"x_{w}") for w in names))
            both = state.drop("c", *(f"new_{w}" for w in names)).join(come, "v", "full")
            fresh = {w: F.coalesce(f"x_{w}", zero).bitwiseAND(F.bitwise_not(F.coalesce(w, zero))) for w in names}
            count = sum((F.bit_count(x).cast("long") for x in fresh.values()), zero)
            sums = [F.coalesce(c, zero).alias(c) for c in ("reached", "total")]
            both = both.select("v", *(F.coalesce(w, zero).bitwiseOR(x).alias(w) for w, x in fresh.items()), *(x.alias(f"new_{w}") for w, x in fresh.items()), *sums, count.alias("c"))
            new = stored(both.withColumns({"reached": F.col("reached") + F.col("c"), "total": F.col("total") + wave * F.col("c")}))
            dropped(state)
            state = new
        parts.append(stored(state.select("v", "reached", "total")))
        dropped(state)
    dropped(links)
    if not parts:
        return ids.select("term", F.lit(0.0).alias("closeness"))
    sums = functools.reduce(DataFrame.unionByName, parts).groupBy("v").agg(F.sum("reached").alias("r"), F.sum("total").alias("t"))
    near = F.when((F.col("t") > 0) & F.lit(n > 1), F.col("r") / F.col("t") * F.col("r") / F.lit(max(1, n - 1))).otherwise(0.0)
    return ids.join(sums, "v").select("term", near.alias("closeness"))


def distances(links: DataFrame, sources: DataFrame) -> DataFrame:
    """s, v, d: the lengths of the shortest paths from the sources (s)."""
    state = stored(sources.select("s", F.col("s").alias("v"), F.lit(0.0).alias("d")))
    front = state
    while True:
        come = front.join(links, front["v"] == links["src"]).groupBy("s", "dst").agg(F.min(F.col("d") + F.col("weight")).alias("e")).withColumnRenamed("dst", "v")
        both = state.join(come, ["s", "v"], "full")
        better = F.col("e").isNotNull() & (F.col("d").isNull() | (F.col("e") < F.col("d") - EQUAL))
        new = stored(both.select("s", "v", F.when(better, F.col("e")).otherwise(F.col("d")).alias("d"), better.alias("better")))
        dropped(state)
        state, front = new, new.where("better")
        if front.isEmpty():
            return state


def _waves(first: DataFrame, step, name: str) -> DataFrame:
    """The sums by (s, v) of a column over the first table and all that `step` makes of the last one."""
    tables = [stored(first)]
    while not tables[-1].isEmpty():
        tables.append(stored(step(tables[-1])))
    out = stored(functools.reduce(DataFrame.unionByName, tables).groupBy("s", "v").agg(F.sum(name).alias(name)))
    dropped(*tables)
    return out


def betweenness(edges: DataFrame, sources: int = SOURCES, pivots: int | None = None, seed: int = 42) -> DataFrame:
    """term, betweenness (normalized): of shortest paths from all terms, or from
    `pivots` terms drawn by a hash, scaled up to all (an estimate without bias)."""
    ids, links = numbered(edges)
    n = ids.count()
    order = F.struct(F.xxhash64("v", F.lit(seed)), "v")
    # Places of the sources; a block is a range of them.
    drawn = ids if pivots is None or pivots >= n else ids.orderBy(order).limit(pivots)
    placed = stored(ranks(drawn.select("v", F.xxhash64("v", F.lit(seed)).alias("__h")), "__h", "v").select("v", "rank"))
    many, parts = placed.count(), []
    for begin in range(0, many, sources):
        block = placed.where((F.col("rank") > begin) & (F.col("rank") <= begin + sources)).select(F.col("v").alias("s"))
        d = distances(links, block)
        u, v = d.select("s", F.col("v").alias("u"), F.col("d").alias("du")), d.select("s", F.col("v").alias("x"), F.col("d").alias("dx"))
        on = links.select(F.col("src").alias("u"), F.col("dst").alias("x"), "weight")
        dag = u.join(on, "u").join(v, ["s", "x"]).where((F.abs(F.col("du") + F.col("weight") - F.col("dx")) <= EQUAL) & (F.col("dx") > F.col("du")))
        dag = stored(dag.select("s", "u", F.col("x").alias("v")))
        paths = _waves(
            block.select("s", F.col("s").alias("v"), F.lit(1.0).alias("paths")),
            lambda t, dag=dag: dag.join(t.withColumnRenamed("v", "u"), ["s", "u"]).groupBy("s", "v").agg(F.sum("paths").alias("paths")),
            "paths",
        )
        pu, pv = paths.select("s", F.col("v").alias("u"), F.col("paths").alias("a")), paths.select("s", "v", F.col("paths").alias("b"))
        share = stored(dag.join(pu, ["s", "u"]).join(pv, ["s", "v"]).select("s", "u", "v", (F.col("a") / F.col("b")).alias("p")))
        held = _waves(
            share.groupBy("s", F.col("u").alias("v")).agg(F.sum("p").alias("y")),
            lambda t, share=share: share.join(t, ["s", "v"]).groupBy("s", F.col("u").alias("v")).agg(F.sum(F.col("p") * F.col("y")).alias("y")),
            "y",
        )
        parts.append(stored(held.where("s <> v").groupBy("v").agg(F.sum("y").alias("y"))))
        dropped(d, dag, paths, share, held)
    dropped(links, placed)
    scale = (n / many if many else 0.0) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    if not parts:
        return ids.select("term", F.lit(0.0).alias("betweenness"))
    sums = functools.reduce(DataFrame.unionByName, parts).groupBy("v").agg((F.sum("y") * scale).alias("betweenness"))
    return ids.join(sums, "v", "left").select("term", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))
