"""Term networks.

build_network and degrees scale with the co-occurrence table. The walks over a
whole graph (betweenness, closeness, communities, paths) are asked for on a
network that build_network has cut to max_edges; they check that bound
(MOST_EDGES) and run on it, betweenness and closeness spread over sources. Beyond
it these two go through waves of joins (waves.py). PageRank and label propagation
are DataFrame iterations without a bound.
"""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..storage import checkpointed

MOST_EDGES = 50_000


def build_network(pairs: DataFrame, least: float = 1, most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(term, degree), (term_a, term_b, weight): unordered pairs summed, blanks and
    loops dropped, the heaviest `most` edges kept; degrees count edges before the cut."""
    weight = "weight" if "weight" in pairs.columns else "cooccurrence_count"
    sound = pairs.where((F.trim("term_a") != "") & (F.trim("term_b") != "") & (F.col("term_a") != F.col("term_b")))
    edges = sound.groupBy(F.least("term_a", "term_b").alias("term_a"), F.greatest("term_a", "term_b").alias("term_b")).agg(F.sum(weight).alias("weight")).where(F.col("weight") >= least)
    nodes = edges.select(F.explode(F.array("term_a", "term_b")).alias("term")).groupBy("term").agg(F.count("*").alias("degree"))
    return nodes, edges.orderBy(F.desc("weight"), "term_a", "term_b").limit(most)


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst, weight of each edge in both directions."""
    turned = edges.select(F.col("term_b").alias("src"), F.col("term_a").alias("dst"), "weight")
    return edges.select(F.col("term_a").alias("src"), F.col("term_b").alias("dst"), "weight").unionByName(turned)


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("term")).agg(F.count("*").alias("degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """term, pagerank over undirected weighted edges, by power iteration in DataFrames.

    A round is one join and one partial aggregation; the lineage is cut by
    checkpoint() every few rounds.
    """
    links = both_ways(edges)
    out = links.groupBy("src").agg(F.sum("weight").alias("total"))
    links = links.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")).persist()
    n = out.count()
    if not n:
        return out.select(F.col("src").alias("term"), F.lit(0.0).alias("pagerank"))
    rank = out.select(F.col("src").alias("term"), F.lit(1.0 / n).alias("pagerank"))
    for k in range(rounds):
        given = links.join(rank, links["src"] == rank["term"]).groupBy("dst").agg(F.sum(F.col("pagerank") * F.col("share")).alias("got"))
        new = given.select(F.col("dst").alias("term"), (F.lit((1 - damping) / n) + damping * F.col("got")).alias("pagerank"))
        if k % 5 == 4:
            new = checkpointed(new)
            change = new.join(rank.withColumnRenamed("pagerank", "old"), "term").agg(F.sum(F.abs(F.col("pagerank") - F.col("old")))).first()[0]
            if change < n * tolerance:
                rank = new
                break
        rank = new
    return rank


def bounded(edges: DataFrame, most: int = MOST_EDGES) -> list[tuple[str, str, float]]:
    """The edges on the driver; ValueError if there are more than `most`."""
    rows = edges.orderBy(F.desc("weight"), "term_a", "term_b").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges: cut the network by build_network(most=...)")
    return [(r["term_a"], r["term_b"], float(r["weight"])) for r in rows]


def neighbours(edges: list[tuple[str, str, float]]) -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = defaultdict(dict)
    for a, b, w in edges:
        out[a][b] = out[b][a] = w
    return dict(out)


def shortest_paths(graph: dict, source: str) -> dict[str, float]:
    """Each term's dependency of the source: shares of shortest paths, weights as lengths."""
    length, paths, before, done = {source: 0.0}, defaultdict(float, {source: 1.0}), defaultdict(list), []
    heap, settled = [(0.0, source)], set()
    while heap:
        d, v = heapq.heappop(heap)
        if v in settled:
            continue
        settled.add(v)
        done.append(v)
        for u, w in graph[v].items():
            far = d + w
            if u not in length or far < length[u] - 1e-12:
                length[u], paths[u], before[u] = far, paths[v], [v]
                heapq.heappush(heap, (far, u))
            elif abs(far - length[u]) <= 1e-12 and u not in settled:
                paths[u] += paths[v]
                before[u].append(v)
    share: dict[str, float] = defaultdict(float)
    for v in reversed(done):
        for u in before[v]:
            share[u] += paths[u] / paths[v] * (1 + share[v])
    share.pop(source, None)
    return share


def hops(graph: dict, source: str) -> tuple[int, int]:
    """Terms reached and the sum of their distances in edges."""
    seen, queue, total = {source: 0}, deque([source]), 0
    while queue:
        v = queue.popleft()
        total += seen[v]
        for u in graph[v]:
            if u not in seen:
                seen[u] = seen[v] + 1
                queue.append(u)
    return len(seen) - 1, total


def metrics(edges: DataFrame, most: int = MOST_EDGES, pivots: int | None = None) -> DataFrame:
    """term, degree, pagerank, betweenness (weights as lengths, normalized), closeness (by edges, scaled by component).

    Up to `most` edges every source is one unit of work over the broadcast
    graph. Larger networks go through waves of joins (see waves), with
    betweenness from `pivots` sources, or from all.
    """
    if edges.limit(most + 1).count() > most:
        from . import waves

        wide = degrees(edges).join(pagerank(edges), "term").join(waves.betweenness(edges, pivots=pivots), "term").join(waves.closeness(edges), "term")
        return wide.select("term", "degree", *(F.round(c, 6).alias(c) for c in ("pagerank", "betweenness", "closeness")))
    graph = neighbours(bounded(edges, most))
    spark, n = edges.sparkSession, len(graph)
    shared = spark.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Summed over a task's sources: a task returns a row a term at most.
        close, between = defaultdict(float), defaultdict(float)
        for b in batches:
            for source in b["term"]:
                reached, total = hops(shared.value, source)
                close[source] += reached / total * reached / (n - 1) if total and n > 1 else 0.0
                for t, s in shortest_paths(shared.value, source).items():
                    between[t] += s
        terms = sorted(close.keys() | between.keys())
        yield pd.DataFrame({"term": terms, "c": [close[t] for t in terms], "b": [between[t] for t in terms]})

    sources = degrees(edges)
    width = min(max(1, n // 8), spark.sparkContext.defaultParallelism * 4) or 1
    parts = sources.select("term").repartition(width).mapInPandas(run, "term string, c double, b double")
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    sums = parts.groupBy("term").agg(F.sum("c").alias("closeness"), (F.sum("b") * scale).alias("betweenness"))
    return sources.join(pagerank(edges), "term").join(sums, "term").select("term", "degree", F.round("pagerank", 6).alias("pagerank"), F.round("betweenness", 6).alias("betweenness"), F.round("closeness", 6).alias("closeness"))


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """term, label: in each round a term takes the heaviest label around it (its
    own counts a little, ties go to the smaller label)."""
    links = both_ways(edges).persist()
    labels = links.select(F.col("src").alias("term")).distinct().withColumn("label", F.col("term"))
    for k in range(rounds):
        votes = links.join(labels, links["dst"] == labels["term"]).select(F.col("src").alias("term"), "label", "weight")
        votes = votes.unionByName(labels.select("term", "label", F.lit(0.5).alias("weight"))).groupBy("term", "label").agg(F.sum("weight").alias("w"))
        labels = votes.groupBy("term").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("label"))
        if k % 3 == 2:
            labels = checkpointed(labels)
    return labels


def greedy_modularity(edges: list[tuple[str, str, float]]) -> dict[str, int]:
    """Communities by joining, as long as modularity grows, the two whose union raises it most."""
    graph = neighbours(edges)
    total = 2 * sum(w for *_, w in edges)
    member = {t: {t} for t in graph}
    strength = {t: sum(ws.values()) / total for t, ws in graph.items()}
    gain = {t: {u: 2 * (w / total - strength[t] * strength[u]) for u, w in ws.items()} for t, ws in graph.items()}
    heap = [(-g, a, b) for a, row in gain.items() for b, g in row.items() if a < b]
    heapq.heapify(heap)
    while heap:
        g, a, b = heapq.heappop(heap)
        if gain.get(a, {}).get(b) != -g:
            continue
        if -g <= 0:
            break
        into, gone = (a, b) if len(gain[a]) >= len(gain[b]) else (b, a)
        for u in set(gain[into]) | set(gain[gone]):
            if u in (into, gone):
                continue
            x = gain[into].get(u, -2 * strength[into] * strength[u]) + gain[gone].get(u, -2 * strength[gone] * strength[u])
            gain[into][u] = gain[u][into] = x
            gain[u].pop(gone, None)
            heapq.heappush(heap, (-x, *sorted((into, u))))
        gain[into].pop(gone, None)
        del gain[gone]
        strength[into] += strength.pop(gone)
        member[into] |= member.pop(gone)
    groups = sorted(member.values(), key=lambda m: (-len(m), min(m)))
    return {t: k for k, group in enumerate(groups) for t in group}


def communities(edges: DataFrame, method: str = "greedy_modularity") -> DataFrame:
    """term, community_id (0 for the largest), community_size."""
    if method == "label_propagation":
        labels = label_propagation(edges)
    else:
        found = greedy_modularity(bounded(edges))
        labels = edges.sparkSession.createDataFrame([(t, f"{k:09d}") for t, k in found.items()], "term string, label string")
    sizes = labels.groupBy("label").agg(F.count("*").alias("community_size"), F.min("term").alias("first"))
    order = sizes.withColumn("community_id", F.row_number().over(W.orderBy(F.desc("community_size"), "first")) - 1)  # one row a community
    return labels.join(order, "label").select("term", "community_id", "community_size")


def main_path(edges: DataFrame, mode: str = "directed_citation_or_weighted_backbone") -> DataFrame:
    """The longest weighted path when edges point from the first term to the
    second (term, position, path_length, main_path_mode, edge_weight null), or
    the terms of the maximum spanning tree by falling weight."""
    rows = bounded(edges)
    schema = "term string, position int, path_length int, main_path_mode string, edge_weight double"
    if mode != "directed_citation_or_weighted_backbone":
        return edges.sparkSession.createDataFrame(_backbone(rows), schema)
    return edges.sparkSession.createDataFrame([(t, k, len(p), "directed_longest_path", None) for p in [_longest(rows)] for k, t in enumerate(p)], schema)


def _longest(rows: list[tuple[str, str, float]]) -> list[str]:
    """Edges go from the smaller term to the larger, so the terms' order is topological."""
    best: dict[str, tuple[float, str | None]] = {t: (0.0, None) for a, b, _ in rows for t in (a, b)}
    for a, b, w in sorted(rows):
        if best[a][0] + w > best[b][0]:
            best[b] = (best[a][0] + w, a)
    # In order of the source all paths into it are final, for sources are visited ascending.
    path, at = [], max(best, key=lambda t: (best[t][0], t), default=None)
    while at is not None:
        path.append(at)
        at = best[at][1]
    return path[::-1]


def _backbone(rows: list[tuple[str, str, float]]) -> list[tuple]:
    parent: dict[str, str] = {}

    def root(t: str) -> str:
        while parent.setdefault(t, t) != t:
            parent[t] = parent[parent[t]]
            t = parent[t]
        return t

    kept = []
    for a, b, w in sorted(rows, key=lambda e: (-e[2], e[0], e[1])):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            kept.append((a, b, w))
    seen: dict[str, float] = {}
    for a, b, w in kept:
        seen.setdefault(a, w)
        seen.setdefault(b, w)
    return [(t, k, len(kept), "cooccurrence_backbone", w) for k, (t, w) in enumerate(seen.items())]


def link_prediction(edges: DataFrame, top: int = 200) -> DataFrame:
    """Jaccard scores of the best pairs of terms that are not adjacent.

    Pairs with a common neighbour come from a self-join of adjacency lists; the
    rest all score 0, so only as many of them as `top` still needs are made from
    the bounded graph, the first terms in order.
    """
    links = both_ways(edges).select("src", "dst").distinct()
    degree = links.groupBy("src").agg(F.count("*").alias("d"))
    x, y = links.alias("x"), links.alias("y")
    shared = x.join(y, F.col("x.dst") == F.col("y.dst")).where("x.src < y.src").groupBy(F.col("x.src").alias("term_a"), F.col("y.src").alias("term_b")).agg(F.count("*").alias("common"))
    apart = shared.join(links, (F.col("term_a") == F.col("src")) & (F.col("term_b") == F.col("dst")), "left_anti")
    a, b = degree.select(F.col("src").alias("term_a"), F.col("d").alias("da")), degree.select(F.col("src").alias("term_b"), F.col("d").alias("db"))
    scored = apart.join(a, "term_a").join(b, "term_b").select("term_a", "term_b", F.round(F.col("common") / (F.col("da") + F.col("db") - F.col("common")), 6).alias("score"))
    best = scored.orderBy(F.desc("score"), "term_a", "term_b").limit(top)
    missing = top - best.count()
    if missing <= 0:
        return best
    graph = neighbours(bounded(edges))
    free = ((a, b) for a in sorted(graph) for b in sorted(graph) if a < b and b not in graph[a] and graph[a].keys().isdisjoint(graph[b]))
    rest = [(a, b, 0.0) for a, b in itertools.islice(free, missing)]
    zero = edges.sparkSession.createDataFrame(rest, "term_a string, term_b string, score double")
    return best.unionByName(zero).orderBy(F.desc("score"), "term_a", "term_b").limit(top)
