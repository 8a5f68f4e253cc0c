"""Walks over networks, communities, topics and clusters against plain versions on small inputs."""

import itertools
import math
import random
import re
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import features, graph, models, yake


def network(spark, n=14, edges=24, seed=3):
    rng = random.Random(seed)
    names = [f"t{k:02d}" for k in range(n)]
    pairs = rng.sample(list(itertools.combinations(names, 2)), edges)
    rows = [(a, b, float(rng.choice((1, 1, 2, 3)))) for a, b in pairs] + [("x1", "x2", 2.0)]
    return rows, spark.createDataFrame(rows, "term_a string, term_b string, weight double").persist()


def distances(rows, hops):
    names = sorted({t for a, b, _ in rows for t in (a, b)})
    d = {(a, b): 0.0 if a == b else math.inf for a in names for b in names}
    for a, b, w in rows:
        d[a, b] = d[b, a] = 1.0 if hops else w
    for k, a, b in itertools.product(names, repeat=3):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return names, d


def path_counts(rows, names, d):
    """Numbers of shortest paths: a path's last edge is tight."""
    weight = {(a, b): w for x, y, w in rows for a, b in ((x, y), (y, x))}
    count = {}
    for s in names:
        for t in sorted((t for t in names if d[s, t] < math.inf), key=lambda t: d[s, t]):
            count[s, t] = 1 if s == t else sum(count[s, u] for u in names if (u, t) in weight and d[s, u] + weight[u, t] == d[s, t])
    return count


def test_metrics_against_all_pairs(spark):
    rows, edges = network(spark)
    got = {r.term: r for r in graph.metrics(edges).collect()}
    names, far = distances(rows, hops=False)
    count, n = path_counts(rows, names, far), len(names)
    _, steps = distances(rows, hops=True)
    share = defaultdict(float)
    for s, t in itertools.permutations(names, 2):
        for v in names:
            if v not in (s, t) and far[s, t] < math.inf and far[s, v] + far[v, t] == far[s, t]:
                share[v] += count[s, v] * count[v, t] / count[s, t]
    matrix = np.zeros((n, n))
    for a, b, w in rows:
        matrix[names.index(a), names.index(b)] = matrix[names.index(b), names.index(a)] = w
    rank = np.full(n, 1 / n)
    for _ in range(500):
        rank = 0.15 / n + 0.85 * (rank / matrix.sum(axis=1)) @ matrix
    for k, t in enumerate(names):
        near = [steps[t, u] for u in names if u != t and steps[t, u] < math.inf]
        assert got[t].degree == int((matrix[k] > 0).sum())
        assert got[t].betweenness == pytest.approx(share[t] / ((n - 1) * (n - 2)), abs=1e-6)
        assert got[t].closeness == pytest.approx(len(near) / sum(near) * len(near) / (n - 1), abs=1e-6)
        assert got[t].pagerank == pytest.approx(rank[k], abs=2e-4)


def modularity(rows, member):
    total = sum(w for *_, w in rows)
    inside, degree = defaultdict(float), defaultdict(float)
    for a, b, w in rows:
        degree[member[a]] += w
        degree[member[b]] += w
        if member[a] == member[b]:
            inside[member[a]] += w
    return sum(inside[c] / total - (degree[c] / (2 * total)) ** 2 for c in degree)


def test_modularity_cannot_grow_by_a_union(spark):
    rows, edges = network(spark, 20, 34, 8)
    member = {r.term: r.community_id for r in graph.communities(edges).collect()}
    best, groups = modularity(rows, member), sorted(set(member.values()))
    assert best > modularity(rows, {t: t for t in member}) and len(groups) > 2
    for a, b in itertools.combinations(groups, 2):
        assert modularity(rows, {t: a if c == b else c for t, c in member.items()}) <= best + 1e-9
    sizes = Counter(member.values())
    assert [sizes[c] for c in groups] == sorted(sizes.values(), reverse=True)


def test_label_propagation_against_a_plain_loop(spark):
    rows, edges = network(spark, 20, 34, 9)
    near = graph.neighbours(rows)
    label = {t: t for t in near}
    for _ in range(10):
        votes = {t: Counter({label[t]: 0.5}) for t in near}
        for t, around in near.items():
            for u, w in around.items():
                votes[t][label[u]] += w
        label = {t: min(v, key=lambda x: (-v[x], x)) for t, v in votes.items()}
    got = {r.term: r.community_id for r in graph.communities(edges, "label_propagation").collect()}
    groups = lambda m: {frozenset(t for t in m if m[t] == c) for c in m.values()}
    assert groups(got) == groups(label)


def test_main_path_against_all_paths(spark):
    rows, edges = network(spark, 9, 16, 5)
    weight = {(a, b): w for a, b, w in rows}
    names = sorted({t for e in weight for t in e})
    paths = [p for n in range(1, len(names) + 1) for p in itertools.combinations(names, n) if all(e in weight for e in itertools.pairwise(p))]
    length = lambda p: sum(weight[e] for e in itertools.pairwise(p))
    got = [r.term for r in graph.main_path(edges).orderBy("position").collect()]
    assert tuple(got) in paths and length(got) == max(map(length, paths))


def test_backbone_is_a_maximum_spanning_forest(spark):
    rows, edges = network(spark, 7, 11, 6)
    got = graph.main_path(edges, "cooccurrence_backbone").orderBy("position").collect()
    names = sorted({t for a, b, _ in rows for t in (a, b)})

    def parts(chosen):
        root = {t: t for t in names}
        for a, b, _ in chosen:
            old, new = root[a], root[b]
            root = {t: new if r == old else r for t, r in root.items()}
        return len(set(root.values()))

    size = len(names) - parts(rows)
    best = max(sum(w for *_, w in c) for c in itertools.combinations(rows, size) if parts(c) == len(names) - size)
    kept, left = [], sorted(rows, key=lambda e: (-e[2], e[0], e[1]))
    for e in left:
        if parts([*kept, e]) < parts(kept):
            kept.append(e)
    assert sum(w for *_, w in kept) == best
    order = {}
    for a, b, w in kept:
        order.setdefault(a, w)
        order.setdefault(b, w)
    assert [(r.term, r.edge_weight, r.path_length) for r in got] == [(t, w, size) for t, w in order.items()]


BLOCKS = [["battery", "recycling", "supply", "chain", "metal"], ["writing", "citation", "review", "author", "journal"]]


@pytest.fixture(scope="module")
def blocks(spark):
    rng = random.Random(4)
    rows = [(f"d{k:02d}", f"title {k}", 2020 + k % 3, "s", f"inst{k % 2}", rng.choices(BLOCKS[k % 2], k=12)) for k in range(24)]
    corpus = spark.createDataFrame(rows, "doc_id string, title string, year int, source string, institution string, filtered_tokens array<string>").persist()
    weights = features.tfidf(corpus).persist()
    return corpus, weights, features.feature_terms(weights, None).persist()


def dense(blocks):
    corpus, weights, f = blocks
    terms = [r.term for r in f.orderBy("rank").collect()]
    docs = sorted(r.doc_id for r in corpus.collect())
    m = np.zeros((len(docs), len(terms)))
    for r in weights.collect():
        m[docs.index(r.doc_id), terms.index(r.term)] = r.w
    return docs, terms, m


def test_nmf_against_dense_updates(blocks):
    corpus, weights, f = blocks
    docs, terms, m = dense(blocks)
    rows, _ = models.vectors(weights, f, corpus)
    got, weighed = models.nmf(rows, len(terms), 2)
    h = np.random.default_rng(models.SEED).random((2, len(terms))) + 0.1

    def solve(h, steps):
        w = np.full((len(m), 2), 0.1)
        for _ in range(steps):
            w *= (m @ h.T) / (w @ (h @ h.T) + 1e-12)
        return w

    for _ in range(60):
        w = solve(h, 30)
        new = h * (w.T @ m) / (w.T @ w @ h + 1e-12)
        change = np.abs(new - h).sum() / (np.abs(h).sum() + 1e-12)
        h = new
        if change < 1e-4:
            break
    assert got == pytest.approx(h, rel=1e-6, abs=1e-9)
    assert np.linalg.norm(m - solve(h, 60) @ h) < 0.75 * np.linalg.norm(m)
    last = solve(h, 60)
    for r in weighed.collect():
        assert r.weights == pytest.approx(last[docs.index(r.doc_id)], rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("algorithm", ["nmf", "lda"])
def test_topics_find_the_blocks(blocks, algorithm):
    corpus, weights, f = blocks
    terms, docs, summary = models.topics(corpus, weights, f, 2, algorithm)
    topic = {r.doc_id: r.topic_id for r in docs.collect()}
    assert len({topic[d] for d in topic if int(d[1:]) % 2 == 0}) == 1 and len(set(topic.values())) == 2
    for t in (0, 1):
        assert {r.term for r in terms.where(F.col("topic_id") == t).collect()} <= set(BLOCKS[0]) or {r.term for r in terms.where(F.col("topic_id") == t).collect()} <= set(BLOCKS[1])
    assert sorted(r.document_count for r in summary.collect()) == [12, 12]
    counts = {(r.institution, r.topic_id, r.year): r.cooccurrence_count for r in features.institution_topics(corpus, docs, terms).collect()}
    assert counts == Counter((r.institution, topic[r.doc_id], r.year) for r in corpus.collect())


def test_clusters_against_a_dense_decomposition(blocks):
    corpus, weights, f = blocks
    docs, terms, m = dense(blocks)
    u, s, v = np.linalg.svd(m, full_matrices=False)
    points = models.document_clusters(corpus, weights, f, 2).collect()
    for r in points:
        assert abs(r.x) == pytest.approx(abs(u[docs.index(r.doc_id), 0] * s[0]), abs=2e-5)
    cluster = {r.doc_id: r.cluster_id for r in points}
    assert len({cluster[d] for d in docs if int(d[1:]) % 2 == 0}) == 1 and len(set(cluster.values())) == 2
    words = {r.term: r for r in models.keyword_clusters(weights, f, corpus, 2).collect()}
    assert {frozenset(t for t in words if words[t].cluster_id == c) for c in (0, 1)} == {frozenset(b) for b in BLOCKS}
    width = min(32, 8, len(terms) - 1, len(docs) - 1)
    place = v[:width].T * s[:width]
    for c in (0, 1):
        own = [t for t in terms if words[t].cluster_id == c]
        center = place[[terms.index(t) for t in own]].mean(axis=0)
        assert all(words[t].distance_to_centroid == pytest.approx(np.linalg.norm(place[terms.index(t)] - center), abs=1e-4) for t in own)


def test_yake_against_the_published_measures():
    text = "Battery recycling saves metal. Metal recovery from battery waste is hard. NASA likes battery recycling"
    stop = frozenset({"from", "is"})
    sentences = [re.findall(r"\w+|[^\w\s]", s) for s in re.split(r"(?<=\.)\s", text)]
    low = [[w.lower() for w in s if w.isalnum()] for s in sentences]
    tf = Counter(itertools.chain(*low))
    content = [n for t, n in tf.items() if t not in stop]

    def weight(t):
        upper = sum(w.isupper() and len(w) > 1 and w.lower() == t for s in sentences for w in s)
        capital = sum(w[0].isupper() and i > 0 and w.lower() == t for s in sentences for i, w in enumerate(s))
        where = [k for k, s in enumerate(low) for w in s if w == t]
        casing, position = max(upper, capital) / (1 + math.log(tf[t])), math.log(math.log(3 + statistics.median(where)))
        frequency = tf[t] / (statistics.fmean(content) + statistics.pstdev(content))
        sides = []
        for step in (range(-2, 0), range(1, 3)):
            around = [s[i + j] for s in low for i, w in enumerate(s) if w == t for j in step if 0 <= i + j < len(s)]
            sides.append(len(set(around)) / len(around) if around else 0)
        related = 1 + sum(sides) * tf[t] / max(tf.values())
        return related * position / (casing + frequency / related + len(set(where)) / len(low) / related)

    want = {}
    for n in (1, 2, 3):
        for s in low:
            for i in range(len(s) - n + 1):
                gram = tuple(s[i : i + n])
                if gram[0] in stop or gram[-1] in stop:
                    continue
                ws = [weight(t) for t in gram if t not in stop]
                count = sum(tuple(x[k : k + n]) == gram for x in low for k in range(len(x) - n + 1))
                want[" ".join(gram)] = math.prod(ws) / (count * (1 + sum(ws)))
    got = dict(yake.extract(text, 1000, stop, similar=1.1))
    assert got == pytest.approx(want)
    assert [g for g, _ in yake.extract(text, 3, stop, similar=1.1)] == sorted(want, key=lambda g: (want[g], g))[:3]
