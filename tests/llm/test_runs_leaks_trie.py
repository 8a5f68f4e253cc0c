"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomspark.llm import decontamination, prefix_trie, runs

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


# --- conversation prefix trie --------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string"


def brute_trie(rows, shared):
    """Nodes by the definitions, from (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, role, sha(f"{len(role)}:{role}{text}"), text))
    plain = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        paths[c] = tuple(plain.get(base, [])[:h] + own[h:]) if shared else tuple(own)
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = set()
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(who) if paths[c] == node)
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        leaves = sum(n not in children for n in below)
        out.add((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children.get(node, ())), leaves, saved, sha(ends)))
    return out


def nodes_of(df, shared):
    got = prefix_trie.trie(df, shared).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 215), -7, -104, -100]:
        for k in range(rng.randrange(0, 9)):
            rows.append((c, rng.choice([k, k, None]) if c % 9 == 0 else k, rng.choice(["user", "assistant"][: 1 + k % 2]), rng.choice(["a", "bb", "é中", ""][: 1 + k % 4])))
    # Copies, a repeated row, a null id, null roles and texts, a conversation that is another's prefix.
    rows += [(300 + k, t, "user", "same") for k in range(20) for t in range(3)] + [(310, 3, "user", "more"), (311, 3, None, None), (311, 3, None, None), (None, 0, "user", "x")]
    return rows


@pytest.mark.parametrize("shared", [True, False])
def test_trie_against_brute_force(spark, talks, shared):
    df = spark.createDataFrame(talks, TURNS).withColumn("digest", F.lit("clash")).withColumn("depth", F.lit(1))
    assert nodes_of(df.repartition(5), shared) == brute_trie(talks, shared)


def test_trie_of_long_conversations_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "PIECE", 8)
    # Long conversations that part in, before and after a block's border, some of them copies; the last turns have no text.
    rows = [(c, k, "user", "" if k > 20 else f"w{k if k < cut else -c % 3}") for c, cut in ((100, 99), (101, 7), (102, 8), (103, 9), (104, 99), (105, 12), (106, 7)) for k in range(25 if c != 105 else 12)]
    rows += [(1000 + c, k, "u", "z") for c in range(30) for k in range(8)]
    assert nodes_of(spark.createDataFrame(rows, TURNS), False) == brute_trie(rows, False)
    assert nodes_of(spark.createDataFrame(rows, TURNS), True) == brute_trie(rows, True)


def test_trie_of_an_empty_table_and_of_no_turns(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS), True).count() == 0
    # Conversation 1 (h = 5) loses its turns, and its hundred has no first conversation.
    h = zlib.crc32(b"1") % 6
    rows = [(1, k, "user", "t") for k in range(h)]
    assert nodes_of(spark.createDataFrame(rows, TURNS), True) == brute_trie(rows, True) == {(1, 0, None, 1, 0, 1, 0, sha("1"))}


# --- benchmark decontamination ---------------------------------------------------


def brute_leaks(docs, benchmark, width=10):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = defaultdict(set)
    for item, text in benchmark:
        w = cut(text)
        span = min(width, len(w))
        for i in range(len(w) - span + 1 if span else 0):
            windows[tuple(w[i : i + span])].add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, items = cut(text), set(), set()
        for span in {len(x) for x in windows}:
            for i in range(len(w) - span + 1):
                if (x := tuple(w[i : i + span])) in windows:
                    hit.update(range(i, i + span))
                    items |= windows[x]
        out.append((doc_id, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return sorted(out, key=str)


def leaks(spark, docs, benchmark):
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(benchmark, "item_id bigint, text string")
    found = decontamination.report(d.withColumn("row", F.lit(1)).withColumn("prints", F.lit(2)), b.withColumn("row", F.lit(1)))
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), sha(",".join(r["items"])), r.n_hit > 0) for r in found.collect()]
    return sorted(got, key=str)


def test_winnowing_guarantee():
    import numpy as np

    rng = random.Random(2)
    for _ in range(300):
        w = rng.randrange(1, 8)
        grams = np.array([rng.randrange(6) for _ in range(rng.randrange(w, 40))], np.uint64)
        want = {j for i in range(len(grams) - w + 1) for j in range(i, i + w) if grams[j] == min(grams[i : i + w])}
        assert set(decontamination.winnowed(grams, w).tolist()) == want


@pytest.mark.parametrize("mapped", [True, False])
def test_leaks_against_brute_force(spark, monkeypatch, mapped):
    if not mapped:
        monkeypatch.setattr(decontamination, "MAPPED", 0)
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "é", "中文", "Tie"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    benchmark = [(k, text(rng.randrange(11, 60))) for k in range(40)]
    # Short items, one word, no words, repeated and null ids, a passage that items share, a periodic item.
    shared = text(14)
    benchmark += [(50, "w1 w2 w3"), (51, "w9 W9! w7, w8 w7"), (52, "w5"), (53, "?!"), (54, None), (3, text(20)), (None, text(15)), (60, "q " * 30), (61, "q q q q")]
    benchmark += [(70 + k, f"{text(4)} {shared} {text(3)}") for k in range(12)]
    docs = [(k, text(rng.randrange(0, 90))) for k in range(60)]
    for k in range(60, 160):
        w = rng.choice(benchmark)[1] or ""
        w = w.split()
        at, n = rng.randrange(max(1, len(w))), rng.choice([5, 9, 10, 11, 60])
        docs.append((k, f"{text(rng.randrange(20))}. {', '.join(w[at : at + n]).upper()}\n{text(rng.randrange(20))}"))
    docs += [(200, None), (201, ""), (202, "q " * 500), (202, "q " * 500), (None, shared), (203, shared + " " + shared), (204, text(3000) + " " + benchmark[0][1])]
    assert leaks(spark, docs, benchmark) == brute_leaks(docs, benchmark)


def test_leaks_of_empty_tables(spark):
    docs, benchmark = [(1, "a b c d e f g h i j k l")], [(1, "b c d e f g h i j k")]
    assert leaks(spark, [], benchmark) == []
    assert leaks(spark, docs, []) == brute_leaks(docs, [])
    assert leaks(spark, docs, [(1, None), (None, "")]) == brute_leaks(docs, [])
    assert leaks(spark, docs, benchmark)[0][2] == 10


def test_a_collision_of_fingerprints_is_no_hit(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "gram_hashes", lambda hashes, k, span: hashes[: len(hashes) - k + 1] * 0)
    docs, benchmark = [(k, " ".join(f"v{k + j}" for j in range(30))) for k in range(10)], [(1, " ".join(f"v{j}" for j in range(5, 20))), (2, " ".join(f"u{j}" for j in range(15)))]
    assert leaks(spark, docs, benchmark) == brute_leaks(docs, benchmark)


# --- periodic runs -----------------------------------------------------------------


def brute_runs(s, least=6, times=4):
    found = {}
    for q in range(1, len(s) // times + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(1)
    sequences = []
    for _ in range(500):
        s = [rng.choice("abcdef"[: rng.choice([1, 2, 2, 3, 6])]) for _ in range(rng.randrange(0, 120))]
        if s and rng.random() < 0.5:
            p, a = rng.randrange(1, 14), rng.randrange(len(s))
            s = (s[:a] + s[a : a + p] * rng.randrange(1, 12) + s[a + p : a + p + 5]) * rng.randrange(1, 6)
        sequences.append([c.encode() for c in s])
    got = runs.text_runs(sequences)
    assert [[tuple(r) for r in g.tolist()] for g in got] == [brute_runs(s) for s in sequences]
    assert sum(map(len, got)) > 300
    few = runs.text_runs(sequences[:200], 2, 2)
    assert [[tuple(r) for r in g.tolist()] for g in few] == [brute_runs(s, 2, 2) for s in sequences[:200]]


def test_runs_in_small_chunks_and_of_long_texts(monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 7)
    monkeypatch.setattr(runs, "TOGETHER", 50)
    sequences = [[b"a"] * 300, [b"a", b"b"] * 200 + [b"c"] * 9, [b"z"] * 5, [], [str(k).encode() for k in range(400)]]
    assert [[tuple(r) for r in g.tolist()] for g in runs.text_runs(sequences)] == [brute_runs(s) for s in sequences]


def brute_rewritten(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def test_run_table_of_odd_rows(spark, odd, empty):
    extra = spark.createDataFrame([(k, " ".join(f"u{j}" for j in range(200))) for k in range(300, 360)], "doc_id bigint, text string").withColumn("runs", F.lit("clash"))
    for df in (odd, extra):
        want = []
        for r in df.select("doc_id", "text").collect():
            w = brute_rewritten(r.doc_id, (r.text or "").encode().split())
            found = brute_runs(w)
            gone = {i for s, n, q in found for i in range(s + q, s + n)}
            want.append((r.doc_id, len(w), found, b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
        got = [(r.doc_id, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in runs.found_runs(df, rewrite=True).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r.runs for r in runs.found_runs(extra, rewrite=True).collect())
    assert runs.found_runs(empty).count() == 0
