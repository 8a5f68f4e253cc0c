import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspark.llm import chat, common, features, licenses, merkle, mixing, near_copies, packing, quality, simhash, token_counts, topk, toxicity
from loomspark.llm.components import components

from .conftest import ODD

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def brute_components(pairs):
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)]
    pairs = [p for p in pairs if p[0] != p[1]]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == brute_components(pairs)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_fingerprint_by_definition():
    import xxhash

    for text in ("", "One two", "a B c d e a B c d", "é\xa0x y  z\tw v", "q " * 50):
        words = [w.translate(common.ASCII_LOWER) for w in text.replace("\t", " ").split(" ") if w]
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_links_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    flip = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    fps = np.unique(np.concatenate([base, *(base[:150] ^ flip(150) ^ flip(150) for _ in range(4)), *(base[:1] ^ (np.uint64(1) << rng.integers(0, 10, 300).astype(np.uint64)) ^ flip(300) for _ in range(2))]))
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    signed = fps.view(np.int64).tolist()
    want = brute_components([(signed[a], signed[b]) for a, b in near])
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    for options in ({}, {"shards": 4, "cell_rows": 40}):
        assert {r.node: r.root for r in components(simhash.similar(df, **options)).collect()} == want


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    blank = {r.component_id for r in rows if r.fp == 0}
    assert blank == {2}
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.where("text = 'tie tie tie'").collect()] == [5]
    assert simhash.near_duplicates(empty).count() == 0


def brute_kept(rows, width=5, similarity=0.8):
    """Places of the rows that stay: the smallest id, nulls last, of each component; ties go to the first row."""
    words = [[w.translate(common.ASCII_LOWER) for w in re.findall(common.WORD, t or "")] for _, t in rows]
    sets = [{tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set() for w in words]
    like = lambda a, b: len(a & b) >= similarity * len(a | b) - 1e-9
    label = brute_components([(x, y) for x in range(len(rows)) for y in range(x + 1) if like(sets[x], sets[y])])
    return sorted({min((k for k in label if label[k] == root), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)) for root in set(label.values())})


def test_near_copies_by_similarity(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(40):
        base = rng.choices(words, k=rng.randrange(3, 120))
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_kept(rows)
    assert sorted(r.doc_id for r in simhash.deduplicated(df).collect()) == want and len(want) < len(rows)
    # One word of 100 changed: five shingles of 96 on either side, Jaccard 91 / 101.
    base = [f"v{k}" for k in range(100)]
    pairs = [(0, " ".join(base)), (1, " ".join([*base[:50], "x", *base[51:]])), (2, " ".join([*base[:30], "x", *base[31:60], "y", *base[61:]])), (3, " ".join(base[:75]))]
    assert [r.doc_id for r in simhash.deduplicated(spark.createDataFrame(pairs, df.schema)).collect()] == [k for k in brute_kept(pairs)] == [0, 3]


def test_near_copies_look_once_at_a_passage(spark):
    # Sets 1 and 2 hold a passage of three shingles, 1 and 3 another one; 2, 3 and 4 hold one alike.
    held = [(k, 9, place, shingle) for k, own in ((1, [-5, 7, 8, 9, 30]), (2, [-5, 7, 8, 40]), (3, [9, 30, 40]), (4, [40])) for place, shingle in enumerate(own)]
    once = near_copies.told_once(spark.createDataFrame(held, "key bigint, size int, place int, shingle bigint"), len(held))
    assert sorted((r.shingle, r.key, r.place) for r in once.collect()) == [(-5, 1, 0), (-5, 2, 0), (9, 1, 3), (9, 3, 0), (40, 2, 3), (40, 3, 2), (40, 4, 0)]


def test_near_copies_of_null_and_repeated_ids(spark):
    rng = random.Random(10)
    texts = [" ".join(rng.choices([f"u{k}" for k in range(200)], k=60)) for _ in range(12)]
    rows = [(None, t) for t in texts[:6]] + [(7, t) for t in texts[4:9]] + [(1, texts[8]), (3, texts[9]), (3, texts[0]), (3, texts[9]), (None, None), (None, " "), (9, texts[10] + " z"), (2, texts[10])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = simhash.deduplicated(df.repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got if (r.text or "").strip()) == sorted((rows[k][0] or 0, rows[k][1]) for k in brute_kept(rows) if (rows[k][1] or "").strip())
    assert sum(not (r.text or "").strip() for r in got) == 1 and len(got) == len(brute_kept(rows)) == 12


def test_sets_that_share_half_their_hash_stay_apart(spark):
    rows = [(1, 10, 5), (1, 11, 6), (2, 12, 7), (3, 12, 8)]
    found = near_copies.told_apart(spark.createDataFrame(rows, "key bigint, key2 bigint, size int")).collect()
    assert sorted(r["size"] for r in found) == [5, 6, 7, 8] and len({r.key for r in found}) == 4 and {r.key for r in found} > {2, 3}
    one = spark.createDataFrame([("a", None), (None, "a"), ("", "a")], "a string, b string")
    marks = one.select(near_copies.row_mark(one).alias("m")).collect()
    assert len({r.m.m1 for r in marks}) == len({r.m.m2 for r in marks}) == len({r.m.m1 for r in marks} | {r.m.m2 for r in marks}) / 2 == 3


def test_sample_of_a_repeated_labelled_id_is_bounded(spark):
    docs = spark.createDataFrame([(1 if k % 2 else k, f"text {k if k % 3 else 0} good" if k % 2 else f"bad {k}") for k in range(900)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 60, 2)] + [(1, 1)] * 200 + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    sample = features.labelled(docs, labels, "toxic", 3, 3, rows=100)
    assert 20 < sample.count() <= 150 and sample.where("y = 1").count() > 20
    made = spark.createDataFrame([(k % 2, b"abcd" * (k % 5), h) for k in range(300) for h in [hash(("h", k // 2))]], "y int, f binary, h bigint")
    assert features.bounded(made, 40, 1 << 20).count() == 40
    few = features.bounded(made, 200, 300).collect()
    assert sum(len(r.f) for r in few) <= 300 + 16 and len({r.h for r in few}) == len(few) > 5
    assert features.bounded(made.limit(0), 40, 100).count() == 0
    want = features.fitted(docs.limit(0).select("text", F.lit(1).alias("y"), F.lit(1).cast("long").alias("h")), lambda t: np.empty(0, np.uint64), 4, 1, lambda x, y: len(y))
    assert want == 0


def test_licenses(odd, empty):
    rows = {(r.doc_id, r.n_words): r for r in licenses.scan(odd).collect()}
    assert (rows[1, 9].n_base, rows[1, 9].first_word, rows[1, 9].last_word, rows[1, 9].base_labels) == (2, 3, 6, "gpl,mit")
    assert rows[9, 7].labels == "cc-by-nc" and rows[9, 7].n_base == 0 and rows[9, 7].score == 1.0
    assert rows[2, 0].labels == "" and rows[2, 0].first_word is None
    assert licenses.scan(empty).count() == 0


def brute_labels(text):
    found = re.findall(licenses.WORDS, text.translate(common.ASCII_LOWER))
    out = set()
    for t in licenses.template_list():
        runs = [found[k : k + t.span] for k in range(len(found))]
        blocks = [set(itertools.takewhile(lambda w, t=t: w not in t.without, r)) for r in runs]
        if any(len(set(t.words) & b) >= t.need and b >= set(t.must) for b in blocks):
            out.add(t.label)
    return out | {name for phrase, name in licenses.PHRASES if f" {phrase} " in f" {' '.join(found)} "}


def test_license_join_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = sorted({w for t in licenses.template_list() for w in t.words}) + ["zz", "yy"]
    texts = []
    for t in licenses.template_list():
        for _ in range(8):
            held = rng.sample(t.words, max(1, len(t.words) - rng.randrange(5))) + rng.sample(vocabulary, rng.randrange(8))
            rng.shuffle(held)
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randrange(60))) + "\n".join(["", *held, ""]) + " ".join(rng.choices(vocabulary, k=rng.randrange(30))))
    texts += ["lic\u212aense mit \u212a", "M\u0130T license", "the MIT\u00e9 license"]
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {k: brute_labels(text) for k, text in enumerate(texts)}
    assert any(got.values()) and not all(got.values())


def test_wrapped_licenses(spark):
    notices = [(label, text) for label, text, *_ in licenses.TEMPLATES if label in ("mpl", "bsd", "mit", "apache")]
    rows, want = [], []
    for label, text in notices:
        words = text.split()
        for width in (3, 7, 10):
            lines = [" ".join(words[k : k + width]) for k in range(0, len(words), width)]
            rows.append("Some code.\n\n# " + "\n# ".join(lines) + "\n\nimport os")
            want.append((label, 1.0))
    scattered = " other words stand here and there \n".join(dict(notices)["bsd"].split())
    df = spark.createDataFrame([*enumerate(rows), (99, scattered)], "doc_id bigint, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(df).collect()}
    assert got == dict(enumerate(want)) | {99: ("", 0.0)}


#: Notices as they stand in the wild, none of them a template as it is.
NOTICES = (
    ("This article is distributed under the terms of the Creative Commons Attribution-NonCommercial 4.0 International License, which permits non-commercial use.", "cc-by-nc"),
    ("Except where otherwise noted, this work is licensed under a Creative Commons Attribution 4.0 International License (https://creativecommons.org/licenses/by/4.0/).", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy, visit the site.", "cc-by-sa"),
    ("This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.", "cc-by-nc-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "cc-by-nc-nd"),
    ("Photo: J. Doe, CC BY 4.0, via the archive", "cc-by"), ("Text available under CC BY-SA 4.0.", "cc-by-sa"), ("figures (CC BY-NC-ND 4.0)", "cc-by-nc-nd"), ("Licensed under CC BY 4.0.", "cc-by"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either version 2.1", "gpl,lgpl"),
    ("along with this program; it is covered by the GNU Affero General Public License", "agpl,gpl"),
    ("// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation, either version 3 of the License", "gpl"),
    ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\n"
     "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.", "mit"),
    ("THIS SOFTWARE IS PROVIDED BY THE AUTHOR AND CONTRIBUTORS ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL", "bsd"),
    ("   distributed under the License is distributed on an \"AS IS\" BASIS,\n   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n   See the License for the specific language governing permissions and\n   limitations under the License.", "apache"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\n   License, v. 2.0. If a copy of the MPL was not distributed with this\n   file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mpl"),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use", "bsl"),
    ("The creative commons of the town are open to the public under a new license, by 4 to 0 votes, and sale is not permitted.", ""), ("The authors claim that any damages arising from use of the software are covered by a contract.", ""),
)


def test_notices_get_their_own_label_and_no_other(spark):
    df = spark.createDataFrame(list(enumerate(text for text, _ in NOTICES)), "doc_id bigint, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert got == {k: label for k, (_, label) in enumerate(NOTICES)}
    assert got == {k: ",".join(sorted(brute_labels(text))) for k, (text, _) in enumerate(NOTICES)}


def test_merkle(spark, odd, empty):
    rows = merkle.with_next(odd).collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(rows) == len(ODD) and {r.doc_id: r.next_text for r in rows}[9] == order[0][1]
    assert merkle.with_next(empty).count() == 0
    alone = merkle.with_next(odd.where("doc_id = 1")).first()
    assert alone.next_text == alone.text
    trees = [
        ("a\nb\n\nc\nd", "a\nb\n\nc\nX", ["2.2"]), ("same", "same", []), ("", "", []), ("a\nb\nc", "a\nnew\nb\nc", ["1.2"]), ("a\nb\nc", "a\nc", []),
        ("a\nb\n\nc\nd", "A\nb\n\nc\nD", ["1.1", "2.2"]), ("a", "a\n\nb", ["2.1"]), ("x\nx", "x\nx\nx", ["1.3"]),
    ]
    t = spark.createDataFrame([x[:2] for x in trees], "a string, b string").coalesce(1)
    tree = lambda c: merkle.tree(merkle.leaf_nodes(F.col(c)))
    got = t.select("a", "b", merkle.differences(tree("a"), tree("b")).alias("at"), (merkle.root(tree("a")) == merkle.root(tree("b"))).alias("same")).collect()
    assert [(r.a, r.b, r["at"]) for r in got] == trees and all(r.same == (r.a == r.b) for r in got)
    hot = spark.createDataFrame([(7, f"t{k}") for k in range(60)] + [(8, "z")], "doc_id bigint, text string")
    assert merkle.with_next(hot).count() == 61


def brute_leaves(text):
    return re.findall(merkle.LEAF, text)


def brute_prints(text):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    paragraph = lambda p: sha("".join(map(sha, brute_leaves(p))))
    root = sha("".join(sha("".join(paragraph(p) for p in s.split("\n"))) for s in text.split("\n\n")))
    return root, [sha(x)[: merkle.DIGITS] + chr(96 + len(x)) for x in brute_leaves(text)]


def test_likeness_of_fingerprints(spark, odd):
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdehimnorstu", k=rng.randrange(2, 10))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=n)) for n in (1, 3, 30, 90, 200, 4000)] + ["", "\n\n", "same line\n" * 400, None, "中文没有空格" * 60, "中文，没有。空格、" * 9]
    texts += ["x" + texts[4], texts[4][:300] + " put in " + texts[4][300:], "y" * 500, "a\n\nb c, d\ne", "a\n\nb c, d\n\ne"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in merkle.compared(docs).collect()}
    size = lambda c: sum(n * (ord(x[-1]) - 96) for x, n in c.items())
    like = lambda a, b: size(Counter(a) & Counter(b)) / max(size(Counter(a)), size(Counter(b)))
    for k, text in enumerate(texts):
        text, after = text or "", texts[(k + 1) % len(texts)] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        (root, mine), (edited_root, theirs), (_, other) = map(brute_prints, (text, edited, after))
        assert got[k].fingerprint == f"{root}:{''.join(mine)}" and got[k].edited_fingerprint == f"{edited_root}:{''.join(theirs)}"
        assert got[k].near_edited == (like(mine, theirs) if mine or theirs else text == edited)
        assert got[k].near_next == (like(mine, other) if mine or other else text == after)
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    prints = spark.createDataFrame([(got[4].fingerprint, got[k].fingerprint) for k in (12, 13)], "a string, b string").coalesce(1)
    near = [r[0] for r in prints.select(near_prints("a", "b")).collect()]
    assert min(near) > 0.95
    assert len(merkle.compared(odd).collect()) == len(ODD)


def near_prints(a, b):
    mine, theirs = merkle.entries_of(F.col(a)), merkle.entries_of(F.col(b))
    return merkle.likeness(merkle.numbered(mine), merkle.numbered(theirs), merkle.size_of(mine), merkle.size_of(theirs))


def test_likeness_does_not_depend_on_where_an_edit_is(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 900").orderBy("doc_id").limit(40).collect()]
    for n in (200, 400, 800):
        rows = []
        for text, other in zip(docs, docs[1:] + docs[:1], strict=True):
            q, text = n // 4, text[:n]
            rows.append((text, other[:q] + text[q:], text[: 3 * q // 2] + other[:q] + text[3 * q // 2 + q :], text[:-q] + other[:q]))
        df = spark.createDataFrame(rows, "a string, head string, middle string, tail string").coalesce(2)
        for c in ("a", "head", "middle", "tail"):
            df = merkle.shown(df, c, f"{c}_")
        near = [merkle.likeness(F.col("a_numbered"), F.col(f"{c}_numbered"), F.col("a_size"), F.col(f"{c}_size")) for c in ("head", "middle", "tail")]
        means = df.select(*(F.avg(x) for x in near)).first()
        assert max(means) - min(means) < 0.1 and 0.6 < min(means) and max(means) < 0.8, (n, means)


def random_texts(n, seed=1):
    rng = random.Random(seed)
    signs = [chr(c) for c in range(1, 256)] + list("  \n''sstredvmll01.,!") + ["<|endoftext|>", "中", "é", " ", "Σ", "ſ", "İ"]
    return ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(n)]


def test_token_counts(odd, empty):
    tokenizer, counter = Tokenizer.from_file(BYTES), token_counts.Counter(BYTES, token_counts.prove(BYTES))
    for t in random_texts(1500):
        assert counter.count(t) == len(tokenizer.encode(t, add_special_tokens=False).ids), t
    rows = token_counts.token_counts(odd, BYTES).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(tokenizer.encode(x[1] or "", add_special_tokens=False).ids) for x in ODD)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows) and token_counts.token_counts(empty, BYTES).count() == 0


def check_pieces(rows, docs, length):
    """Sequences are gapless and short enough, and the pieces of each document
    (doc_id, text; ids may repeat) are its ids, each once and in order."""
    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter()
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    for _, pieces in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for p in pieces:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= length
    ids = {doc_id: [] for doc_id, _ in docs}
    for doc_id, text in docs:
        ids[doc_id].append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    for doc_id, own in itertools.groupby(sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0)), key=lambda r: r.doc_id):
        own = list(own)
        left = Counter((p.doc_tokens, p.start, p.length, p.ids_crc32) for p in own)
        for whole in ids[doc_id]:
            at = 0
            while at < len(whole):
                step = next(k for k in left if left[k] and k[:2] == (len(whole), at) and zlib.crc32(whole[at : at + k[2]].tobytes()) == k[3])
                left[step] -= 1
                at += step[2]
            assert at == len(whole)
        assert not sum(left.values())


def test_packing(spark, odd, empty):
    tokenizer, encoder = Tokenizer.from_file(WORDS), packing.Encoder(WORDS, limit=50)
    for t in random_texts(1500, 2):
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    check_pieces(packing.pack(odd, WORDS, length=256, segment=2000).collect(), [x[:2] for x in ODD], 256)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, WORDS, segment=30_000).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()], packing.LENGTH)
    held = Counter()
    for r in rows:
        held[r.sequence_id] += r.length
    assert sum(4096 - n for n in held.values() if n & (n - 1)) < 0.03 * sum(held.values())
    assert packing.pack(empty, WORDS).count() == 0


def test_cuts_are_optimal():
    rng = random.Random(4)
    for _ in range(40):
        positions = sorted({0, *rng.sample(range(1, 60), 14), 60})
        if max(b - a for a, b in itertools.pairwise(positions)) > 16:
            continue
        positions = np.array(positions)
        price = np.array([rng.choice((0, 4, 64)) for _ in positions])
        pay = lambda a, b: packing.SEQUENCE_COST + (0 if (b - a) & (b - a - 1) == 0 else 16 - (b - a))
        best = {0: 0}
        for j, p in enumerate(positions[1:], 1):
            best[p] = min(best[q] + pay(q, p) for q in positions[:j] if p - q <= 16) + price[j]
        chain = packing.cuts(positions, price, 16, 1)
        assert sum(pay(a, b) + price[positions.tolist().index(b)] for a, b in itertools.pairwise(chain)) == best[60]


def test_chat(spark):
    rng = random.Random(1)
    for _ in range(3000):
        role = "".join(rng.choices(["\\", "#", ":", "user", "</turn>"], k=rng.randrange(4)))
        text = "".join(rng.choices(["\\", "#", "</turn>", "<", "\n", ": ", "a", "### ", "</turn>\n"], k=rng.randrange(9)))
        piece, start, length = chat.written(role, text)
        reader, cut = chat.Reader(), rng.randrange(len(piece))
        assert [*reader.feed(piece[:cut]), *reader.feed(piece[cut:] + piece)] == [(role, text)] * 2
        assert chat.plain(piece[start : start + length]) == text
    rows = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", None), (2, None, None, ""), (1, 2, "assistant", "c"), (1, 2, "assistant", "c"), (None, 0, "user", chat.PROBE)], "conv_id bigint, turn bigint, role string, text string").withColumn("prompt", F.lit("clash"))
    got = {r.conv_id: r for r in chat.digests(chat.formatted(chat.table_turns(rows))).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nc\nassistant\nc\n").hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (4, 3, hashlib.sha256(b"bcc").hexdigest()) and set(got) == {1, 2, None}
    assert chat.digests(chat.formatted(chat.table_turns(rows.limit(0)))).count() == 0


def test_chat_layouts(spark):
    records = [
        {"messages": [{"role": "human", "content": "q"}, {"role": "assistant", "content": "r"}], "id": 3}, {"instruction": "q", "output": "r"}, {"prompt": "q", "completion": "r"},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, {"foo": 1}, None,
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)], "id long, raw string")
    got = {}
    for r in chat.record_turns(df, "id", "raw").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert all(got[k] == [("user", "q"), ("assistant", "r")] for k in range(4)) and got[4] == got[5] == [(None, None)]
    with pytest.raises(ValueError):
        chat.table_turns(df)


def test_top_k(spark):
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=(400, 24)), 2)
    v[50:80] = v[0]
    rows = [(int(k), x.tolist()) for k, x in enumerate(v)] + [(None, [1.0]), (900, None), (901, [float("nan")] * 24), (902, [None] * 24), (500, [1e30] * 3), (501, [2e30] * 3), (502, [])]
    # Rows that share an id: 100 twice with another vector, 200 twice with the same one.
    shared = [(100, np.round(rng.normal(size=24), 2)), (200, v[200])]
    rows += [(i, x.tolist()) for i, x in shared]
    every = [*enumerate(v), *shared]
    e = [(i, np.floor(x * 1024).astype(int)) for i, x in every]
    want = []
    for k, (i, q) in enumerate(e):
        if i % 100 == 0:
            best = sorted((-int(q @ x), c) for j, (c, x) in enumerate(e) if j != k)[:10]
            want += [(i, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("rank", F.lit(0))
    got = [tuple(r) for r in topk.top_k(df, every=100).collect()]
    assert sorted(r for r in got if r[0] != 500) == sorted(want) and len(want) == 60
    assert [r[2:] for r in got if r[0] == 500] == [(501, topk.LONG)]
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0


def test_top_k_in_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(16)
    df = spark.createDataFrame([(int(k), x.tolist()) for k, x in enumerate(rng.normal(size=(300, 8)))], "vec_id bigint, embedding array<double>")
    whole = sorted(map(tuple, topk.top_k(df, every=10).collect()))
    monkeypatch.setattr(topk, "BLOCK", 64)
    assert sorted(map(tuple, topk.top_k(df, every=10).collect())) == whole and len(whole) == 300


def test_top_k_prunes(spark):
    """Candidates leave before all their dimensions are added up, in a chunk of a few thousand and in the ones after it."""
    rng = np.random.default_rng(26)
    v = rng.normal(size=(3000, 64)) * np.repeat([4, 1, 0.3, 0.1], 16)
    queries = [(int(k), v[k]) for k in range(0, 3000, 100)]
    searcher = topk.Searcher(queries, 11)
    searcher.feed(v, np.arange(3000))
    assert 0 < searcher.work < 0.5 * searcher.full
    before, full = searcher.work, searcher.full
    more = rng.normal(size=(3000, 64)) * np.repeat([4, 1, 0.3, 0.1], 16)
    searcher.feed(more, np.arange(3000, 6000))
    assert searcher.work - before < 0.5 * (searcher.full - full)
    e = np.floor(np.concatenate([v, more]) * 1024)
    for k, (i, _) in enumerate(queries):
        want = sorted((-int(e[i] @ x), c) for c, x in enumerate(e))[:11]
        assert [(s, c) for s, c, _ in searcher.best[k]] == want


def brute_mix(rows, repeats=3):
    """taken of each row (doc_id, text, source), in place: every piece in one sorted list."""
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    size = [len(re.findall(common.WORD, t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    own = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left = {}, set(names)
    while left:  # cap the sources that are above their cap, share the rest again
        level = (sum(own.values()) - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level >= repeats * own[s]}
        target |= {s: float(repeats * own[s]) for s in over} or {s: weight[s] * level for s in left}
        left = left - over if over else set()
    order = sorted(range(len(rows)), key=lambda k: (int(digest(f"{'' if rows[k][0] is None else rows[k][0]}:{digest(rows[k][1] or '')}")[:15], 16), rows[k][0] is not None, rows[k][0] or 0, size[k]))
    queue, at = [], dict.fromkeys(names, 0)
    for k in order:
        s = rows[k][2]
        for turn in range(repeats):
            for skipped in range(0, size[k], mixing.QUANTUM):
                begin, n = at[s] + turn * own[s] + skipped, min(mixing.QUANTUM, size[k] - skipped)
                queue.append(((begin + n) / target[s], names.index(s), begin, n, k))
        at[s] += size[k]
    taken, budget = [0] * len(rows), round(sum(target.values()))
    for _, _, _, n, k in sorted(queue):
        taken[k] += min(n, budget)
        budget -= min(n, budget)
    return taken, target


def test_mixing(spark, odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 3 * r.size for r in rows)
    want, _ = brute_mix([(r[0], r[1], r[3]) for r in ODD])
    assert sorted(r.taken for r in rows) == sorted(want)
    rng = random.Random(7)
    made = [(k, "w " * rng.randrange(60), rng.choice("aaaaaabcd")) for k in range(500)]
    made += [(900, "w " * 9000, "b"), (901, "v " * 30_000, "a"), (902, None, "c"), (7, "another text", None), (None, "x y z", None)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, source string")
    want, target = brute_mix(made)
    got = mixing.mix(docs).collect()
    key = lambda doc_id, size: (doc_id is not None, doc_id or 0, size)
    sizes = [len((t or "").split()) for _, t, _ in made]
    assert sorted((*key(r.doc_id, r.size), r.taken) for r in got) == sorted((*key(m[0], n), t) for m, n, t in zip(made, sizes, want, strict=True))
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert all(abs(sum(r.taken for r in rs) - rs[0].target) <= mixing.QUANTUM for rs in by.values())
    assert {s: rs[0].target for s, rs in by.items()} == pytest.approx(target)
    assert sum(r.taken for r in got) == sum(sizes)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


@pytest.mark.parametrize("module, label, bad", [(toxicity, "toxic", "moron"), (quality, "quality", "x%%% y&&& z***")])
def test_classifiers(spark, odd, empty, module, label, bad):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    docs = [(k, " ".join(rng.choices(words, k=40)) + (f" {bad} " + rng.choice(words) if k % 5 == 0 else "")) for k in range(600)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    one = 1 if label == "toxic" else 0
    labels = spark.createDataFrame([(k, one if k % 5 == 0 else 1 - one) for k in range(600)] + [(601, None), (None, 1)], f"doc_id bigint, {label} int")
    model = module.train(df, labels)
    rows = [r for r in module.score(df, model).collect() if r.held_out]
    assert np.mean([r.predicted == (one if r.doc_id % 5 == 0 else 1 - one) for r in rows]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % module.FOLDS == module.HELD_OUT) for r in rows)
    again = {r.doc_id: r.score for r in module.score(df, module.train(df, labels)).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)
    assert all(0 <= r.score <= 1 for r in module.score(odd, model).collect()) and module.score(empty, model).count() == 0
    assert module.score(df, module.train(df, labels.limit(0))).first().score == 0.5


def learnable(rng, n, size):
    """Random feature sets of two classes that tell themselves by a few features."""
    examples, y = [], []
    for _ in range(n):
        one = rng.random() < 0.4
        f = set(rng.choices(range(size), k=rng.randrange(1, 25))) | ({rng.randrange(6)} if one else {6 + rng.randrange(6)})
        examples.append(np.array(sorted(f), np.uint32))
        y.append(int(one))
    return examples, np.array(y)


def parted(seed, n):
    order = np.random.default_rng(seed)
    place = order.permutation(n)
    return order, place[: n // 5], place[n // 5 :]


def test_ftrl_against_a_plain_loop():
    examples, y = learnable(random.Random(31), 260, 64)
    at, weights, bias = toxicity.fit(examples, y, 6)
    order, apart, learnt = parted(5, len(y))
    z, n, b, bn = Counter(), Counter(), 0.0, 0.0

    def weight(f):
        if abs(z[f]) <= toxicity.L1:
            return 0.0
        return -(z[f] - math.copysign(toxicity.L1, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for k in order.permutation(learnt):
            w = {f: weight(f) for f in examples[k].tolist()}
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - int(y[k])
            for f, x in w.items():
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * x
                n[f] += g * g
            bn += g * g
            b -= toxicity.ALPHA / (toxicity.BETA + math.sqrt(bn)) * g
    w = {f: x for f in range(64) if (x := weight(f))}
    slope, offset = features.logistic(np.array([sum(w.get(f, 0) for f in examples[k].tolist()) + b for k in apart]), y[apart])
    assert at.tolist() == sorted(w) and 0 < len(w) < 64
    assert weights.tolist() == pytest.approx([w[f] * slope for f in sorted(w)]) and bias == pytest.approx(b * slope + offset)


def test_dual_coordinate_descent_against_a_plain_loop():
    examples, y = learnable(random.Random(32), 260, 64)
    got, got_bias = quality.fit(examples, y, 6)
    order, apart, learnt = parted(11, len(y))
    rows = {k: set(examples[k].tolist()) for k in range(len(y))}
    count = [[quality.SMOOTH + sum(f in rows[k] and y[k] == c for k in learnt) for f in range(64)] for c in (0, 1)]
    ratio = [math.log(count[1][f] / sum(count[1])) - math.log(count[0][f] / sum(count[0])) for f in range(64)]
    ratio = [0.0 if count[0][f] + count[1][f] < quality.MIN_ROWS + 2 * quality.SMOOTH else r for f, r in enumerate(ratio)]
    share = [sum(y[k] == c for k in learnt) / len(learnt) for c in (0, 1)]
    w, b, dual = [0.0] * 64, 0.0, Counter()
    for _ in range(quality.PASSES):
        for k in order.permutation(learnt):
            sign = 1 if y[k] else -1
            slope = sign * (sum(w[f] * ratio[f] for f in rows[k]) + b) - 1
            new = min(max(dual[k] - slope / (sum(ratio[f] ** 2 for f in rows[k]) + 1), 0.0), quality.COST * 0.5 / share[y[k]])
            step, dual[k] = (new - dual[k]) * sign, new
            b += step
            for f in rows[k]:
                w[f] += step * ratio[f]
    whole = [a * r for a, r in zip(w, ratio, strict=True)]
    a, c = features.logistic(np.array([sum(whole[f] for f in rows[k]) + b for k in apart]), y[apart])
    assert got.tolist() == pytest.approx([x * a for x in whole], rel=1e-4, abs=1e-6) and got_bias == pytest.approx(b * a + c, rel=1e-4)
    assert any(whole)


BIG = (1 << 53) + 1


@pytest.fixture(scope="session")
def wide(spark):
    """A null id beside ids that doubles can't hold, and extra columns of kinds that pandas can't."""
    import datetime

    rows = [(None, "no id at all"), (BIG, "Released under the MIT License."), (BIG + 2, "tie tie tie"), (3, None), (BIG + 4, "ca fe " * 30), (BIG, "Released under the MIT License.")]
    far = datetime.datetime(2500, 1, 1)
    docs = [(i, t, "en", "a", 1, far, [1, None], {"k": "v"}, None if i is None else i, "x") for i, t in rows]
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, at timestamp, list array<int>, pairs map<string,string>, other bigint, score string").coalesce(1)


def test_ids_stay_exact_beside_nulls(spark, wide):
    want = sorted((r.doc_id for r in wide.collect()), key=str)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id bigint, quality int, toxic int")
    models = [(m, m.train(wide, labels)) for m in (quality, toxicity)]
    tables = [
        simhash.near_duplicates(wide), licenses.scan(wide), merkle.compared(wide), token_counts.token_counts(wide, BYTES),
        packing.pack(wide, WORDS).where("start = 0"), mixing.mix(wide), *(m.score(wide, model) for m, model in models),
    ]
    for t in tables:
        assert sorted((r.doc_id for r in t.collect()), key=str) == want, t.columns
    turns = wide.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")
    assert {r.conv_id for r in chat.digests(chat.formatted(chat.table_turns(turns))).collect()} == set(want)
    records = wide.select("doc_id", F.lit('{"prompt": "p", "completion": "c"}').alias("raw"))
    assert {r.conv_id for r in chat.record_turns(records, "doc_id", "raw").collect()} == set(want)


def test_stages_leave_extra_columns_alone(spark, wide):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id bigint, quality int, toxic int")
    rows = sorted(map(str, wide.collect()))
    for out in (toxicity.without_toxic(wide, labels), quality.good(wide, labels), features.kept(wide, len, lambda n: True)):
        assert out.schema == wide.schema and sorted(map(str, out.collect())) == rows
    once = sorted(set(rows))
    assert sorted(map(str, simhash.deduplicated(wide).collect())) == once
    mixed = mixing.mixed_documents(wide)
    assert mixed.schema == wide.schema and set(map(str, mixed.collect())) <= set(rows)
    for empty in (toxicity.without_toxic(wide.limit(0), labels), simhash.deduplicated(wide.limit(0)), quality.good(wide.limit(0), labels)):
        assert empty.count() == 0 and empty.schema == wide.schema


def test_quality_without_a_sample_keeps_all(spark):
    df = spark.createDataFrame([(k, f"text of row {k}") for k in range(50)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    one_class = spark.createDataFrame([(k, 1) for k in range(50)], none.schema)
    few = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], none.schema)
    for labels in (none, one_class, few):
        assert quality.good(df, labels).count() == 50
