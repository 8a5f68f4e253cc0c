"""Segmentation of CJK text: paths and tags against all possible ones, learnt words against definitions."""

import itertools
import math
import random
from collections import Counter

from loomspark.functions.segment import Model, nats, segment, tagger
from loomspark.operators import dictionary, segmentation

#: Words of the keyword corpus.
WORDS = ("电池", "回收", "供应链", "风险", "治理", "动力电池", "工艺", "绿色", "制造", "学术", "写作", "引用", "规范", "透明度", "生成式", "辅助")


def all_cuts(run):
    for k in range(len(run)):
        for at in itertools.combinations(range(1, len(run)), k):
            at = (0, *at, len(run))
            yield [run[a:b] for a, b in itertools.pairwise(at)]


def test_cheapest_path_against_all_paths():
    rng = random.Random(1)
    for _ in range(200):
        run = "".join(rng.choice("甲乙丙丁") for _ in range(rng.randrange(1, 9)))
        words = {"".join(rng.choice("甲乙丙丁") for _ in range(rng.randrange(2, 5))): rng.randrange(1, 9) for _ in range(8)}
        model = Model.learnt(words, dict(zip("甲乙丙", (9, 5, 5), strict=True)))
        cost = lambda w: model.costs.get(w, model.unseen if len(w) == 1 else math.inf)
        options = [(sum(map(cost, c)), len(c), tuple(-len(w) for w in c)) for c in all_cuts(run)]
        assert model.path(run) == min(options)


def test_cheapest_tags_against_all_tags():
    rng = random.Random(2)
    allowed = {"B": "EM", "M": "EM", "E": "BS", "S": "BS"}
    for _ in range(60):
        words = {"".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randrange(2, 5))): rng.randrange(1, 9) for _ in range(6)}
        tags = tagger(words, {c: rng.randrange(1, 40) for c in "甲乙丙丁"})
        run = "".join(rng.choice("甲乙丙丁戊己") for _ in range(rng.randrange(2, 7)))
        best = []
        for t in itertools.product("BEMS", repeat=len(run)):
            if t[0] in "BS" and t[-1] in "ES" and all(b in allowed[a] for a, b in itertools.pairwise(t)):
                cost = tags.start[t[0]] + sum(tags.after[p] for p in itertools.pairwise(t)) + sum(tags.shown[x].get(c, tags.unseen[x]) for x, c in zip(t, run, strict=True))
                best.append((cost, "".join(t)))
        want, out = min(best)[1], ""
        for c, t in zip(run, want, strict=True):
            out += c + (" " if t in "ES" else "")
        assert tags.cut(run) == out.split()


def test_given_words_stay_whole():
    lexicon = {"供应链", "供应", "管理"}
    assert segment("供应链管理", lexicon) == ["供应链", "管理"]
    assert segment("甲供应", lexicon) == ["甲", "供应"]
    assert segment("中文分词供应链系统测试了", lexicon) == ["中文", "分词", "供应链", "系统", "测试", "了"]
    assert segment("中文分", ()) == ["中文", "分"]
    learnt = Model.learnt({"供应": 50, "链管": 40}, {"供": 50, "应": 50, "链": 40, "管": 40, "理": 3})
    assert learnt.cut("供应链管理") == ["供应", "链管", "理"]
    assert learnt.cut("供应链乙") == ["供应", "链乙"]
    assert learnt.with_words(["供应链"]).cut("供应链乙") == ["供应链", "乙"]


def brute_words(texts, least=2, cohesion=1.5, freedom=0.6):
    count, sides = Counter(), {}
    for t in texts:
        for i in range(len(t)):
            for k in range(1, min(4, len(t) - i) + 1):
                g = t[i : i + k]
                count[g] += 1
                for side, c in (("l", t[i - 1] if i else None), ("r", t[i + k] if i + k < len(t) else None)):
                    sides.setdefault((g, side), Counter())[c] += 1
    total, out = sum(n for g, n in count.items() if len(g) == 1), {}
    for g, n in count.items():
        if len(g) < 2 or n < least:
            continue
        free = min(math.log(n) - sum(c * math.log(c) for x, c in sides[g, s].items() if x) / n for s in "lr")
        tied = min(math.log(n * total / (count[g[:k]] * count[g[k:]])) for k in range(1, len(g)))
        if free >= freedom and tied >= cohesion:
            out[g] = (n, round(tied, 4), round(free, 4))
    return out


def sentences(n, seed=3):
    rng = random.Random(seed)
    return [[rng.choice(WORDS) for _ in range(rng.randrange(2, 9))] for _ in range(n)]


def test_learnt_words_against_definitions(spark):
    texts = ["".join(s) for s in sentences(60)]
    df = spark.createDataFrame([(k, f"x {t[:5]}, {t[5:]} Ab") for k, t in enumerate(texts)], "doc_id bigint, t string")
    stats = segmentation.gram_stats(segmentation.run_counts(df, "t"))
    got = {r.word: (r.n, round(r.cohesion, 4), round(r.freedom, 4)) for r in segmentation.words_of(stats).collect()}
    assert got == brute_words([p for t in texts for p in (t[:5], t[5:]) if p])


def test_known_words_come_out_whole_without_a_lexicon(spark):
    said = sentences(300)
    df = spark.createDataFrame([(k, ["ab", "".join(s), "中"] if k % 2 else ["".join(s)]) for k, s in enumerate(said)] + [(300, []), (301, None)], "doc_id bigint, tokens array<string>")
    rows = {r.doc_id: r.tokens for r in segmentation.segmented(df, "tokens").collect()}
    assert rows[300] == [] and rows[301] is None
    found = Counter(w for k in range(300) for w in rows[k])
    assert set(WORDS) - {"动力电池"} <= set(found)
    # Of the words said, nearly all come out as they are (动力电池 may be cut at 电池).
    right = total = 0
    for k, s in enumerate(said):
        cut = [w for w in rows[k] if w not in ("ab", "中")]
        assert "".join(cut) == "".join(s)
        borders = lambda ws: set(itertools.accumulate(map(len, ws)))
        at = lambda ws: set(zip([0, *itertools.accumulate(map(len, ws))], itertools.accumulate(map(len, ws))))  # noqa: B905, E731
        right += len(at(cut) & at([p for w in s for p in (("动力", "电池") if w == "动力电池" and "动力电池" not in cut else (w,))]))
        total += len(s)
    assert right / total > 0.95


def test_a_large_given_lexicon_is_joined(spark):
    said = sentences(40, 5)
    df = spark.createDataFrame([(k, ["".join(s), "ab", "链链"]) for k, s in enumerate(said)] + [(90, []), (91, None), (92, ["ab"])], "doc_id bigint, tokens array<string>")
    pair = "".join(said[0][:2])
    entries = dictionary.entries(spark, [("custom_lexicon", w, None) for w in (pair, "供应链", "规 范", "电池")] + [("custom_lexicon", "风险", None, False), ("custom_lexicon", "ab", "链链链")])
    few = sorted(map(str, segmentation.segmented(df, "tokens", entries).collect()))
    many = sorted(map(str, segmentation.segmented(df, "tokens", entries, most_given=2).collect()))
    assert few == many and f"'{pair}'" in "".join(few)


def test_a_corpus_without_cjk_is_left_alone(spark):
    df = spark.createDataFrame([(1, ["ab"]), (2, None)], "doc_id bigint, tokens array<string>")
    assert segmentation.segmented(df, "tokens") is df
    assert nats(1.0) == 0


def test_grams_are_counted_over_windows(monkeypatch):
    # Windows end inside runs, and more letters than fit into a number halve them.
    monkeypatch.setattr(segmentation, "WINDOW", 7)
    runs, times = ["".join(chr(0x4E00 + (7 * k + s) % 23) for k in range(23 + s)) for s in range(5)], [1, 3, 1, 2, 5]
    want = Counter()
    for run, n in zip(runs, times, strict=True):
        for k in range(1, 6):
            for i in range(len(run) - k + 1):
                want[run[i : i + k]] += n
    for longest in (5, 15):
        got = Counter()
        for found, n in segmentation.counted_grams(runs, times, longest):
            for g, m in zip(found.tolist(), n.tolist(), strict=True):
                got[g] += m
        assert {g: n for g, n in got.items() if len(g) <= 5} == want


def test_long_stretches_are_tagged_in_proportion():
    # Paths are traced back instead of carried along as strings.
    model = Model.learnt({"ab": 3, "cde": 2}, dict.fromkeys("abcdefgh", 50))
    run = "".join(random.Random(3).choices("abcdefgh", k=200_000))
    assert "".join(model.cut(run)) == run
