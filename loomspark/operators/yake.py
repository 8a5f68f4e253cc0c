"""Unsupervised keywords of single documents by term features (the published YAKE measures).

A document's terms are weighed by casing, position, frequency, relatedness to
context and spread over sentences; candidates are n-grams that neither begin nor
end with a stopword; similar candidates give way to better ones. One document is
one unit of work, so rows are handled in Arrow batches without a shuffle.
"""

from __future__ import annotations

import heapq
import math
import re
import statistics
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
PIECE = re.compile(r"[^\W_]+(?:[_'-][^\W_]+)*|[^\w\s]")


def extract(text: str, top: int, stopwords: frozenset[str], width: int = 3, window: int = 2, similar: float = 0.85) -> list[tuple[str, float]]:
    """(candidate, raw score), the smaller the better."""
    sentences = [PIECE.findall(s) for s in SENTENCE.split(text) if s.strip()]
    count, capital, acronym = Counter(), Counter(), Counter()
    places, before, after = defaultdict(list), defaultdict(Counter), defaultdict(Counter)
    for k, words in enumerate(sentences):
        terms = [w.lower() if w[0].isalnum() else None for w in words]
        for i, (word, term) in enumerate(zip(words, terms, strict=True)):
            if term is None:
                continue
            count[term] += 1
            places[term].append(k)
            acronym[term] += word.isupper() and len(word) > 1
            capital[term] += word[0].isupper() and i > 0
            for j in range(i - 1, max(-1, i - 1 - window), -1):
                if terms[j] is None:
                    break
                before[term][terms[j]] += 1
                after[terms[j]][term] += 1
    content = [n for t, n in count.items() if t not in stopwords]
    if not content:
        return []
    mean, deviation, most = statistics.fmean(content), statistics.pstdev(content), max(count.values())
    weight = {}
    for t, n in count.items():
        casing = max(acronym[t], capital[t]) / (1 + math.log(n))
        position = math.log(math.log(3 + statistics.median(places[t])))
        frequency = n / (mean + deviation)
        spread = len(set(places[t])) / len(sentences)
        sides = [len(c) / sum(c.values()) if c else 0.0 for c in (before[t], after[t])]
        related = 1 + sum(sides) * n / most
        weight[t] = related * position / (casing + frequency / related + spread / related)
    seen: Counter = Counter()
    for words in sentences:
        terms = [w.lower() if w[0].isalnum() else None for w in words]
        for i in range(len(terms)):
            for j in range(i + 1, min(len(terms), i + width) + 1):
                gram = terms[i:j]
                if None in gram:
                    break
                if gram[0] not in stopwords and gram[-1] not in stopwords and not any(g.isdigit() for g in gram) and len(gram[0]) > 1:
                    seen[tuple(gram)] += 1
    scored = []
    for gram, n in seen.items():
        product = total = 0.0
        product = 1.0
        for g in gram:
            if g in stopwords:
                continue
            product *= weight[g]
            total += weight[g]
        scored.append((product / (n * (1 + total)), " ".join(gram)))
    out: list[tuple[str, float]] = []
    chosen: list[SequenceMatcher] = []  # keep what they know about their second text

    def alike(matcher: SequenceMatcher, gram: str) -> bool:
        matcher.set_seq1(gram)
        # Two upper bounds come before the ratio itself.
        return matcher.real_quick_ratio() > similar and matcher.quick_ratio() > similar and matcher.ratio() > similar

    heapq.heapify(scored)
    while scored:
        score, gram = heapq.heappop(scored)
        if not any(alike(m, gram) for m in chosen):
            out.append((gram, score))
            chosen.append(SequenceMatcher(None, "", gram))
            if len(out) >= top:
                break
    return out


def document_keywords(corpus: DataFrame, top: int = 10) -> DataFrame:
    """doc_id, keyword, score, rank of each document's best candidates."""
    words = frozenset(w.lower() for w in StopWordsRemover.loadDefaultStopWords("english"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["doc_id"], b["text"], strict=True):
                best = [(g, round(1 / (1 + max(s, 0.0)), 6)) for g, s in extract(text or "", 3 * top, words)]
                rows += [(key, g, s, k + 1) for k, (g, s) in enumerate(best[:top])]
            yield pd.DataFrame(rows, columns=["doc_id", "keyword", "score", "rank"])

    kind = corpus.schema["doc_id"].dataType.simpleString()
    have = [F.col("title")] if "title" in corpus.columns else []
    text = F.concat_ws("\n", *have, F.array_join("filtered_tokens", " "), *([F.col("keyword_field")] if "keyword_field" in corpus.columns else []))
    return corpus.select("doc_id", text.alias("text")).mapInPandas(run, f"doc_id {kind}, keyword string, score double, rank int")
