"""License scans by an exact set-similarity join (operator 2), in DataFrame functions only.

Base labels come from phrases whose words stand consecutively. The method's own
labels come from templates: a text block matches a template if it holds at least
THRESHOLD of the template's distinct words (all of them, if there are fewer than
SHORT). Blocks are all runs of consecutive words, a quarter longer than the
template, whatever lines or paragraphs they cross: notices may be wrapped,
indented or commented out.

The join is exact and filtered. All template words are ordered by the number of
documents that hold them, rarest first. A block that holds `need` of a template's
words holds one of its first size - need + 1 words (prefix filter), has `need`
template words (length filter), and after the first common word of the order the
words left on both sides must still suffice (positional filter). What holds for a
block holds for its document, so the filters are put to a document's set of
template words first; in the few documents that pass, only runs that begin with
a template word, reach `need` of them and hold a prefix word are intersected.
Templates of one family share most words; what tells them apart is stated with
them (words that a block must hold, and words that end it), so a notice of a stricter member
is not taken for a more liberal one. The
templates are a fixed list, so their side is a set of constants in the plan: no
block is shuffled, no pair is built outside its own row, and repeated rows or a
hot text cost no more than others.

Texts are read and cut into words once. That pass writes, for every row, the base
scan's places and the template words it holds, and the words themselves only
where some template can be contained; the frequencies and the join read this
table.

Words are A-Z lower-cased runs of letters, digits and code points above 127.
Null and empty texts have no words and no labels, with empty strings for labels
and score 0; ties of frequency are ordered by the word; an empty table gives an
empty result; extra columns are left out.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, literal, stored, table

THRESHOLD, SHORT = 0.8, 10
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The one letter beyond ASCII that lower() would make an ASCII letter, and another letter to stand for it.
KELVIN, OTHER = "\u212a", "\u0138"
#: Fixed values of the base scan.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Labels and texts of the templates: the usual notices of public licenses. A block of a template holds
#: all of its third element's words and ends before its fourth's, which tell the members of a family apart.
_LESSER = ("lesser", "library", "affero")
_NAMES = {"nc": "NonCommercial", "nd": "NoDerivatives", "sa": "ShareAlike"}
_SHORT = {"nc": ("nc", "noncommercial", "commercial"), "nd": ("nd", "noderivatives", "noderivs", "derivatives"), "sa": ("sa", "sharealike", "share")}


def _creative_commons() -> list[tuple]:
    """Long and short notices of each combination of conditions."""
    out = []
    for terms in ((), ("sa",), ("nc",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        label, name = "-".join(("cc-by", *terms)), "-".join(("Attribution", *(_NAMES[t] for t in terms)))
        others = tuple(w for t, ws in _SHORT.items() if t not in terms for w in ws)
        told = ("attribution", *(_NAMES[t].lower() for t in terms))
        for version in ("4.0 International", "3.0 Unported"):
            out.append((label, f"This work is licensed under a Creative Commons {name} {version} License.", told, others))
        out.append((label, f"Creative Commons {name} 4.0 International License", told, others))
        for version in ("4.0", "3.0"):
            out.append((label, f"{'-'.join(('CC BY', *terms)).upper()} {version}", (), others))
    return out


def _gnu() -> list[tuple]:
    """The notices of the general public license and of its lesser and network kinds."""
    out = []
    for label, kind in (("gpl", ""), ("lgpl", "Lesser "), ("agpl", "Affero ")):
        told = ("general", *filter(None, [kind.strip().lower()]))
        others = tuple(w for w in _LESSER if w not in told)
        name = f"GNU {kind}General Public License"
        out += [
            (label, f"This work is licensed under the {name}, version 3.", told, others),
            (label, f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation", told, others),
            (label, f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.", told, others),
            (label, f"You should have received a copy of the {name} along with this program.", told, others),
        ]
    return out + [("lgpl", "GNU Lesser General Public License", (), ()), ("agpl", "GNU Affero General Public License", (), ())]


TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ("deal",), ("organization",)),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ("substantial",), ()),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", ("noninfringement",), ("title",)),
    ("mit", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ("claim", "dealings"), ()),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache",), ()),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ("basis",), ()),
    ("apache", "See the License for the specific language governing permissions and limitations under the License.", ("governing", "limitations"), ()),
    *_gnu(),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", (), ("nd", "sa")),
    *_creative_commons(),
    ("cc0", "This work is dedicated to the public domain under CC0 1.0 Universal.", (), ()),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("waived",), ()),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution",), ()),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ("retain",), ()),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ("reproduce",), ()),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("endorse",), ()),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.", ("disclaimed",), ()),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("fee",), ()),
    ("isc", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", ("disclaims", "regard"), ()),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ("held",), ()),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla",), ()),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at", ("mpl",), ()),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", ("eclipse",), ()),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered",), ()),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("anyone", "compile"), ()),
    ("bsl", "Distributed under the Boost Software License, Version 1.0.", ("boost",), ()),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("organization",), ()),
    ("odbl", "This database is made available under the Open Database License", ("database",), ()),
)


class Template:
    """A template's distinct words, how many of them a block needs, which it must
    hold and which end it, and the block's length in words."""

    def __init__(self, label: str, text: str, must: tuple, without: tuple, threshold: float):
        found = re.findall(WORDS, text.lower())
        self.label, self.words = label, sorted(set(found))
        self.need = len(self.words) if len(self.words) < SHORT else math.ceil(threshold * len(self.words) - 1e-9)
        self.must, self.without = sorted(must), sorted(without)
        self.span = len(found) + len(found) // 4


def template_list(threshold: float = THRESHOLD) -> list[Template]:
    return [Template(*t, threshold) for t in TEMPLATES]


def words(text: Column) -> Column:
    """The words of a text in order (split is several times faster than extracting)."""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit(KELVIN), F.lit(OTHER))), BETWEEN), "")


def phrase_starts(tokens: Column, phrase: str) -> Column:
    """Places (from 0) where the phrase's words stand consecutively; looked for only if all its words occur."""
    parts = phrase.split()
    there, here = F.lit(True), F.lit(True)
    for w in parts:
        there = there & F.array_contains(tokens, w)

    def at(i: Column) -> Column:
        ok = here
        for k, w in reversed(list(enumerate(parts))):
            ok = (F.get(tokens, i + k) == w) & ok
        return ok

    none = F.array().cast("array<int>")
    return F.when(there, F.filter(F.sequence(F.lit(0), F.size(tokens) - len(parts)), at)).otherwise(none)


def constants(templates: list[Template], rank: dict[str, int] | None = None) -> Column:
    """The templates as one folded constant, their words in the order of `rank`:
    the plan is as short for many as for one."""
    rows = []
    for t in templates:
        own = sorted(t.words, key=rank.__getitem__) if rank else t.words
        rows.append({"label": t.label, "own": own, "prefix": own[: len(own) - t.need + 1], "need": t.need, "span": t.span, "must": t.must, "without": t.without})
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<label:string,own:array<string>,prefix:array<string>,need:int,span:int,must:array<string>,without:array<string>>>")


def holds(words: Column, some: Column) -> Column:
    """Whether all of `some` are among the words."""
    return F.size(F.array_intersect(some, words)) == F.size(some)


def scanned(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """doc_id, n_words, the starts of each phrase, held (the template words in
    the text) and words (null where no template's `need` is held), written once."""
    vocabulary = literal(sorted({w for t in templates for w in t.words}), "string")
    rows = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("words"))
    rows = rows.select("*", F.array_intersect(vocabulary, F.col("words")).alias("held"), *(phrase_starts(F.col("words"), p).alias(name) for p, name in PHRASES))
    fits = F.exists(constants(templates), lambda t: holds(F.col("held"), t["must"]) & (F.size(F.array_intersect(t["own"], F.col("held"))) >= t["need"]))
    names = [name for _, name in PHRASES]
    return stored(rows.select("doc_id", F.size("words").cast("long").alias("n_words"), *names, "held", F.when(fits, F.col("words")).alias("words")))


def word_order(rows: DataFrame, templates: list[Template]) -> list[str]:
    """The templates' words by the number of documents that hold them, rarest
    first (one row a template word comes back, a fixed number)."""
    counts = {r["word"]: r["n"] for r in rows.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted({w for t in templates for w in t.words}, key=lambda w: (counts.get(w, 0), w))


def passes(t: Column, held: Column) -> Column:
    """Whether a set of template words (in the global order) passes the template's prefix, length and positional filters."""
    first = F.get(F.array_intersect(t["prefix"], held), F.lit(0))
    # Words left from the first common one on, in the template and in the set.
    left = F.least(F.size(t["own"]) + 1 - F.array_position(t["own"], first), F.size(held) + 1 - F.array_position(held, first))
    return (F.size(held) >= t["need"]) & F.arrays_overlap(t["prefix"], held) & (left >= t["need"]) & holds(held, t["must"])


def best_share(t: Column, tokens: Column) -> Column:
    """The largest share of the template's words in `span` consecutive words (fewer
    before one of `without`) that hold all of `must`, null if none reaches `need`."""

    def places(words: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.array_contains(words, F.get(tokens, i)))

    def common(hits: Column, barred: Column) -> Column:
        # A best run may as well begin with one of the template's words and reach `need` of them.
        close = F.filter(F.sequence(F.lit(0), F.size(hits) - t["need"]), lambda k: F.get(hits, k + (t["need"] - 1)) - F.get(hits, k) < t["span"])

        def run(k: Column) -> Column:
            start = F.get(hits, k)
            end = F.coalesce(F.array_min(F.filter(barred, lambda p: p >= start)), F.size(tokens))
            return F.slice(tokens, start + 1, F.least(t["span"], end - start))

        runs = F.filter(F.transform(close, run), lambda r: F.arrays_overlap(t["prefix"], r) & holds(r, t["must"]))
        return F.array_max(F.transform(runs, lambda r: F.size(F.array_intersect(t["own"], r))))

    # The places are found once, as a list of one pair of lists.
    lists = F.array(F.struct(places(t["own"]).alias("hits"), places(t["without"]).alias("barred")))
    most = F.get(F.transform(lists, lambda x: F.when(F.size(x["hits"]) >= t["need"], common(x["hits"], x["barred"]))), F.lit(0))
    return F.when(most >= t["need"], most / F.size(t["own"]))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs (doc_id, text): the base scan's columns, labels and score."""
    templates = template_list(threshold)
    rows = scanned(docs, templates)
    order = word_order(rows, templates)
    known = constants(templates, {w: k for k, w in enumerate(order)})
    rows = rows.withColumn("starts", F.concat(*(F.col(name) for _, name in PHRASES)))
    rows = rows.withColumn("held", F.when(F.col("words").isNotNull(), F.array_intersect(literal(order, "string"), F.col("held"))))
    found = F.transform(known, lambda t: F.struct(t["label"].alias("label"), F.when(passes(t, F.col("held")), best_share(t, F.col("words"))).alias("share")))
    rows = rows.withColumn("found", F.when(F.col("words").isNotNull(), F.filter(found, lambda x: x["share"].isNotNull())))
    base = F.array(*(F.when(F.size(name) > 0, name) for _, name in PHRASES))
    more = F.coalesce(F.col("found")["label"], F.array().cast("array<string>"))
    n = F.size("starts")

    def joined(names: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(names))), ",")

    return rows.select(
        "doc_id",
        "n_words",
        n.cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        F.coalesce(F.greatest(F.when(n > 0, 1.0), F.array_max(F.col("found")["share"])), F.lit(0.0)).alias("score"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    rows = ",\n    ".join(f"('{t.label}', {quoted(t.words)}, {t.need}, {t.span}, {quoted(t.must)}::VARCHAR[], {quoted(t.without)}::VARCHAR[])" for t in template_list())
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (
  SELECT rid, doc_id, w,
    list_filter(range(0, len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS a,
    list_filter(range(0, len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS b,
    list_filter(range(0, len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS c FROM d
), templates(label, ws, need, span, must, wo) AS (
  VALUES {rows}
), runs AS (
  SELECT rid, label, ws, need, list_max(list_transform(list_transform(range(1, len(w) + 1), lambda i: w[i:i + coalesce(
    list_min(list_filter(range(0, least(span, len(w) - i + 1)), lambda j: list_contains(wo, w[i + j]))), span) - 1]),
    lambda b: CASE WHEN list_has_all(b, must) THEN len(list_intersect(ws, list_distinct(b))) ELSE 0 END)) AS common
  FROM d JOIN templates ON list_has_all(w, must) AND len(list_intersect(ws, list_distinct(w))) >= need
), more AS (
  SELECT rid, list(label) AS labels, max(common / len(ws)) AS share FROM runs WHERE common >= need GROUP BY rid
), base AS (
  SELECT doc_id, w, a || b || c AS starts,
    list_filter([CASE WHEN len(a) > 0 THEN 'mit' END, CASE WHEN len(b) > 0 THEN 'apache' END, CASE WHEN len(c) > 0 THEN 'gpl' END], lambda x: x IS NOT NULL) AS base,
    coalesce(m.labels, []) AS labels, m.share FROM s LEFT JOIN more m ON m.rid = s.rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || labels)), ',') AS labels,
  CASE WHEN len(starts) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM base
"""


OP2_SQL = _sql()
