"""Text functions: Column in, Column out, all inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and character tables of the text rules.
HTML = "<[^>]+>"
URL = r"https?://\S+|www\.\S+"
EMAIL = r"(?U)\b[\w.+-]+@[\w.-]+\.\w+\b"
PHONE = r"(?U)\b(?:\+?\d[\d -]{7,}\d)\b"
ASTRAL = r"[\x{10000}-\x{10ffff}]"
NUMBER = r"(?U)\d+(?:\.\d+)?"
TIME = r"(?U)\b(?:\d{4}[-/年.]\d{1,2}[-/月.]\d{1,2}日?|\d{1,2}[:：]\d{2}(?::\d{2})?)\b"
CJK = "一-鿿"
TOKEN = f"[{CJK}]+|[A-Za-z0-9_]+(?:[-/][A-Za-z0-9_]+)*"
TRADITIONAL = "體學術寫作變為與關時間聯數據網頁規範標準詞彙處理機構題門類檢測續壓縮後臺專利雲庫價"
SIMPLIFIED = "体学术写作变为与关时间联数据网页规范标准词汇处理机构题门类检测续压缩后台专利云库价"
FULL = "　" + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF = " " + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))

PUNCTUATION = "，、；：。！？!?,.;:"

CLEANING = {
    "strip_html": True, "strip_urls": True, "strip_email": False, "strip_phone": False, "remove_emoji": False, "full_half_width_normalize": True,
    "lowercase_english": True, "normalize_punctuation": True, "normalize_whitespace": True, "remove_special_chars": False,
}


def squeezed(c: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


STEPS = {
    "strip_html": lambda c: F.regexp_replace(c, HTML, " "),
    "strip_urls": lambda c: F.regexp_replace(c, URL, " "),
    "strip_email": lambda c: F.regexp_replace(c, EMAIL, " "),
    "strip_phone": lambda c: F.regexp_replace(c, PHONE, " "),
    "remove_emoji": lambda c: F.regexp_replace(c, ASTRAL, ""),
    "full_half_width_normalize": lambda c: F.translate(c, FULL, HALF),
    "lowercase_english": F.lower,
    "normalize_punctuation": lambda c: F.translate(c, PUNCTUATION, " " * len(PUNCTUATION)),
    "normalize_whitespace": squeezed,
    "remove_special_chars": lambda c: squeezed(F.regexp_replace(c, f"(?U)[^\\w\\s{CJK}-]", " ")),
}


def clean(c: Column, **flags: bool) -> Column:
    """The cleaning steps that are switched on, in their fixed order; null stays null."""
    on = CLEANING | flags
    for name, step in STEPS.items():
        if on[name]:
            c = step(c)
    return c


def java_replacement(target: str) -> str:
    """A replacement in Python's notation (\\1, \\g<1>) in Java's."""
    out = target.replace("\\\\", "\0").replace("$", r"\$")
    out = re.sub(r"\\g<(\w+)>|\\(\d+)", lambda m: "${%s}" % m[1] if m[1] and not m[1].isdigit() else f"${m[1] or m[2]}", out)
    return out.replace("\0", r"\\")


def normalize(c: Column, simplify: bool = False, numbers: bool = False, times: bool = False, rules: list[tuple[str, str]] = (), first_match: bool = False) -> Column:
    """Simplified characters, number and time marks, then (pattern, target) rules
    in order (or only the first that matches), then single blanks. Numbers come
    before times, so with both on the digits of a date are numbers."""
    if simplify:
        c = F.translate(c, TRADITIONAL, SIMPLIFIED)
    if numbers:
        c = F.regexp_replace(c, NUMBER, " NUM_TOKEN ")
    if times:
        c = F.regexp_replace(c, TIME, " TIME_TOKEN ")
    replaced = [(p, f" {java_replacement(t)} ") for p, t in rules]
    if first_match:
        chain = c
        for p, t in reversed(replaced):
            chain = F.when(F.regexp_like(c, F.lit(p)), F.regexp_replace(c, p, t)).otherwise(chain)
        c = chain
    else:
        for p, t in replaced:
            c = F.regexp_replace(c, p, t)
    return squeezed(c)


MARKER = "phrase_marker_"


def protected(c: Column, phrases: list[tuple[str, str]]) -> Column:
    """Phrases, longest first and whatever their case, replaced by numbered markers."""
    for k, (source, _) in enumerate(sorted(phrases, key=lambda p: -len(p[0]))):
        c = F.regexp_replace(c, f"(?iu){re.escape(source)}", f" {MARKER}{k} ")
    return c


def phrase_targets(phrases: list[tuple[str, str]]) -> list[str]:
    return [t or s.replace(" ", "_") for s, t in sorted(phrases, key=lambda p: -len(p[0]))]


def phrase_hits(c: Column, phrases: list[tuple[str, str]]) -> Column:
    """Targets of the phrases found, longest phrase first."""
    c = protected(c, phrases)
    return F.array_compact(F.array(*(F.when(c.contains(f" {MARKER}{k} "), t) for k, t in enumerate(phrase_targets(phrases))))).cast("array<string>")


def tokenize(c: Column, phrases: list[tuple[str, str]] = (), camel: bool = True, hyphens: bool = True, slashes: bool = False, shortest: int = 1, targets: Column | None = None) -> Column:
    """Lower-case tokens in order: runs of CJK characters, or of ASCII letters,
    digits and `_` (joined by - or / as the switches say); phrases are one token.
    `targets`: the text comes with markers already, and marker k stands for its k-th element."""
    parts = F.regexp_extract_all(protected(c, phrases), F.lit(TOKEN), F.lit(0))
    if targets is None and phrases:
        targets = F.array(*(F.lit(t) for t in phrase_targets(phrases)))

    def split(part: Column) -> Column:
        out = F.regexp_replace(part, "([a-z])([A-Z])", "$1 $2") if camel else part
        for sign, on in (("-", hyphens), ("/", slashes)):
            out = F.replace(out, F.lit(sign), F.lit(" ")) if on else out
        words = F.split(F.lower(out), " ")
        if targets is None:
            return words
        number = F.when(F.regexp_like(part, F.lit(f"^{MARKER}[0-9]{{1,9}}$")), F.substring(part, len(MARKER) + 1, 9).cast("int"))
        target = F.get(targets, number)
        return F.when(target.isNotNull(), F.array(target)).otherwise(words)

    plain = targets is None and not camel and not hyphens and not slashes
    tokens = F.transform(parts, F.lower) if plain else F.flatten(F.transform(parts, split))
    return F.filter(tokens, lambda t: F.length(t) >= max(shortest, 1))


def ngrams(tokens: Column, least: int, most: int) -> Column:
    """The tokens, then their n-grams joined by `_`, by width and place, each once and none that is a token."""
    least, most = max(2, least), min(5, max(2, least, most))
    made = []
    for width in range(least, most + 1):
        starts = F.when(F.size(tokens) >= width, F.sequence(F.lit(1), F.size(tokens) - (width - 1))).otherwise(F.array().cast("array<int>"))
        made.append(_joined(tokens, starts, width))
    return F.concat(tokens, F.array_except(F.array_distinct(F.concat(*made)), tokens))


def _joined(tokens: Column, starts: Column, width: int) -> Column:
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, width), "_"))


def humanize(c: Column) -> Column:
    return squeezed(F.replace(c, F.lit("_"), F.lit(" ")))


def keyword(c: Column) -> Column:
    """A keyword candidate's normal form, null if it is none: signs to blanks, no
    numbers, no single Latin characters, Latin parts lower-case."""
    text = F.regexp_replace(humanize(c), f"(?U)[^\\w\\s{CJK}/-]", " ")
    text = F.trim(squeezed(text), F.lit(" -_/"))
    cjk = F.regexp_like(text, F.lit(f"[{CJK}]"))
    bad = (text == "") | F.regexp_like(text, F.lit(r"(?U)^\d+$")) | (~cjk & ~text.contains(" ") & (F.length(text) < 2))
    return F.when(~bad, F.when(cjk, F.array_join(F.transform(F.split(text, " "), lambda p: F.when(F.regexp_like(p, F.lit(f"[{CJK}]")), p).otherwise(F.lower(p))), " ")).otherwise(F.lower(text)))


def focus_variants(c: Column) -> Column:
    """Spellings under which a focus term and a token may meet."""
    raw = F.trim(c)
    one = squeezed(raw)
    forms = F.array(raw, one, F.replace(one, F.lit(" "), F.lit("_")), F.replace(one, F.lit("_"), F.lit(" ")), F.regexp_replace(one, r"(?U)[\s_]+", ""))
    parts = F.filter(F.transform(F.split(one, r"(?U)[\s_;/,，、-]+"), lambda p: F.trim(p)), lambda p: F.length(p) > 1)
    return F.array_distinct(F.filter(F.transform(F.concat(forms, parts), F.lower), lambda v: F.length(v) > 0))


def focus_signature(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"(?U)[\s_]+", ""))


def language(c: Column) -> Column:
    """zh if a text has at least as many CJK characters as Latin letters, else en."""
    n = lambda cls: F.length(F.regexp_replace(c, f"[^{cls}]", ""))
    return F.when(n(CJK) >= n("A-Za-z"), "zh").otherwise("en")


def preview(c: Column, length: int = 240) -> Column:
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("…"))).otherwise(c)
