"""Tokens of raw texts in Arrow batches.

The result is that of text.tokenize(text.normalize(text.clean(c))), found in one
pass over a text. What cleaning does to punctuation and white space is left out:
neither stands in a token, and a token ends at both whatever they become.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

#: Characters of texts whose tokens are Python strings at the same time.
HELD = 1_000_000
#: The cleaning steps that change tokens and are done here.
STEPS = ("strip_html", "strip_urls", "full_half_width_normalize", "lowercase_english")
_WIDE = str.maketrans(text.FULL, text.HALF)
#: The bytes of texts without CJK and full-width characters.
_BEFORE_CJK = bytes(range(0xE3))
_HTML, _URL, _CAMEL = re.compile(text.HTML), re.compile(text.URL, re.A), re.compile("([a-z])([A-Z])")


def splitter(camel: bool = True, hyphens: bool = True, slashes: bool = False, shortest: int = 1, steps: tuple[str, ...] = ()) -> Callable[[str], list[bytes]]:
    """A function from a text to its lower-case tokens after the cleaning steps named."""
    # A sign that splits ends the token, one that doesn't may stand between two parts.
    signs = "".join(s for s, on in (("-", hyphens), ("/", slashes)) if not on)
    word = "[A-Za-z0-9_]+" + (f"(?:[{signs}][A-Za-z0-9_]+)*" if signs else "")
    every, joined, inner = re.compile(f"[{text.CJK}]+|{word}").findall, re.compile(word.encode()).findall, signs.encode()
    html, urls, wide, low = (s in steps for s in STEPS)
    table = bytes(c if chr(c).isalnum() and c < 128 or c in b"_" + inner else 32 for c in range(256)).lower()

    def split(t: str) -> list[bytes]:
        if html and "<" in t and ">" in t:
            t = _HTML.sub(" ", t)
        if urls and ("http" in t or "www." in t):
            t = _URL.sub(" ", t)
        rare = not t.isascii() and t.encode().translate(None, _BEFORE_CJK)
        if rare and wide:
            t = t.translate(_WIDE)
        if low:
            t = t.lower()
        elif camel:
            t = _CAMEL.sub(r"\1 \2", t)
        if rare:
            # Lower-casing a whole text could make letters of other signs.
            return [x.lower().encode() for x in every(t) if len(x) >= shortest]
        found = t.encode().translate(table).split()
        if any(s in t for s in signs):
            found = [y for x in found for y in joined(x)]
        return found if shortest <= 1 else [x for x in found if len(x) >= shortest]

    return split


def split_all(texts: pa.Array, split: Callable[[str], list[bytes]]) -> pa.Array:
    """The lists of tokens of an array of texts; null stays null."""
    values, ends, held, size = [], [0], [], 0
    for t in texts:
        t = t.as_py()
        if t is None:
            ends.append(None)
            continue
        if size > HELD:
            values.append(pa.array(held, pa.binary()).view(pa.string()))
            held, size = [], 0
        found = split(t)
        held += found
        size += len(t)
        ends.append(len(found))
    values.append(pa.array(held, pa.binary()).view(pa.string()))
    at, offsets = 0, [0]
    for n in ends[1:]:
        at += n or 0
        offsets.append(at)
    mask = pa.array([n is None for n in ends[1:]])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(values), mask=mask)


def tokens(c: Column, camel: bool = True, hyphens: bool = True, slashes: bool = False, shortest: int = 1, steps: tuple[str, ...] = ()) -> Column:
    """text.tokenize(c), after the cleaning steps named."""
    split = splitter(camel, hyphens, slashes, shortest, steps)

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        return split_all(texts, split)

    return found(c)


def cleaned_tokens(c: Column, **flags: bool) -> Column:
    """text.tokenize(text.normalize(text.clean(c, **flags)))."""
    on = text.CLEANING | flags
    if on["strip_email"] or on["strip_phone"] or on["remove_emoji"] or on["remove_special_chars"]:
        return tokens(text.clean(c, **flags))
    return tokens(c, steps=tuple(s for s in STEPS if on[s]))
