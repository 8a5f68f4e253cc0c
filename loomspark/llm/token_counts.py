"""Token counts by the whole-token shortcut (operator 4).

A byte-level BPE tokenizer cuts a text into pre-tokens and merges each of them
on its own. Most pre-tokens are vocabulary entries that the merges build up
completely, but not every entry is: some can't be reached by the merges that
run first. So each vocabulary entry is put through the merges once, offline,
and those that come out as exactly one token form the proven set. When texts
are counted, a pre-token in the proven set counts as one without any merging,
and only the rest are merged (their counts kept in a bounded cache).

The proven set is found once on the driver and broadcast; the vocabulary bounds
its size. Rows are counted where they are read: no shuffle, no state.

Special strings of the tokenizer inside a text count as one token each, as the
library does by default. Texts are cut into pre-tokens by the same rule as the
library's; for code points up to 255 with the standard regex engine, for texts
with others by the library's own pre-tokenizer. Null texts count as empty;
repeated rows are rows like any others; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import WordCache, extended, table, texts

LIMIT = 1024
#: Letters, numbers and white space among the code points up to 255.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t\n\x0b\x0c\r \x85\xa0"
PRE_TOKENS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)


@functools.cache
def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if
    it is printable, else the next free code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@functools.cache
def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def prove(path: str) -> frozenset[str]:
    """The vocabulary's strings, as texts, that the merges turn into one token.

    Entries that are no whole UTF-8 text can't be a pre-token and are left out.
    """
    tokenizer, back = load(path), {c: b for b, c in byte_letters().items()}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    proven = set()
    for entry, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if entry in special or not all(c in back for c in entry):
            continue
        made = tokenizer.model.tokenize(entry)
        if len(made) == 1 and made[0].id == number:
            try:
                proven.add(bytes(back[c] for c in entry).decode())
            except UnicodeDecodeError:
                pass
    return frozenset(proven)


class Counter:
    """Counts a text's tokens; one for each Python worker and tokenizer."""

    def __init__(self, path: str, proven: frozenset[str]):
        self.tokenizer, self.proven = load(path), proven
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.letters = byte_letters()
        self.counts = WordCache(self.merged)

    def merged(self, pre_token: str) -> int:
        if pre_token in self.proven:
            return 1
        return len(self.tokenizer.model.tokenize("".join(map(self.letters.__getitem__, pre_token.encode()))))

    def plain(self, text: str) -> int:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            return sum(map(self.counts.__getitem__, (text[a:b] for _, (a, b) in cut)))
        return sum(map(self.counts.__getitem__, PRE_TOKENS.findall(text)))

    def count(self, text: str) -> int:
        if self.special is None or not (found := self.special.findall(text)):
            return self.plain(text)
        return len(found) + sum(map(self.plain, filter(None, self.special.split(text))))


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text)."""
    proven = docs.sparkSession.sparkContext.broadcast(prove(path))

    def made(b: pa.RecordBatch) -> list:
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path, proven.value))
        own = texts(b)
        n = [counter.count(t) for t in own]
        return [[len(t.encode()) for t in own], n, [x > limit for x in n]]

    return extended(docs.select("doc_id", "text"), ["doc_id"], made, "n_bytes bigint, n_tokens bigint, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by the byte-level tokenizer of 50k entries."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
