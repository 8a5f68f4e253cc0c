"""Packing documents into training sequences in their order (operator 5).

Documents keep the order of their ids. Sequences are windows of at most
`length` tokens over that stream; dynamic programming chooses the cuts. A
window pays its padding (none at a power of two), a fixed price for the
sequence, and a penalty for its right cut: none at the end of a document, a
little at the end of a sentence, much anywhere else. The least of
cost[i] + position[i] over the cuts i within `length` tokens is held in a
monotone queue, so a cut costs constant time; windows of a power of two below
`length` are looked up one by one (short ones only at the end of a partition).

The order is split by ranges of doc_id into partitions, and each partition is
packed as it is read: segments of about `segment` tokens are solved, and the
last window of a segment goes back to the front of the next. Memory holds one
segment, or the longest document. Only at the end of a partition may a short
sequence remain, and there every position is a possible cut, so it is divided
into powers of two where that is cheaper than padding.

A document's ids are those of the tokenizer without special tokens, then the
end id. The tokenizer merges each pre-token on its own, so the ids of pre-tokens
are kept in a bounded cache; texts where the cut into them isn't proven
(code points above 255, control separators, strings that may be special) go
through the library whole. Null texts are empty: one piece with the end id
only. Repeated rows and ids are packed one by one; a null doc_id comes first.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import WordCache, record_batch, table, texts
from .token_counts import LETTERS, NUMBERS, SPACES, byte_letters

LENGTH, END, SEGMENT = 4096, 2, 1 << 20
SEQUENCE_COST, SENTENCE_COST, HARD_COST, HARD_STEP = 8, 4, 64, 256
#: Marks of texts that the library encodes whole; the tokenizer's pre-tokens for code points up to
#: 255; vocabulary entries that end a sentence.
WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
PRE_TOKENS = re.compile(f"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
STOP = re.compile(r"[!-/:-@\[-`{-~]*[.!?]+[!-/:-@\[-`{-~]*</w>")


class Encoder:
    """A text's ids as little-endian 32-bit bytes, and where its sentences end."""

    def __init__(self, path: str, limit: int = 400_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.known = WordCache(self.merged, limit, 32)
        self.stops = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.stops[[n for t, n in self.tokenizer.get_vocab().items() if STOP.fullmatch(t)]] = True

    def merged(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def ids(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            plain = not any(map(text.__contains__, WHOLE))
        except UnicodeEncodeError:
            plain = False
        if not plain:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.known.__getitem__, PRE_TOKENS.findall(text.lower())))

    def encode(self, text: str) -> tuple[bytes, np.ndarray]:
        ids = self.ids(text)
        return ids, np.flatnonzero(self.stops[np.frombuffer(ids, "<u4")]) + 1


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(positions: np.ndarray, penalties: np.ndarray, length: int, shortest: int) -> list[int]:
    """The cheapest chain of cuts from the first position to the last.

    positions ascend by at most `length` a step; penalties[j] is paid for a
    window that ends at positions[j]. Powers of two below `shortest` are padded
    like other lengths.
    """
    n = len(positions)
    # Windows of a power of two: (end, start) as places, by rising end.
    short: list[tuple[int, int]] = [(-1, -1)]
    for k in range(length.bit_length()):
        if shortest <= 1 << k < length:
            start = np.minimum(np.searchsorted(positions, positions - (1 << k)), n - 1)
            ends = np.flatnonzero(positions[start] == positions - (1 << k))
            short += zip(ends.tolist(), start[ends].tolist(), strict=True)
    short[1:] = sorted(short[1:], reverse=True)
    at, price = positions.tolist(), (penalties + SEQUENCE_COST).tolist()
    cost, back = [0] * n, [0] * n
    queue = deque([(at[0], at[0], 0)])  # (cost + position, position, index), costs ascend
    for j in range(1, n):
        p = at[j]
        while queue[0][1] < p - length:
            queue.popleft()
        least, _, i = queue[0]
        best = least + length - p
        while short[-1][0] == j:
            k = short.pop()[1]
            if cost[k] < best:
                best, i = cost[k], k
        best += price[j]
        cost[j], back[j] = best, i
        while queue and queue[-1][0] >= best + p:
            queue.pop()
        queue.append((best + p, p, j))
    chain = [n - 1]
    while chain[-1]:
        chain.append(back[chain[-1]])
    return [at[i] for i in reversed(chain)]


class Packer:
    """Packs one partition's documents as they come."""

    def __init__(self, first_sequence: int, length: int, segment: int):
        self.sequence, self.length, self.segment = first_sequence, length, segment
        self.docs: list[tuple] = []  # (doc_id, ids, first token here, tokens before it, tokens of the document)
        self.sentences: list[np.ndarray] = []  # positions after a sentence, ascending
        self.ends: list[int] = []  # positions after a document
        self.tokens = 0

    def add(self, doc_id, ids: bytes, ends: np.ndarray) -> list[tuple]:
        n = len(ids) >> 2
        self.docs.append((doc_id, ids, self.tokens, 0, n))
        self.sentences.append(ends + self.tokens)
        self.tokens += n
        self.ends.append(self.tokens)
        return self.solve(False) if self.tokens >= self.segment else []

    def places(self, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """The possible cuts, ascending from 0, and what a cut there costs."""
        soft = np.unique(np.concatenate([[0], *self.sentences, self.ends])).astype(np.int64)
        # Hard cuts only where no sentence ends for HARD_STEP tokens.
        hard = [np.arange(soft[k] + HARD_STEP, soft[k + 1], HARD_STEP) for k in np.flatnonzero(np.diff(soft) > HARD_STEP)]
        if last:
            hard.append(np.arange(max(1, self.tokens - self.length), self.tokens))
        positions = np.unique(np.concatenate([soft, *hard])).astype(np.int64)
        price = np.full(len(positions), HARD_COST)
        price[np.searchsorted(positions, soft)] = SENTENCE_COST
        price[np.searchsorted(positions, self.ends)] = 0
        return positions, price

    def solve(self, last: bool) -> list[tuple]:
        if not self.tokens:
            return []
        chain = cuts(*self.places(last), self.length, 1 if last else self.length // 8)
        if not last and len(chain) > 2:
            chain.pop()
        return self.emit(chain)

    def emit(self, chain: list[int]) -> list[tuple]:
        rows, k = [], 0
        for a, b in zip(chain, chain[1:], strict=False):
            while k < len(self.docs) and self.docs[k][2] < b:
                doc_id, ids, at, skipped, total = self.docs[k]
                here = total - skipped
                x, y = max(a, at), min(b, at + here)
                if x < y:
                    part = memoryview(ids)[(x - at + skipped) * 4 : (y - at + skipped) * 4]
                    rows.append((doc_id, x - at + skipped, y - x, zlib.crc32(part), total, self.sequence, x - a))
                if at + here > b:
                    break
                k += 1
            self.sequence += 1
        end = chain[-1]
        rest = []
        for doc_id, ids, at, skipped, total in self.docs[k:]:
            gone = max(0, end - at)
            rest.append((doc_id, ids, max(0, at - end), skipped + gone, total))
        soft = np.concatenate(self.sentences) - end
        self.docs, self.sentences, self.ends = rest, [soft[soft > 0]], [p - end for p in self.ends if p > end]
        self.tokens -= end
        return rows


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, segment: int = SEGMENT) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    last = np.array([end], "<u4").tobytes()

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 32, length, segment)
        code = encoder(path)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                ids, ends = code.encode(text)
                rows += packer.add(doc_id, ids + last, ends)
            if rows:
                yield record_batch(rows, schema)
        if rows := packer.solve(True):
            yield record_batch(rows, schema)

    # Ties of doc_id are dealt out by the text's hash, so a repeated id doesn't meet in one task.
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    return rows.drop("h").mapInArrow(run, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
