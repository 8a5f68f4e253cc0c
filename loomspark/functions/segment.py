"""Segmentation of runs of CJK characters: a word graph and its most probable path.

Words and characters have costs, whole thousandths of a nat (so sums are exact
and ties are ties); the pieces of a run are the cheapest path through the graph
of its words, of equal ones that with the fewest pieces, then the longest first
words. Neighbouring characters that no word covers are cut by a tagger: each
character is the beginning, middle or end of a word or a word by itself, and the
cheapest sequence of tags says where words end. Costs and tags are learnt from a
corpus by operators/segmentation.py.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

CJK_RUN = "[一-鿿]+"
RUN = re.compile(CJK_RUN)
#: Bits of a path's number of pieces below its cost.
PIECES = 32


def nats(share: float) -> int:
    """The cost of a probability."""
    return round(-1000 * math.log(share))


@dataclass
class Tagger:
    """Costs of tags at the start and after another, and of characters under a tag."""

    start: dict[str, int]
    after: dict[tuple[str, str], int]
    shown: dict[str, dict[str, int]]
    unseen: dict[str, int]

    def cut(self, run: str) -> list[str]:
        """The words of the cheapest sequence of tags; of equal ones the first in the tags' order."""
        inf, after = math.inf, self.after
        begin, alone = self.start["B"], self.start["S"]
        (shown_b, new_b), (shown_m, new_m), (shown_e, new_e), (shown_s, new_s) = ((self.shown[t].get, self.unseen[t]) for t in "BMES")
        bm, be, mm, me = (after[t] for t in (("B", "M"), ("B", "E"), ("M", "M"), ("M", "E")))
        # Costs of the best paths that end in a tag, their order among each other, and which tag came before.
        b, m, e, s = begin + shown_b(run[0], new_b), inf, inf, alone + shown_s(run[0], new_s)
        at_b, at_e, at_m, at_s = 0, 1, 2, 3
        back = []
        for c in run[1:]:
            free, at_free, from_free = (e, at_e, "E") if (e, at_e) < (s, at_s) else (s, at_s, "S")
            m_next, at_m_next, from_m = (b + bm, at_b, "B") if (b + bm, at_b) < (m + mm, at_m) else (m + mm, at_m, "M")
            e_next, at_e_next, from_e = (b + be, at_b, "B") if (b + be, at_b) < (m + me, at_m) else (m + me, at_m, "M")
            back.append((from_free, from_m, from_e))
            b, m, e, s = free + begin + shown_b(c, new_b), m_next + shown_m(c, new_m), e_next + shown_e(c, new_e), free + alone + shown_s(c, new_s)
            order = sorted((4 * at_free, 4 * at_e_next + 1, 4 * at_m_next + 2, 4 * at_free + 3))
            at_b, at_e, at_m, at_s = map(order.index, (4 * at_free, 4 * at_e_next + 1, 4 * at_m_next + 2, 4 * at_free + 3))
        tags = ["E" if (e, at_e) < (s, at_s) else "S"]
        for from_free, from_m, from_e in reversed(back):
            t = tags[-1]
            tags.append(from_m if t == "M" else from_e if t == "E" else from_free)
        tags = "".join(reversed(tags))
        return [run[m.start() : m.end()] for m in re.finditer("BM*E|S", tags)]


def tagger(words: dict[str, int], characters: dict[str, int]) -> Tagger | None:
    """A tagger from the counts of words of several characters and of all
    characters; None without words. What the words don't account for of a
    character's count stands for it as a word of its own."""
    if not words:
        return None
    counts: dict[str, Counter] = {t: Counter() for t in "BMES"}
    two = more = inner = 0
    for w, n in words.items():
        counts["B"][w[0]] += n
        counts["E"][w[-1]] += n
        for c in w[1:-1]:
            counts["M"][c] += n
        two, more, inner = two + n * (len(w) == 2), more + n * (len(w) > 2), inner + n * max(0, len(w) - 3)
    for c, n in characters.items():
        counts["S"][c] = max(0, n - counts["B"][c] - counts["M"][c] - counts["E"][c])
    multi, single, known = two + more, sum(counts["S"].values()), len(characters) + 1
    begin, middle, end = (multi + 1) / (multi + single + 2), (more + 1) / (multi + 2), (more + 1) / (more + inner + 2)
    start = {"B": nats(begin), "S": nats(1 - begin)}
    after = {("B", "M"): nats(middle), ("B", "E"): nats(1 - middle), ("M", "E"): nats(end), ("M", "M"): nats(1 - end)}
    after |= {(t, u): start[u] for t in "ES" for u in "BS"}
    total = {t: sum(counts[t].values()) + known for t in "BMES"}
    shown = {t: {c: nats((n + 1) / total[t]) for c, n in counts[t].items()} for t in "BMES"}
    return Tagger(start, after, shown, {t: nats(1 / total[t]) for t in "BMES"})


class _Over(dict):
    """Costs over other costs, which stay as they are."""

    def __init__(self, below: dict[str, int]):
        super().__init__()
        self.below = below

    def get(self, word: str, default=None):
        cost = super().get(word)
        return self.below.get(word, default) if cost is None else cost


@dataclass
class Model:
    """Costs of words, the cost of an unseen character, and the tagger for what no word covers."""

    costs: dict[str, int] = field(default_factory=dict)
    unseen: int = 1000
    tags: Tagger | None = None
    longest: int = 1

    @staticmethod
    def learnt(words: dict[str, int], characters: dict[str, int], given: Iterable[str] = ()) -> Model:
        """The model of counted words and characters. Given words cost a little
        less than the cheapest path of their parts, so they are never cut into these."""
        total = sum(characters.values())
        costs = {w: nats(n / total) for w, n in (characters | words).items()}
        model = Model(costs, nats(1 / (total + 1)) + 1000, tagger(words, characters), max(map(len, costs), default=1))
        return model.with_words(given) if given else model

    def with_words(self, given: Iterable[str]) -> Model:
        """The model with further words, each cheaper than the cheapest path of its parts."""
        model = Model(_Over(self.costs), self.unseen, self.tags, self.longest)
        for w in sorted(set(given), key=lambda w: (len(w), w)):
            if w:
                model.costs[w] = model.path(w)[0] - 1
                model.longest = max(model.longest, len(w))
        return model

    def path(self, run: str) -> tuple[int, int, tuple[int, ...]]:
        """(cost, pieces, their negative lengths) of the cheapest path."""
        n, get, unseen = len(run), self.costs.get, self.unseen
        # best: cost and pieces in one number; of equal ones the longest step is seen first.
        best, steps = [0] * (n + 1), [0] * n
        for i in range(n - 1, -1, -1):
            cost = get(run[i], unseen)
            now, step = None, 1
            for k in range(min(self.longest, n - i), 1, -1):
                word = get(run[i : i + k])
                if word is not None:
                    option = (word << PIECES) + 1 + best[i + k]
                    if now is None or option < now:
                        now, step = option, k
            option = (cost << PIECES) + 1 + best[i + 1]
            if now is None or option < now:
                now, step = option, 1
            best[i], steps[i] = now, step
        cuts, at = [], 0
        while at < n:
            cuts.append(-steps[at])
            at += steps[at]
        return best[0] >> PIECES, best[0] & (1 << PIECES) - 1, tuple(cuts)

    def cut(self, run: str) -> list[str]:
        """The words of a run."""
        out, at, single = [], 0, ""

        def uncovered() -> list[str]:
            if len(single) < 2 or self.tags is None:
                return [single[j : j + 2] for j in range(0, len(single), 2)]
            return self.tags.cut(single)

        for k in self.path(run)[2]:
            piece = run[at : at - k]
            at -= k
            if k == -1:
                single += piece
                continue
            out += [*uncovered(), piece]
            single = ""
        return out + uncovered()


def segment(run: str, lexicon: Iterable[str], longest: int | None = None) -> list[str]:
    """The pieces of one run by a plain lexicon, without learnt frequencies."""
    words = [w for w in lexicon if longest is None or len(w) <= longest]
    return Model.learnt({}, {}, words).cut(run)
