"""Periodic runs of words found on a grammar of the texts.

A run is a stretch of words that repeats with a smallest period q at least four times, six words at least, and that no
neighbouring word extends. Texts are compressed by Re-Pair over their word numbers: the pair of neighbours that occurs
most often becomes a nonterminal. Each round replaces every pair that is the most frequent one around it, so many pairs
go in one round and the one most frequent of all always does; what repeats no more is paired up evenly until a text is
one symbol. Texts of a slice share the grammar, so copies are looked at once.

A run lies in one deepest nonterminal that holds it whole, and there it crosses the border of the two parts. Having four
periods it has two of them on one side, so a square stands next to the border: for each nonterminal and each period up to a
quarter of its length, squares at the border are looked for once, extended both ways, and carried to all positions where the
nonterminal is derived. Pieces of a run cut off by a smaller nonterminal's edge lie inside the whole run and are merged.

Stretches are compared by polynomial hashes, and every run that is returned is verified on the words; should a hash have lied,
the slice is done again with another base, so results are exact.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import arrow_stage
from pelagia.llm.word_bpe import _slices

#: Modulus of the hashes, a prime.
PRIME = (1 << 31) - 1
#: Least number of periods and of words in a run.
PERIODS, WORDS = 4, 6
#: Text bytes handled at a time (a single longer text is handled alone); pairs of nonterminal and period tested at a time.
SLICE, TESTS = 3_000_000, 1_000_000
#: Least share of symbols that a round of pair replacement has to save; the rest is paired up evenly.
SAVING = 0.02


class Grammar:
    """Nonterminals over ``word`` (numbers of all words of several texts, ``owner`` their text)."""

    def __init__(self, word: np.ndarray, owner: np.ndarray):
        self.size = [np.ones(int(word.max()) + 1 if len(word) else 0, dtype=np.int64)]
        self.first, self.border = [np.zeros(len(self.size[0]), dtype=np.int64)], [np.zeros(len(self.size[0]), dtype=np.int64)]
        self.symbols, self.known = len(self.size[0]), {}
        self.derived: list[tuple[np.ndarray, np.ndarray]] = []
        self.symbol, self.start, self.owner = word.astype(np.int64), np.arange(len(word)), owner
        self.length = np.ones(len(word), dtype=np.int64)
        while (before := len(self.symbol)) > 1:
            at = self._frequent()
            if not len(at):
                break
            self._replace(at)
            if before - len(self.symbol) < SAVING * before:
                break
        while len(at := self._even()):
            self._replace(at)
        self.size, self.first, self.border = (np.concatenate(x) for x in (self.size, self.first, self.border))
        self.derived_symbol, self.derived_start = (np.concatenate([d[k] for d in self.derived]) if self.derived else np.zeros(0, dtype=np.int64) for k in (0, 1))

    def _frequent(self) -> np.ndarray:
        """Places whose pair occurs twice or more and more often than the pairs that overlap it."""
        s = self.symbol
        inside = self.owner[1:] == self.owner[:-1]
        # of pairs of one symbol in a row every second one, so that a pair does not overlap itself
        edge = np.concatenate([[True], (s[1:] != s[:-1]) | ~inside])
        inrow = np.arange(len(s)) - np.maximum.accumulate(np.where(edge, np.arange(len(s)), 0))
        usable = np.flatnonzero(inside & ((s[1:] != s[:-1]) | (inrow[:-1] % 2 == 0)))
        _, kind, count = np.unique(s[usable] << 32 | s[usable + 1], return_inverse=True, return_counts=True)
        weight = np.full(len(s) + 1, -1, dtype=np.int64)  # of the pair at each place, one ahead
        often = count[kind] > 1
        weight[usable[often] + 1] = count[kind[often]] * len(count) + kind[often]
        at = usable[often]
        best = (weight[at + 1] > weight[at]) & (weight[at + 1] > weight[at + 2])
        at, kind = at[best], kind[often][best]
        return at[np.bincount(kind, minlength=len(count))[kind] > 1]

    def _even(self) -> np.ndarray:
        """Every second place of each text that has a neighbour to its right."""
        n = len(self.symbol)
        if n < 2:
            return np.zeros(0, dtype=np.int64)
        edge = np.concatenate([[True], self.owner[1:] != self.owner[:-1]])
        inside = np.arange(n) - np.maximum.accumulate(np.where(edge, np.arange(n), 0))
        return np.flatnonzero(~edge[1:] & (inside[:-1] % 2 == 0))

    def _replace(self, at: np.ndarray) -> None:
        key, where, back = np.unique(self.symbol[at] << 32 | self.symbol[at + 1], return_index=True, return_inverse=True)
        number = np.empty(len(key), dtype=np.int64)
        new = []
        for k, pair in enumerate(key.tolist()):
            number[k] = self.known.setdefault(pair, self.symbols + len(new))
            if number[k] == self.symbols + len(new):
                new.append(k)
        shown = at[where[new]]
        self.size.append(self.length[shown] + self.length[shown + 1])
        self.first.append(self.start[shown])
        self.border.append(self.start[shown + 1])
        self.symbols += len(new)
        self.symbol[at] = number[back]
        self.length[at] += self.length[at + 1]
        self.derived.append((self.symbol[at], self.start[at]))
        stay = np.ones(len(self.symbol), dtype=bool)
        stay[at + 1] = False
        self.symbol, self.start, self.owner, self.length = (x[stay] for x in (self.symbol, self.start, self.owner, self.length))


class Hashes:
    """Hashes of all stretches of ``word``."""

    def __init__(self, word: np.ndarray, seed: int):
        random = np.random.default_rng(seed)
        value = random.integers(1, PRIME, size=int(word.max()) + 1 if len(word) else 1)
        self.power = np.empty(len(word) + 1, dtype=np.int64)
        self.power[0], done, factor = 1, 1, int(random.integers(1 << 20, PRIME))
        while done < len(self.power):
            more = min(done, len(self.power) - done)
            self.power[done:done + more] = self.power[:more] * factor % PRIME
            done, factor = done + more, factor * factor % PRIME
        self.upto = np.concatenate([[0], np.cumsum(value[word] * self.power[:-1] % PRIME)]) % PRIME

    def same(self, i: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``n`` words from ``i`` and from ``i + q`` are equal."""
        here, there = self.upto[i + n] - self.upto[i], self.upto[i + q + n] - self.upto[i + q]
        return (here % PRIME * self.power[q] - there) % PRIME == 0

    def reach(self, i: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from ``i`` on (or before ``i``) equal those ``q`` further, ``most`` at most."""
        low, high = np.zeros_like(most), most + 1
        while np.any(high - low > 1):
            middle = (low + high) // 2
            good = self.same(i - middle if back else i, q, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle)
        return low


def border_runs(g: Grammar, word: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, ...]:
    """``symbol``, ``start``, ``end``, ``period`` of the runs at the border of each nonterminal, where it occurs first."""
    out = []
    symbols = np.flatnonzero(g.size >= WORDS)
    todo = np.cumsum(g.size[symbols] // PERIODS)
    cuts = np.searchsorted(todo, np.arange(TESTS, (todo[-1] if len(todo) else 0) + TESTS, TESTS))
    for part in np.split(symbols, np.unique(cuts[:-1])):
        many = g.size[part] // PERIODS
        x = np.repeat(part, many)
        q = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many) + 1
        low, border = g.first[x], g.border[x]
        high = low + g.size[x]
        for right in (True, False):
            ok = np.flatnonzero(border + 2 * q <= high if right else border - 2 * q >= low)
            i, p = (border[ok] if right else border[ok] - 2 * q[ok]), q[ok]
            same = (word[i] == word[i + p]) & (word[i + p - 1] == word[i + 2 * p - 1])
            ok, i, p = ok[same], i[same], p[same]
            same = hashes.same(i, p, p)
            ok, p = ok[same], p[same]
            a = border[ok] if right else border[ok] - p
            ahead = hashes.reach(a, p, high[ok] - p - a, False)
            back = hashes.reach(a, p, a - low[ok], True)
            start, end = a - back, a + ahead + p
            long = end - start >= np.maximum(WORDS, PERIODS * p)
            out.append((x[ok][long], start[long], end[long], p[long]))
    symbol, start, end, period = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, dtype=np.int64) for k in range(4))
    # a stretch with several periods has the smallest of them
    order = np.lexsort((period, end, start, symbol))
    symbol, start, end, period = symbol[order], start[order], end[order], period[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (symbol[1:] != symbol[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return symbol[new], start[new], end[new], period[new]


def runs(word: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start``, ``end``, ``period`` of all runs, by start and period; places count over all texts, no run crosses texts."""
    none = np.zeros(0, dtype=np.int64)
    if not len(word):
        return none, none, none
    g = Grammar(word, owner)
    for seed in itertools.count():
        symbol, start, end, period = border_runs(g, word, Hashes(word, seed))
        at = np.isin(g.derived_symbol, symbol)
        place, head = g.derived_symbol[at], g.derived_start[at]
        low, high = np.searchsorted(symbol, place), np.searchsorted(symbol, place, "right")
        many = high - low
        row = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        move = np.repeat(head, many) - g.first[symbol[row]]
        start, end, period = start[row] + move, end[row] + move, period[row]
        order = np.lexsort((-end, start, period))
        start, end, period = start[order], end[order], period[order]
        reach = period * (len(word) + 1) + end
        whole = np.ones(len(order), dtype=bool)
        whole[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
        start, end, period = start[whole], end[whole], period[whole]
        if all(np.array_equal(word[s:e - p], word[s + p:e]) for s, e, p in zip(start.tolist(), end.tolist(), period.tolist())):
            order = np.lexsort((period, start))
            return start[order], end[order], period[order]


def _lists(starts: np.ndarray, values: list[np.ndarray], names: list[str]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.StructArray.from_arrays([pa.array(v) for v in values], names))


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_words``, ``runs`` (array of ``start``, ``length``, ``period`` in words, by start then period), ``kept``.

    Words are stretches without the six ASCII white-space characters; ``kept`` joins with one space the words that no run
    covers after its first period. Null and empty texts have no words and no runs. Repeated rows each come back, a null
    id stays null, extra columns are ignored, an empty table gives no rows. A task holds a few megabytes of text at a time, or one
    text where that is longer.
    """

    def step(batch: pa.RecordBatch):
        for part in _slices(batch, 1, SLICE):
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass").split() for t in part.column(1)]
            number: dict[bytes, int] = {}
            cuts = np.cumsum([0, *map(len, texts)])
            word = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), dtype=np.int64, count=int(cuts[-1]))
            start, end, period = runs(word, np.repeat(np.arange(len(texts)), np.diff(cuts)))
            covered = np.zeros(len(word) + 1, dtype=np.int64)
            np.add.at(covered, start + period, 1)
            np.add.at(covered, end, -1)
            covered = np.cumsum(covered)[:-1] > 0
            split = np.searchsorted(start, cuts)
            kept = []
            for k, t in enumerate(texts):
                if split[k] < split[k + 1]:
                    t = [t[i] for i in np.flatnonzero(~covered[cuts[k]:cuts[k + 1]]).tolist()]
                kept.append(b" ".join(t))
            inside = start - np.repeat(cuts[:-1], np.diff(split))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(cuts)), _lists(split, [inside, end - start, period], ["start", "length", "period"]), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "n_words", "runs", "kept"])

    return arrow_stage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), step,
                       "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string")
