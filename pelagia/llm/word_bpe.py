"""Word-level BPE encoding and decoding: speculate, verify, repair.

A word is first cut by greedy longest match, which needs no merge at all. Whether that guess is what merging would
give is decided per adjacent pair of proposed tokens: two neighbours are compatible when, going back through the
merges that built the left one's right edge and the right one's left edge, no earlier merge would have joined pieces
across the border. The check runs over all pairs of a batch of words at once on arrays. Only words with an
incompatible pair are merged exactly.

Words of a batch are handled once each and kept in a cache of bounded size; the cache changes no result.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import arrow_stage

#: Unicode white space, as the tokenizer's ``\\s`` has it (fixed values).
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Words kept between batches.
CACHE = 500_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


class WordBpe:
    """Encoder and decoder for a vocabulary file with word-end pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern.replace("\\s", WHITE))
        self.white = regex.compile(f"[{WHITE}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.names = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for name, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = name
        self.longest = max(map(len, self.vocab))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        n = len(self.names)
        self.made = [self.vocab[a + b] for a, b in pairs]
        # how each token was built: rank of its merge (none for single bytes), left part and right part
        self.built = np.full(n, -1, dtype=np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        keys = np.empty(len(pairs), dtype=np.int64)
        for r, (a, b) in enumerate(pairs):
            whole, x, y = self.vocab[a + b], self.vocab[a], self.vocab[b]
            keys[r] = x * n + y
            if self.built[whole] < 0:
                self.built[whole], self.left[whole], self.right[whole] = r, x, y
        order = np.argsort(keys, kind="stable")
        self.merge_keys, self.merge_ranks = keys[order], order
        self.ranks: dict[int, int] = dict(zip(keys.tolist(), range(len(pairs))))
        self.cache: dict[str, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of ``a`` and ``b``; a very large number where there is none."""
        key = a * len(self.names) + b
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == key, self.merge_ranks[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens ``a`` and ``b`` side by side stay apart under merging, for all pairs at once.

        Walk back in time: undo the later of the two merges at the border. The pieces that then face each other were
        there from the time both existed until the undone merge; if their own merge ranks before it, it would have
        come first.
        """
        a, b = a.copy(), b.copy()
        good = self._rank(a, b) == np.iinfo(np.int64).max
        live = np.flatnonzero(good)
        while len(live):
            x, y = a[live], b[live]
            bx, by = self.built[x], self.built[y]
            moving = (bx >= 0) | (by >= 0)
            live, x, y, bx, by = live[moving], x[moving], y[moving], bx[moving], by[moving]
            undo_left = bx > by
            undone = np.where(undo_left, bx, by)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
            joined = self._rank(x, y)
            # equal ranks cannot meet at one border; a merge at the same rank goes left to right
            bad = joined < undone
            bad |= (joined == undone) & ~undo_left
            good[live[bad]] = False
            a[live], b[live] = x, y
            live = live[~bad]
        return good

    def exact(self, word: str) -> list[int]:
        """Merge the lowest ranked pair, leftmost first, until none is left.

        Pieces form a linked list and pairs wait in a heap by rank and place, so a word of n letters takes n log n steps; a
        pair that a merge has changed since is passed over.
        """
        ids = [self.vocab[c] for c in word[:-1]]
        ids.append(self.vocab[word[-1] + self.end])
        n, rank, last = len(self.names), self.ranks.get, len(ids)
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        waiting = [(r, i) for i, r in enumerate(rank(x * n + y) for x, y in zip(ids, ids[1:])) if r is not None]
        heapq.heapify(waiting)
        while waiting:
            least, i = heapq.heappop(waiting)
            j = after[i]
            if ids[i] < 0 or j == last or rank(ids[i] * n + ids[j]) != least:
                continue
            ids[i], ids[j], after[i] = self.made[least], -1, after[j]
            if after[i] < last:
                before[after[i]] = i
                r = rank(ids[i] * n + ids[after[i]])
                if r is not None:
                    heapq.heappush(waiting, (r, i))
            if before[i] >= 0:
                r = rank(ids[before[i]] * n + ids[i])
                if r is not None:
                    heapq.heappush(waiting, (r, before[i]))
        return [x for x in ids if x >= 0]

    def greedy(self, word: str) -> list[int]:
        """Longest match from the left; the word end sticks to the last letter."""
        ids, at, n, vocab, end = [], 0, len(word), self.vocab, self.end
        while at < n:
            whole = vocab.get(word[at:] + end) if n - at <= self.longest else None
            if whole is not None:
                ids.append(whole)
                break
            stop = min(n - 1, at + self.longest)
            if stop == at:  # one letter is left and has no end form
                raise ValueError(f"no token for {word!r}")
            while stop > at + 1 and word[at:stop] not in vocab:
                stop -= 1
            ids.append(vocab[word[at:stop]])
            at = stop
        return ids

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of byte-letter words: greedy proposals, verified together, repaired where they fail."""
        found = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        if not sizes.sum():
            return found
        flat = np.fromiter((i for ids in found for i in ids), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(found)), sizes)
        border = np.flatnonzero(owner[1:] == owner[:-1])
        if len(border):
            pair, back = np.unique(flat[border] * len(self.names) + flat[border + 1], return_inverse=True)
            good = self.compatible(pair // len(self.names), pair % len(self.names))[back]
            for k in np.unique(owner[border[~good]]):
                found[k] = self.exact(words[k])
        return found

    def _learn(self, chunks: Iterable[str]) -> None:
        """Put the ids of white-space free chunks into the cache."""
        new = [c for c in chunks if c not in self.cache]
        if not new:
            return
        pieces = [self.pieces.findall(c) for c in new]
        distinct = [p for p in {p for ps in pieces for p in ps} if p not in self.cache]  # a piece is a chunk of one piece too
        spelled = [p if p.isascii() and p.isprintable() else p.encode("utf-8").decode("latin-1").translate(self.letters) for p in distinct]
        flat = self.encode_words(spelled)
        sizes = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
        raw = np.fromiter((i for ids in flat for i in ids), dtype="<u4", count=int(sizes.sum())).tobytes()
        ends = np.cumsum(4 * sizes).tolist()
        known = self.cache
        known.update((p, raw[a:b]) for p, a, b in zip(distinct, [0, *ends], ends))
        known.update((c, known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])) for c, ps in zip(new, pieces))

    def chunks(self, text: str) -> list[str]:
        """Runs without white space; four control characters split for Python but not for the tokenizer."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [c for c in self.white.split(text) if c]
        return text.split()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; null and empty texts give none."""
        parts: list[list[list[str] | int]] = []
        for text in texts:
            row: list[list[str] | int] = []
            for piece in self.cut.split(text or "") if self.cut else [text or ""]:
                if piece in self.special:
                    row.append(self.special[piece])
                elif piece:
                    flat = piece if piece.isascii() else unicodedata.normalize("NFC", piece)
                    row.append(self.chunks(flat.replace("Σ", "σ").lower()))
            parts.append(row)
        wanted: set[str] = set()
        for row in parts:
            for p in row:
                if not isinstance(p, int):
                    wanted.update(p)
        if len(self.cache) + len(wanted) > CACHE:
            self.cache.clear()
        self._learn(wanted)
        out, known = [], self.cache.__getitem__
        for row in parts:
            out.append(b"".join([p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(known, p)) for p in row]))
        return out

    def decode(self, ids: bytes) -> str:
        """The tokens' names with one blank between; special tokens are kept."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One encoder per Python worker and file."""
    return WordBpe(path)


def _slices(batch: pa.RecordBatch, column: int, limit: int = 4_000_000) -> Iterable[pa.RecordBatch]:
    """Parts of a batch with some megabytes of that column each, one row at least."""
    sizes = np.fromiter((len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(column)), dtype=np.int64, count=batch.num_rows)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    yield batch.slice(start)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``ids`` (little-endian unsigned 32-bit token ids, packed) per row of ``docs``.

    Whole texts; null is empty and gives no ids. Special tokens written in a text are those tokens. Repeated rows
    each come back, a null id stays null, extra columns are ignored. ``path`` is the vocabulary file, which every
    executor must have.
    """

    def step(batch: pa.RecordBatch):
        bpe = load(path)
        for part in _slices(batch, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bpe.encode_batch(part.column(1).to_pylist()), pa.binary())], ["id", "ids"])

    return arrow_stage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), step, "id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (``id``, ``ids``) with ``text``: the decoded text; no ids give an empty text."""

    def step(batch: pa.RecordBatch):
        bpe = load(path)
        for part in _slices(batch, 1, 1_000_000):
            texts = [bpe.decode(x or b"") for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["id", "ids", "text"])

    return arrow_stage(encoded.select("id", "ids"), step, "id long, ids binary, text string")
