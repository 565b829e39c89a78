"""Language-model scores from a weighted backoff automaton over smoothed n-grams.

Every word that was seen in training is a state, besides a root and a start state. From the state of word ``u`` an arc
for ``w`` carries log P(w | u); where there is none, a failure arc leads to the root at the cost of log of the mass
``u`` gives away, and the root's arc for ``w`` goes on. A text is read once from left to right, carrying the state and
adding up the log probabilities, its end included.

Smoothing: P1(w) = (c(w) - D) / N for known words and D V / N for the one class of unknown words, with D from the words
seen once; P(w | u) = (c(u w) + m P1(w)) / (c(u) + m), a proper distribution for every u. The one free number, m, makes
the mass given away over all contexts equal to the share of word pairs seen once (Good-Turing).

The automaton of a large corpus fits on no machine, and no text needs more of it than its own words. Texts are dealt
into chunks by their id. A chunk lists its distinct n-grams as sorted 64-bit fingerprints with their training counts;
the lists are cut by fingerprint range, and for each range one task adds the counts up and answers every chunk with
totals in the order of the list. The chunk then builds its part of the automaton and runs it. All training tokens are
counted, whatever their number, and no step holds more than a chunk or a range.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of text in a chunk, and training tokens in a range, on average.
CHUNK_CHARS = 6_000_000
RANGE_TOKENS = 4_000_000
#: Fingerprints of the marks around a text.
START, END = np.uint64(xxhash.xxh64_intdigest(b"\x00start")), np.uint64(xxhash.xxh64_intdigest(b"\x00end"))
#: Counts up to this are told apart in the histogram; larger ones by 64 steps a doubling.
FINE = 1024


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of word ``b`` after ``a``."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def planes(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes; rarely used high bytes compress away in the shuffle."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()


class Chunk:
    """The tokens of some texts: per text the local word numbers, and the chunk's distinct n-grams."""

    def __init__(self, texts: list[str | None], learn: list[bool]):
        number: dict[bytes, int] = {}
        rows = []
        for t in texts:
            rows.append([number.setdefault(w, len(number)) for w in (t or "").encode("utf-8", "surrogatepass").lower().split()])
        prints = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), dtype=np.uint64, count=len(number))
        self.rows = rows
        self.sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)) + 1
        words = np.empty(int(self.sizes.sum()), dtype=np.uint64)
        ends = np.cumsum(self.sizes) - 1
        inner = np.ones(len(words), dtype=bool)
        inner[ends] = False
        words[inner] = prints[np.fromiter((i for r in rows for i in r), dtype=np.int64, count=int(inner.sum()))]
        words[ends] = END
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[ends - self.sizes + 1] = START
        taught = np.repeat(np.asarray(learn, dtype=bool), self.sizes)
        self.words, self.grams = words, [words, chain(before, words)]
        #: Per order: distinct fingerprints, place of each token's among them, training counts.
        self.distinct, self.place, self.counts = [], [], []
        for g in self.grams:
            u, at = np.unique(g, return_inverse=True)
            self.distinct.append(u)
            self.place.append(at)
            self.counts.append(np.bincount(at[taught], minlength=len(u)))
        self.before = before


def _range_of(prints: np.ndarray, ranges: int) -> np.ndarray:
    """Range number of sorted fingerprints; equal widths of the 64-bit space, so no range is favoured."""
    return np.minimum((prints >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.uint64(ranges - 1)).astype(np.int64)


def _bin(counts: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(counts < FINE, counts, FINE + np.floor(64 * (np.log2(np.maximum(counts, 1)) - math.log2(FINE)))).astype(np.int64)


def mass_given_away(contexts: np.ndarray, types: np.ndarray, once: float) -> float:
    """``m`` with sum of c m / (c + m) over all contexts equal to the pairs seen once; by bisection on its logarithm."""
    total = float((contexts * types).sum())
    target = min(max(once, 1e-3 * total), 0.999 * total)
    lo, hi = -20.0, 60.0
    for _ in range(80):
        mid = (lo + hi) / 2
        m = math.exp(mid)
        if float((types * contexts * m / (contexts + m)).sum()) < target:
            lo = mid
        else:
            hi = mid
    return math.exp((lo + hi) / 2)


def summary(frame: pd.DataFrame) -> pd.DataFrame:
    """One row of corpus numbers from the histograms (``n``, ``bin``, ``types``, ``tokens``) of both orders."""
    frame = frame[frame["types"] > 0]
    one, two = frame[frame["n"] == 0], frame[frame["n"] == 1]
    tokens, types = float(one["tokens"].sum()), float(one["types"].sum())
    once = float(one.loc[one["bin"] == 1, "types"].sum())
    pairs_once = float(two.loc[two["bin"] == 1, "types"].sum())
    contexts = (one["tokens"] / one["types"]).to_numpy() if len(one) else np.zeros(0)
    m = mass_given_away(contexts, one["types"].to_numpy(dtype=float), pairs_once) if tokens else 1.0
    return pd.DataFrame([{"about": json.dumps({"tokens": tokens, "types": types, "discount": (once + 0.5) / (types + 1.0), "m": m})}])


class Automaton:
    """The part of the automaton that one chunk's texts can reach, in natural logarithms."""

    def __init__(self, chunk: Chunk, totals: list[np.ndarray], about: dict, starts: float):
        n, v, d, m = about["tokens"], about["types"], about["discount"], about["m"]
        count = totals[0].astype(float)
        with np.errstate(divide="ignore"):
            p1 = np.where(count > 0, (count - d) / max(n, 1.0), d * v / max(n, 1.0) if n else 1.0)
            self.root = np.log(p1).tolist()
            self.fail = np.where(count > 0, np.log(m) - np.log(count + m), 0.0).tolist()
        word = chunk.place[0]
        before = np.full(len(word), len(count), dtype=np.int64)
        follows = chunk.before != START
        before[follows] = word[np.flatnonzero(follows) - 1]
        self.start = len(count)
        self.fail.append(math.log(m) - math.log(starts + m) if starts else 0.0)
        self.known = (totals[0] > 0).tolist()
        # one arc per distinct pair that training has: its first place in the chunk names its two words
        first = np.full(len(totals[1]), -1, dtype=np.int64)
        first[chunk.place[1][::-1]] = np.arange(len(word))[::-1]
        arcs = np.flatnonzero(totals[1] > 0)
        u, w = before[first[arcs]], word[first[arcs]]
        context = np.append(count, starts)[u]
        weight = np.log((totals[1][arcs] + m * p1[w]) / (context + m))
        self.arcs = dict(zip((u * (self.start + 1) + w).tolist(), weight.tolist()))

    def score(self, tokens: list[int]) -> float:
        """log10 probability of a token sequence, in one pass that carries the state."""
        arcs, root, fail, known, width = self.arcs, self.root, self.fail, self.known, self.start + 1
        total, state = 0.0, self.start
        for w in tokens:
            weight = arcs.get(state * width + w) if state >= 0 else None
            if weight is None:
                total += root[w] + (fail[state] if state >= 0 else 0.0)
            else:
                total += weight
            state = w if known[w] else -1
        return total / math.log(10.0)


def scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
           chunk_chars: int = CHUNK_CHARS, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` per row of ``docs``.

    Learns from the rows where ``held_out`` is false and scores all, whole texts, null as empty (its end alone is
    scored). ``base_score`` is the add-one unigram score. Without training rows every score is zero. Repeated rows
    count and come back each; a null ``held_out`` counts as false; extra columns are ignored; an empty table gives no rows.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chars, rows = plain.agg(F.sum(F.length("text")), F.count(F.lit(1))).first()
    chunks = max(1, -(-(chars or 0) // chunk_chars))
    ranges = max(1, -(-((chars or 0) // 5 + rows) // range_tokens))
    # the chunk is hashed from id and length, so that repeated rows do not all land in one
    dealt = plain.withColumn("chunk", F.pmod(F.xxhash64("id", F.length("text")), F.lit(chunks)).cast("int")).repartition(chunks, "chunk")

    def ask(frame: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(frame["text"].tolist(), (~frame["held_out"]).tolist())
        out = []
        for n, (prints, counts) in enumerate(zip(chunk.distinct, chunk.counts)):
            of = _range_of(prints, ranges)
            cuts = np.searchsorted(of, np.arange(ranges + 1))
            for r in range(ranges):
                a, b = cuts[r], cuts[r + 1]
                if b > a:
                    out.append((int(frame["chunk"].iloc[0]), n, r, planes(np.diff(prints[a:b], prepend=np.uint64(0))), planes(counts[a:b])))
        return pd.DataFrame(out, columns=["chunk", "n", "range", "prints", "counts"])

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        prints = [np.cumsum(from_planes(p), dtype=np.uint64) for p in frame["prints"]]
        counts = [from_planes(c).astype(np.int64) for c in frame["counts"]]
        distinct, at = np.unique(np.concatenate(prints), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        out, done = [], 0
        n, r = int(frame["n"].iloc[0]), int(frame["range"].iloc[0])
        for chunk, p in zip(frame["chunk"], prints):
            out.append((int(chunk), n, r, planes(total[at[done:done + len(p)]]), None, None, None))
            done += len(p)
        seen = total[total > 0]
        bins, back = np.unique(_bin(seen), return_inverse=True)
        types, tokens = np.bincount(back, minlength=len(bins)), np.bincount(back, weights=seen, minlength=len(bins))
        out.append((-1, n, r, None, bins.tolist(), types.astype(float).tolist(), tokens.tolist()))
        return pd.DataFrame(out, columns=["chunk", "n", "range", "totals", "bins", "types", "tokens"])

    asked = dealt.groupBy("chunk").applyInPandas(ask, "chunk int, n int, range int, prints binary, counts binary")
    answered = asked.groupBy("n", "range").applyInPandas(
        answer, "chunk int, n int, range int, totals binary, bins array<long>, types array<double>, tokens array<double>")
    histogram = (answered.filter("chunk = -1").select("n", F.explode(F.arrays_zip("bins", "types", "tokens")).alias("x"))
                 .groupBy("n", F.col("x.bins").alias("bin")).agg(F.sum("x.types").alias("types"), F.sum("x.tokens").alias("tokens")))
    none = docs.sparkSession.range(1).selectExpr("0 n", "0L bin", "0D types", "0D tokens")  # so that there is a summary without training too
    about = histogram.unionByName(none).groupBy(F.lit(0).alias("all")).applyInPandas(lambda f: summary(f), "about string")
    starts = plain.filter(~F.col("held_out")).count()
    replies = answered.filter("chunk >= 0").select("chunk", "n", "range", "totals", F.lit(None).cast("string").alias("about"))
    numbers = docs.sparkSession.range(chunks).select(F.col("id").cast("int").alias("chunk")).crossJoin(F.broadcast(about)).select(
        "chunk", F.lit(-1).alias("n"), F.lit(-1).alias("range"), F.lit(None).cast("binary").alias("totals"), "about")

    def run(frame: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(frame):
            return pd.DataFrame(columns=columns)
        told = json.loads(reply.loc[reply["n"] == -1, "about"].iloc[0])
        chunk = Chunk(frame["text"].tolist(), (~frame["held_out"]).tolist())
        totals = []
        for n in (0, 1):
            mine = reply[reply["n"] == n].sort_values("range")
            totals.append(np.concatenate([from_planes(t) for t in mine["totals"]]).astype(np.int64))
        of_token = totals[0][chunk.place[0]]
        first = np.cumsum(chunk.sizes) - chunk.sizes
        n, v = told["tokens"], told["types"]
        base = np.add.reduceat(np.log10((of_token + 1) / (n + v + 1)), first)
        automaton = Automaton(chunk, totals, told, float(starts))
        tokens, value = chunk.place[0].tolist(), []
        for a, size in zip(first.tolist(), chunk.sizes.tolist()):
            value.append(automaton.score(tokens[a:a + size]) if n else 0.0)
        return pd.DataFrame({"id": frame["id"], "held_out": frame["held_out"], "n_tokens": chunk.sizes,
                             "n_known": np.add.reduceat((of_token > 0).astype(np.int64), first),
                             "train_tokens": int(n), "base_score": base, "score": value})[columns]

    return dealt.groupBy("chunk").cogroup(replies.union(numbers).groupBy("chunk")).applyInPandas(
        run, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
