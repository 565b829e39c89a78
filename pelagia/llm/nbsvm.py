"""Text quality by naive Bayes support vectors.

Features are indicators of distinct n-grams, hashed into a fixed number of slots: words and word pairs, and n-grams of
word shapes (runs of small letters, capitals and digits folded, other characters kept). Each indicator is scaled by the
log ratio of its frequency in the two classes, counted over all labelled rows; a linear hinge-loss model on the scaled
vectors is fitted by dual coordinate descent and mixed with its mean weight. Margins become scores by a logistic curve
fitted on rows the descent did not see.

Only two things reach the driver: the class counts of the slots (a fixed number) and the slots of a bounded sample of
labelled rows for the descent. Scoring is one pass over the texts with the folded weight vector.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import arrow_stage

SLOTS = 1 << 18
#: Labelled rows the descent and the logistic curve learn from, three quarters and one quarter.
SAMPLE = 6000
#: Byte classes of shapes: small letter, capital, digit, any other as it is; bytes of other scripts count as small.
_SHAPE = bytes(97 if 97 <= b <= 122 or b > 127 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_FOLDED = np.isin(np.arange(256), [97, 65, 48])


def shape(raw: bytes) -> bytes:
    """Small letters, capitals and digits by class, runs of one class folded; other characters as they are."""
    now = np.frombuffer(raw.translate(_SHAPE), dtype=np.uint8)
    keep = np.ones(len(now), dtype=bool)
    keep[1:] = (now[1:] != now[:-1]) | ~_FOLDED[now[1:]]
    return now[keep].tobytes()


class _Numbers(dict):
    """crc32 of words, computed once while the word is kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = zlib.crc32(word)
        return value


_WORDS, _SEEN = _Numbers(), np.zeros(SLOTS, dtype=bool)


def _chained(numbers: np.ndarray, length: int, kind: int) -> np.ndarray:
    """Slots of the runs of ``length`` neighbours."""
    n = len(numbers) - length + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = np.full(n, kind + 1, dtype=np.uint64)
        for k in range(length):
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + numbers[k:k + n]
        return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOTS.bit_length() + 1)


def slots(text: str | None) -> np.ndarray:
    """Distinct slots of a text's n-grams, sorted; none for a text without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros(0, dtype=np.int32)
    shapes = shape(raw).split()
    w = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    s = np.fromiter(map(_WORDS.__getitem__, shapes), dtype=np.uint64, count=len(shapes))
    for numbers, length, kind in ((w, 1, 0), (w, 2, 1), (s, 1, 2), (s, 2, 3), (s, 3, 4)):
        _SEEN[_chained(numbers, length, kind)] = True
    if (w[1:] == w[:-1]).any():
        _SEEN[zlib.crc32(b"\x05") & (SLOTS - 1)] = True
    found = np.flatnonzero(_SEEN)
    _SEEN[found] = False
    return found.astype(np.int32)


def with_slots(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``'s ``id``, ``label`` and the slots of ``text_col``."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([slots(t.as_py()) for t in batch.column(2)], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["id", "label", "slots"])

    return arrow_stage(docs.select("id", "label", F.col(text_col).cast("string").alias("text")), step, "id long, label int, slots array<int>")


@dataclass(frozen=True)
class Model:
    """Folded weights per slot, intercept, and the logistic curve over margins."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray, ratio_norm: float) -> float:
        return float(self.weights[found].sum()) / ratio_norm + self.bias if len(found) else self.bias


def descend(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; the intercept is a feature that is always one."""
    w, b = np.zeros(SLOTS), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(rows)):
            y = labels[i]
            slope = y * (float(w[rows[i]] @ values[i]) + b) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            step = (new - alpha[i]) * y
            if step:
                w[rows[i]] += step * values[i]
                b += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


def logistic(margins: np.ndarray, good: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of P(good | margin) by Newton steps, towards smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + c, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        ga, gc = float(g @ margins) + 1e-3 * (a - 1), float(g.sum())
        haa, hac, hcc = float(h @ margins ** 2) + 1e-3, float(h @ margins), float(h.sum()) + 1e-9
        det = haa * hcc - hac * hac
        if det <= 0:
            break
        da, dc = (hcc * ga - hac * gc) / det, (haa * gc - hac * ga) / det
        a, c = a - max(min(da, 2.0), -2.0), c - max(min(dc, 2.0), -2.0)
        if abs(da) + abs(dc) < 1e-6:
            break
    return max(a, 1e-3), c


def fit(labelled: DataFrame, sample: DataFrame, mix: float = 0.25) -> tuple[Model, np.ndarray]:
    """Model and log-count ratios; both tables have ``label`` (0 or 1) and ``slots``, ``sample`` also ``id``.

    The ratios count ``labelled``, the descent learns from ``sample``. With one class only, or none, the score is that
    class's smoothed share.
    """
    counted = labelled.select("label", F.explode("slots").alias("slot")).groupBy("slot").agg(
        F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("poor")).toArrow()
    p, q = np.ones(SLOTS), np.ones(SLOTS)
    at = counted.column("slot").to_numpy()
    p[at] += counted.column("good").to_numpy()
    q[at] += counted.column("poor").to_numpy()
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    picked = sample.orderBy(F.xxhash64("id"), "id", F.xxhash64("slots")).toArrow()
    rows = [np.asarray(r, dtype=np.int64) for r in picked.column("slots").to_pylist()]
    good = picked.column("label").to_numpy() == 1
    if not len(rows) or good.all() or not good.any():
        share = (good.sum() + 1.0) / (len(rows) + 2.0)
        return Model(np.zeros(SLOTS), 0.0, 1.0, math.log(share / (1 - share))), ratio
    values = [ratio[r] / max(math.sqrt(float(ratio[r] @ ratio[r])), 1e-9) for r in rows]
    learn = np.arange(len(rows)) % 4 != 3
    w, b = descend([r for r, k in zip(rows, learn) if k], [v for v, k in zip(values, learn) if k], np.where(good[learn], 1.0, -1.0))
    w = (1 - mix) * np.abs(w[w != 0]).mean() * np.sign(w) + mix * w if (w != 0).any() else w
    model = Model((w * ratio).astype(np.float32), b, 1.0, 0.0)
    margins = np.array([float(w[r] @ v) + b for r, v in zip(rows, values)])
    unseen = ~learn if (~learn).any() and good[~learn].any() and not good[~learn].all() else np.ones(len(rows), dtype=bool)
    slope, shift = logistic(margins[unseen], good[unseen])
    return Model(model.weights, b, slope, shift), ratio


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, label_col: str = "quality", id_col: str = "doc_id",
                   text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``id``, ``held_out``, ``score`` (0 to 1), ``predicted`` per row of ``docs``.

    Learns from the rows of ``labels`` whose id is in ``docs`` and not held out. Null and empty texts have no feature
    and get the curve's value at the intercept. Null labels teach nothing; repeated rows count and come back each; a
    null id is scored and teaches nothing; extra columns are ignored; an empty table gives no rows.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                        F.col(text_col).cast("string").alias("text"))
    given = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("label is not null")
    given = given.filter(F.col("label").isin(0, 1))
    # the sample is drawn on ids alone, so its size bounds what is broadcast and what the driver gets
    picked = plain.filter(~F.col("held_out")).select("id").join(given.hint("merge"), "id").orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    taught = plain.filter(~F.col("held_out")).select("id", "text").hint("merge").join(given.hint("merge"), "id")
    drawn = plain.join(F.broadcast(picked.distinct()), "id")
    model, ratio = fit(with_slots(taught), with_slots(drawn))
    ratio = ratio.astype(np.float32)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.empty(batch.num_rows)
        for i, text in enumerate(batch.column(2)):
            found = slots(text.as_py())
            norm = max(math.sqrt(float((ratio[found].astype(np.float64) ** 2).sum())), 1e-9)
            out[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * model.margin(found, norm) + model.shift))))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array((out >= 0.5).astype(np.int32))],
                                          ["id", "held_out", "score", "predicted"])

    return arrow_stage(plain, step, "id long, held_out boolean, score double, predicted int")
