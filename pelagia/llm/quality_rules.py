"""Quality rules by weak supervision, in DataFrame functions only.

Every rule votes on a text: 1 (good), -1 (poor) or 0 (abstains). Most rules only speak when they see a defect. How far
a rule can be trusted is not set by hand: expectation-maximisation over the counted vote patterns estimates each rule's
accuracy (votes independent given the class, abstaining independent of it, rules better than chance). A text's
posterior probability of being good decides, instead of passing every rule.

Patterns are counted with a partial aggregation; there are at most 3 to the number of rules of them, whatever the
input, and only those counts reach the driver. Scoring is a sum of per-rule weights inside the row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import SPACE, doc_text, words

#: Characters counted as symbols (fixed by the task).
SYMBOLS = "#*$%&|<>"
ROUNDS = 60


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for all its uses, lambdas included."""
    return F.transform(F.array(value), use)[0]


def _covered(positions: Column, width: int) -> Column:
    """How many places windows of ``width`` at the (sorted) ``positions`` cover."""
    return let(positions, lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))),
        F.lit(0).cast("long"), lambda a, x: a + x))


def repeat_words(ws: Column, width: int = 3) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the array."""

    def counted(w: Column) -> Column:
        hashes = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)])),
                         F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0)))

        def found(h: Column) -> Column:
            placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
            again = let(placed, lambda s: F.filter(F.transform(s, lambda x, i: F.when(
                (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["p"])), lambda p: p.isNotNull()))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
                _covered(F.sort_array(again), width))

        return let(hashes, found)

    return let(ws, counted)


def rule_stats(docs: DataFrame, text_col: str = "text", into: str = "stats") -> DataFrame:
    """``docs`` with a struct column ``into`` of counts over the whole text (null: empty).

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``n_lines`` (lines with a word),
    ``n_upper``, ``n_distinct`` (words), ``n_closed`` (lines that end with a sentence mark), ``n_marked`` (words with
    a symbol), ``n_loud`` (words of capitals, two at least). All are zero for an empty text.
    """
    text = doc_text(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.size(F.filter(w, lambda x: x.rlike("[#*$%&|<>]"))).cast("long").alias("n_marked"),
            F.size(F.filter(w, lambda x: x.rlike("^\\P{Ll}*\\p{Lu}\\P{Ll}*\\p{Lu}\\P{Ll}*$"))).cast("long").alias("n_loud"))

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda v: v.rlike("[.!?][\\x20\\x09-\\x0D]*$"))).cast("long").alias("n_closed"))

    parts = docs.withColumn("__w", let(words(text), of_words)).withColumn("__l", let(lines, of_lines))
    return parts.withColumn(into, F.struct(
        *[F.col(f"__w.{k}").alias(k) for k in ("n_words", "word_chars")],
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.col("__l.n_dup_lines").alias("n_dup_lines"),
        F.col("__w.n_repeat_words").alias("n_repeat_words"),
        F.col("__l.n_lines").alias("n_lines"),
        F.length(F.regexp_replace(text, "\\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.col("__w.n_distinct").alias("n_distinct"),
        F.col("__l.n_closed").alias("n_closed"),
        F.col("__w.n_marked").alias("n_marked"),
        F.col("__w.n_loud").alias("n_loud"))).drop("__w", "__l")


def votes(stats: str = "stats") -> dict[str, Column]:
    """The rules' votes as columns over the struct ``stats``; every share is over words, characters or lines."""
    s = lambda k: F.col(f"{stats}.{k}")
    share = lambda a, b: F.coalesce(F.try_divide(s(a), s(b)), F.lit(0.0))
    defect = lambda c: F.when(c, -1).otherwise(0)
    mean = share("word_chars", "n_words")
    return {
        "short": defect(s("n_words") < 50),
        "symbol_share": defect(share("n_symbols", "word_chars") > 0.03),
        "symbols_per_word": defect(share("n_symbols", "n_words") > 0.15),
        "marked_words": defect(share("n_marked", "n_words") > 0.15),
        "repeats": defect(share("n_repeat_words", "n_words") > 0.3),
        "variety": defect(share("n_distinct", "n_words") < 0.1),
        "lines": defect(share("n_dup_lines", "n_lines") > 0.3),
        "upper": defect(share("n_upper", "word_chars") > 0.25),
        "shouted": defect(share("n_loud", "n_words") > 0.25),
        "word_length": F.when(mean.between(3.0, 10.0), 1).otherwise(-1),
        "sentences": F.when(share("n_closed", "n_lines") > 0.6, 1).when(share("n_closed", "n_lines") < 0.1, -1).otherwise(0),
    }


#: Rules that also vote for a text; in the first belief they count half as much as a seen defect.
BOTH_WAYS = ("word_length", "sentences")


@dataclass(frozen=True)
class VoteModel:
    """Log odds of good over poor: a prior and what a vote of each rule weighs."""

    rules: tuple[str, ...]
    prior: float
    weights: tuple[float, ...]

    def posterior(self, given: dict[str, Column]) -> Column:
        total = F.lit(self.prior)
        for name, weight in zip(self.rules, self.weights):
            total = total + given[name] * F.lit(weight)
        return 1.0 / (1.0 + F.exp(-total))


def _odds(p: float) -> float:
    return math.log(p / (1.0 - p))


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rules: tuple[str, ...], rounds: int = ROUNDS) -> VoteModel:
    """Expectation-maximisation over (votes, count) patterns, from a weighed majority as the first belief.

    Accuracies stay within 0.55 and 0.99 and are smoothed by one imagined right vote and one wrong one in ten. No
    texts, or rules that never speak, leave the first weights.
    """
    weights = tuple(1.0 if r in BOTH_WAYS else 2.0 for r in rules)
    prior, total = 0.5, sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        belief = [1.0 / (1.0 + math.exp(-prior - sum(w * x for w, x in zip(weights, v)))) for v, _ in patterns]
        good = sum(b * n for b, (_, n) in zip(belief, patterns))
        prior = _odds((good + 1.0) / (total + 2.0))
        new = []
        for k in range(len(rules)):
            right, spoken = 9.0, 10.0
            for b, (v, n) in zip(belief, patterns):
                if v[k]:
                    spoken += n
                    right += n * (b if v[k] > 0 else 1.0 - b)
            new.append(_odds(min(0.99, max(0.55, right / spoken))))
        weights = tuple(new)
    return VoteModel(rules, prior, weights)


def learn(with_stats: DataFrame, stats: str = "stats") -> VoteModel:
    """The rules' accuracies from all rows of ``with_stats`` (see ``rule_stats``)."""
    given = votes(stats)
    counted = with_stats.groupBy(*[v.alias(k) for k, v in given.items()]).count().collect()
    patterns = sorted((tuple(row[k] for k in given), row["count"]) for row in counted)
    return fit_votes(patterns, tuple(given))


def judge(with_stats: DataFrame, model: VoteModel, stats: str = "stats") -> DataFrame:
    """``with_stats`` and ``base_failed``, ``posterior``, ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated three-word windows. ``kept`` is false
    then, and else true where the posterior is one half or more.
    """
    n, again = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (with_stats
            .withColumn("base_failed", (n < 50) | (100 * again > 50 * n))
            .withColumn("posterior", model.posterior(votes(stats)))
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)))
