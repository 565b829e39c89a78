"""Secret scans whose false positives a random forest removes; DataFrame functions and Spark ML only.

A candidate is any run of sixteen or more letters, digits and ``+ / _ -``. What tells a key from a long word, a number
or a path is learnt: the candidate's length, its character transitions, how much of it a dictionary of the corpus's own
short words covers, the path around it and the words beside it. The forest is trained on labelled findings and then
written out as a plain column expression, so scoring happens inside the scan of the texts without a join.

Training data is a bounded sample of the labelled findings; the dictionary counts all documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import cut_lineage, doc_text, words
from pelagia.llm.quality_rules import let

CANDIDATE = "[A-Za-z0-9+/_\\-]{16,}"
#: Characters kept on either side of a candidate.
CONTEXT = 60
#: Labelled findings of each class in the training sample, words in the dictionary.
SAMPLE = 5000
DICTIONARY = 3000
REPLACEMENT = "[SECRET]"


def _cut(text: Column) -> tuple[Column, Column]:
    """The stretches between candidates (one more than candidates) and the candidates."""
    return F.split(text, CANDIDATE), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))


def candidates(text: Column) -> Column:
    """Array of structs ``k`` (number in the text), ``candidate``, ``before``, ``after``."""
    between, found = _cut(text)
    both = F.struct(between.alias("b"), found.alias("f"))
    return let(both, lambda x: F.transform(x["f"], lambda c, k: F.struct(
        k.alias("k"), c.alias("candidate"), F.right(F.get(x["b"], k), F.lit(CONTEXT)).alias("before"),
        F.left(F.get(x["b"], k + 1), F.lit(CONTEXT)).alias("after"))))


def dictionary(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> list[str]:
    """Three-letter pieces of the ``size`` most frequent words of three to six letters in all of ``docs``."""
    word = docs.select(F.explode(F.filter(words(doc_text(text_col)), lambda w: w.rlike("^[a-z]{3,6}$"))).alias("w"))
    top = word.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()
    return sorted({row["w"][i:i + 3] for row in top for i in range(len(row["w"]) - 2)})


def features(c: Column, pieces: list[str]) -> dict[str, Column]:
    """Numbers about a candidate struct; shares are over its characters."""
    s, before, after = c["candidate"], c["before"], c["after"]
    n = F.length(s).cast("double")
    count = lambda pattern: F.length(F.regexp_replace(s, pattern, "")).cast("double") / n  # noqa: E731  what is left
    runs = s
    for kind, mark in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0")):
        runs = F.regexp_replace(runs, kind, mark)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substring(F.lower(s), i, F.lit(3)))
    covered = F.size(F.filter(grams, lambda g: g.isin(pieces or [""]))).cast("double") / F.greatest(n - 2, F.lit(1.0))
    flag = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    return {
        "length": n,
        "digits": count("[^0-9]+"),
        "capitals": count("[^A-Z]+"),
        "runs": F.length(runs).cast("double") / n,
        "vowel_turns": F.regexp_count(F.lower(s), F.lit("[aeiou][^aeiou]")).cast("double") / n,
        "variety": F.size(F.array_distinct(F.split(s, ""))).cast("double") / n,
        "hexadecimal": flag(s.rlike("^[0-9a-fA-F]+$")),
        "dictionary": covered,
        "path": flag(s.contains("/") | before.rlike("[/\\\\.@][^\\s]*$") | after.rlike("^[./\\\\@][A-Za-z]")),
        "assigned": flag(before.rlike("[=:]\\s*[\"']?$")),
        "named": flag(before.rlike("(?i)(key|token|secret|passw\\w*|pwd|auth|credential)\\W{0,5}$")),
        "quoted": flag(before.rlike("[\"']$")),
        "plain_neighbours": flag(before.rlike("(^|\\s)\\p{L}+[.,]?\\s+$")) + flag(after.rlike("^\\s+\\p{L}+")),
    }


def rule_label(c: Column) -> Column:
    """1 or 0 for findings whose form settles it, null for the others.

    Secrets: a value assigned to a credential's name, or an access key in a provider's fixed form. Not secrets: runs of
    letters in one case, runs of digits, and parts of a web address.
    """
    s, before = c["candidate"], c["before"]
    secret = before.rlike("(?i)(key|token|secret|password|passwd|pwd)[\"']?\\s*[=:]\\s*[\"']?$") & s.rlike("[0-9]")
    return (F.when(secret | s.rlike("^AKIA[0-9A-Z]{16}$") | s.rlike("^(ghp|gho|xoxb|sk)[_-][A-Za-z0-9_-]{16,}$"), 1)
            .when(s.rlike("^[A-Z]?[a-z]+$") | s.rlike("^[A-Z]+$") | s.rlike("^[0-9]+$"), 0)
            .when(before.rlike("(?i)(https?://|www[.])[^\\s]*$"), 0))


@dataclass(frozen=True)
class Forest:
    """Trees as nested (feature, threshold, left, right) tuples with votes at the leaves."""

    names: tuple[str, ...]
    trees: tuple
    pieces: tuple[str, ...]

    def share(self, c: Column) -> Column:
        """Share of trees that call the candidate struct ``c`` a secret; no trees: none."""
        if not self.trees:
            return F.lit(0.0)
        given = F.struct(*[v.alias(k) for k, v in features(c, list(self.pieces)).items()])

        def vote(node, x: Column) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, threshold, low, high = node
            return F.when(x[name] <= F.lit(threshold), vote(low, x)).otherwise(vote(high, x))

        return let(given, lambda x: sum((vote(t, x) for t in self.trees), F.lit(0.0)) / F.lit(float(len(self.trees))))


def _read_tree(lines: list[str], names: tuple[str, ...], depth: int = 1):
    """A tree from Spark's printed form; consumes ``lines``."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return float(line.split(":")[1])
    found = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
    low = _read_tree(lines, names)
    lines.pop(0)  # Else
    high = _read_tree(lines, names)
    return low if low == high and not isinstance(low, tuple) else (names[int(found[1])], float(found[2]), low, high)


def train(labelled: DataFrame, pieces: list[str], trees: int = 15, depth: int = 6, seed: int = 11) -> Forest:
    """A forest from ``labelled``: a struct column ``c`` (see ``candidates``) and ``label`` (1 a secret, 0 not).

    Null labels are left out. With one class only the forest says no to everything.
    """
    names = tuple(features(F.col("c"), pieces))
    # a finding copied any number of times counts once
    numbers = labelled.filter("label is not null").groupBy("label", "c.candidate", "c.before", "c.after").agg(F.min("c.k").alias("k")).select(
        "label", F.struct("k", "candidate", "before", "after").alias("c"))
    picked = None
    for label in (0, 1):
        some = numbers.filter(F.col("label") == label).orderBy(F.xxhash64("c.candidate", "c.before"), "c.after", "c.k").limit(SAMPLE)
        picked = some if picked is None else picked.union(some)
    rows = cut_lineage(picked.select(F.col("label").cast("double"), *[v.alias(k) for k, v in features(F.col("c"), pieces).items()]))
    if rows.select("label").distinct().count() < 2:
        return Forest(names, (), tuple(pieces))
    table = VectorAssembler(inputCols=list(names), outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(table)
    grown = []
    for tree in model.trees:
        grown.append(_read_tree(tree.toDebugString.split("\n")[1:], names))
    return Forest(names, tuple(grown), tuple(pieces))


def learn(docs: DataFrame, text_col: str = "text") -> Forest:
    """A forest from the findings in ``docs`` whose form settles their label."""
    found = docs.select(F.explode(candidates(doc_text(text_col))).alias("c"))
    return train(found.select("c", rule_label(F.col("c")).alias("label")), dictionary(docs, text_col))


def scan(docs: DataFrame, forest: Forest, text_col: str = "text", into: str = "secrets", least: float = 0.5) -> DataFrame:
    """``docs`` with an array ``into`` of the candidates the forest keeps: ``k``, ``candidate``, ``before``, ``after``, ``share``.

    Null and empty texts have none. Repeated candidates are each listed; rows, ids and other columns are as they were.
    """
    judged = F.transform(candidates(doc_text(text_col)), lambda c: F.struct(
        c["k"].alias("k"), c["candidate"].alias("candidate"), c["before"].alias("before"), c["after"].alias("after"), forest.share(c).alias("share")))
    return docs.withColumn(into, F.filter(judged, lambda x: x["share"] >= least))


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with every kept candidate in the text replaced; a null text stays null."""
    between, found = _cut(F.col(text_col))
    judged = F.transform(candidates(F.col(text_col)), lambda c: F.when(forest.share(c) >= least, F.lit(REPLACEMENT)).otherwise(c["candidate"]))
    whole = let(F.struct(between.alias("b"), judged.alias("j")), lambda x: F.array_join(
        F.transform(x["b"], lambda b, k: F.concat(b, F.coalesce(F.get(x["j"], k), F.lit("")))), ""))
    return docs.withColumn(text_col, F.when(F.size(found) == 0, F.col(text_col)).otherwise(whole))
