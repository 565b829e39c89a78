"""URL filters: address rules first, gradient-boosted trees on the address's form for the rest; DataFrame functions and Spark ML only.

A rule names a host and the start of a path and allows or blocks it with all subdomains; the longest rule that fits decides.
What no rule fits is judged by boosted trees over lexical features: lengths, depth, share of digits, entropy of the
host's letters, number of parameters, and statistics of the host's suffixes, that is how often labelled URLs of the last
one, two and three labels of the host were blocked. A URL never sees its own label in these: rows are dealt into two
halves by a hash of the URL and each half reads the counts of the other, in training and in use alike.

Suffixes are counted over all labelled rows in ``SLOTS`` hash slots, so the table has a size that no input exceeds; it is the
only thing broadcast. Training takes a bounded sample of distinct labelled URLs; the trees then become a plain column
expression and every row is judged where it is read, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import cut_lineage
from pelagia.llm.quality_rules import let
from pelagia.llm.secrets import _read_tree

#: Distinct labelled URLs of each class in the training sample.
SAMPLE = 20_000
#: Hash slots of the suffix statistics (rows of the broadcast table at most).
SLOTS = 1 << 16
#: Labels of a host that make its suffixes, at most.
LEVELS = 3
#: Weight of the overall share in a suffix's share.
PRIOR = 10.0
#: Host words that mark a URL as unwanted when no labelled URLs are given.
UNWANTED = ("casino", "bet", "bets", "poker", "pills", "pharma", "adult", "xxx", "porn", "spam", "ads", "adserver", "tracker", "warez", "loan", "loans")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> Column:
    """Struct ``host``, ``path`` of a URL: what stands after the first ``://`` up to ``/``, ``?``, ``#``, with A-Z
    lower-cased, and what follows up to ``?`` or ``#``. Null, and a text without ``://``, give two empty strings."""
    given = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(given, "://") > 0, F.substring(given, F.instr(given, "://") + 3, F.length(given))).otherwise(F.lit(""))
    return let(rest, lambda r: F.struct(
        F.translate(F.regexp_extract(r, "^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract(r, "^[^/?#]*([^?#]*)", 1).alias("path")))


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for ``text``: a host, and from its first slash on the start of a path."""

    verdict: str
    text: str

    def fits(self, at: Column) -> Column:
        host, slash, path = self.text.partition("/")
        same = (at["host"] == host) | at["host"].endswith("." + host)
        return same & at["path"].startswith(slash + path)


def ruled(at: Column, rules: list[Rule]) -> Column:
    """Struct ``rule``, ``verdict`` of the longest rule that fits the struct ``at`` (``host``, ``path``); nulls if none does.

    Of two rules with the same text the one that blocks counts.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text, r.verdict)):  # later ones win
        fits = r.fits(at)
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return F.struct(rule.alias("rule"), verdict.alias("verdict"))


def topic_label(url: Column, rules: list[Rule], unwanted: tuple[str, ...] = UNWANTED) -> Column:
    """1 where a word of the host is one of ``unwanted``, null where a rule blocks for other reasons, else 0."""
    def of(at: Column) -> Column:
        word = at["host"].rlike("(^|[^a-z])(" + "|".join(unwanted) + ")([^a-z]|$)")
        return F.when(word, 1).when(ruled(at, rules)["verdict"] == "block", F.lit(None)).otherwise(0)

    return let(parts(url), of)


def lexical(url: Column, at: Column) -> dict[str, Column]:
    """Numbers about the form of a URL; ``at`` is its ``parts``."""
    given = F.coalesce(url, F.lit(""))
    host, path = at["host"], at["path"]
    size = lambda c: F.length(c).cast("double")
    left = lambda c, pattern: size(F.regexp_replace(c, pattern, ""))
    query = F.regexp_extract(given, "[?]([^#]*)", 1)

    def entropy(chars: Column) -> Column:
        n = F.greatest(F.length(chars), F.lit(1)).cast("double")
        shares = F.transform(F.array_distinct(F.split(chars, "")), lambda c: (F.length(chars) - F.length(F.replace(chars, c))) / n)
        return F.aggregate(F.filter(shares, lambda s: s > 0), F.lit(0.0), lambda t, s: t - s * F.log2(s))

    return {
        "length": size(given),
        "host_length": size(host),
        "host_labels": left(host, "[^.]+"),
        "host_hyphens": left(host, "[^-]+"),
        "host_digits": left(host, "[^0-9]+") / F.greatest(size(host), F.lit(1.0)),
        "host_entropy": let(host, entropy),
        "longest_label": F.array_max(F.transform(F.split(host, "[.]"), lambda x: F.length(x))).cast("double"),
        "path_length": size(path),
        "depth": left(path, "[^/]+"),
        "digits": left(given, "[^0-9]+") / F.greatest(size(given), F.lit(1.0)),
        "parameters": F.when(query == "", 0.0).otherwise(left(query, "[^&]+") + 1.0),
        "secure": F.when(given.startswith("https:"), 1.0).otherwise(0.0),
        "fragment": F.when(given.contains("#"), 1.0).otherwise(0.0),
    }


def slots(host: Column) -> list[Column]:
    """Slot of each of the host's suffixes."""
    return [F.pmod(F.xxhash64(F.lit(k), F.substring_index(host, ".", -k)), F.lit(SLOTS)).cast("int") for k in range(1, LEVELS + 1)]


def half(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(url, F.lit("")), F.lit(5)), F.lit(2))


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """``slot``, ``n0``, ``b0``, ``n1``, ``b1``: labelled and blocked URLs of each half, from ``url``, ``label``; ``SLOTS`` rows at most."""
    rows = labelled.filter("label is not null").select(half(F.col("url")).alias("half"), F.col("label").cast("long").alias("label"),
                                                       F.explode(F.array(*slots(parts(F.col("url"))["host"]))).alias("slot"))
    one = lambda h, v: F.sum(F.when(F.col("half") == h, v).otherwise(F.lit(0))).alias
    return rows.groupBy("slot").agg(one(0, F.lit(1))("n0"), one(0, F.col("label"))("b0"), one(1, F.lit(1))("n1"), one(1, F.col("label"))("b1"))


@dataclass(frozen=True)
class UrlTrees:
    """Weighted trees as nested (feature, threshold, left, right) tuples, and the suffix counts they read."""

    trees: tuple
    weights: tuple[float, ...]
    overall: float
    counts: DataFrame | None

    def margin(self, x: Column) -> Column:
        """Above zero: block. ``x`` is a struct of features; no trees: minus one."""
        if not self.trees:
            return F.lit(-1.0)

        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, threshold, low, high = node
            return F.when(x[name] <= F.lit(threshold), value(low)).otherwise(value(high))

        return sum((F.lit(w) * value(t) for w, t in zip(self.weights, self.trees)), F.lit(0.0))


def featured(rows: DataFrame, counts: DataFrame, overall: float) -> DataFrame:
    """``rows`` (with ``url``) with a struct ``x`` of all features; joined with the broadcast slots of the suffixes."""
    at = parts(F.col("url"))
    now = rows.withColumn("at", at)
    now = now.select("*", half(F.col("url")).alias("half"), *[s.alias(f"slot{k}") for k, s in enumerate(slots(F.col("at.host")), 1)])
    numbers = lexical(F.col("url"), F.col("at"))
    for k in range(1, LEVELS + 1):
        side = F.broadcast(counts.select(F.col("slot").alias(f"slot{k}"), *[F.col(c).alias(f"{c}_{k}") for c in ("n0", "b0", "n1", "b1")]))
        now = now.join(side, f"slot{k}", "left")
        other = lambda c: F.coalesce(F.when(F.col("half") == 0, F.col(f"{c}1_{k}")).otherwise(F.col(f"{c}0_{k}")), F.lit(0)).cast("double")  # noqa: B023, E731
        numbers[f"suffix{k}_share"] = (other("b") + PRIOR * overall) / (other("n") + PRIOR)
        numbers[f"suffix{k}_seen"] = F.log1p(other("n"))
    return now.select(*[F.col(f"`{c}`") for c in rows.columns], "at", F.struct(*[v.alias(n) for n, v in numbers.items()]).alias("x"))


def train(labelled: DataFrame, trees: int = 20, depth: int = 4, seed: int = 7) -> UrlTrees:
    """Trees from ``labelled``: ``url`` and ``label`` (1 block, 0 allow; null rows are left out).

    With one class only, nothing is blocked. Every labelled row is counted in the suffix statistics; the trees are fitted on at
    most ``SAMPLE`` distinct URLs of each class, by hash.
    """
    counts = cut_lineage(suffix_counts(labelled))
    whole = labelled.filter("label is not null").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("b")).first()
    if not whole["n"] or whole["b"] in (0, whole["n"]):
        return UrlTrees((), (), 0.0, None)
    overall = whole["b"] / whole["n"]
    distinct = labelled.filter("label is not null").groupBy("url").agg(F.max("label").alias("label"))
    picked = None
    for label in (0, 1):
        some = distinct.filter(F.col("label") == label).orderBy(F.xxhash64("url"), "url").limit(SAMPLE)
        picked = some if picked is None else picked.union(some)
    rows = featured(cut_lineage(picked), counts, overall)
    names = list(rows.schema["x"].dataType.names)
    table = VectorAssembler(inputCols=names, outputCol="features").transform(cut_lineage(rows.select(F.col("label").cast("double"), "x.*").coalesce(4)))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, seed=seed).fit(table)
    grown = tuple(_read_tree(t.toDebugString.split("\n")[1:], tuple(names)) for t in model.trees)
    return UrlTrees(grown, tuple(model.treeWeights), overall, counts)


def judge(pages: DataFrame, rules: list[Rule], model: UrlTrees, url_col: str = "url", into: str = "judged") -> DataFrame:
    """``pages`` with a struct ``into``: ``host``, ``path``, ``rule``, ``verdict`` (allow or block), ``margin`` of the trees.

    The rule's verdict where one fits, else block where the margin is above zero. A null or odd URL has an empty host and
    path and is judged by its form like any other. Repeated rows each come back; other columns stay, whatever their names
    (a column named ``into`` is replaced); an empty table gives no rows.
    """
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(url_col).cast("string").alias("url"))
    if model.counts is None:
        seen = rows.select("row", parts(F.col("url")).alias("at"), F.lit(None).cast("string").alias("x"))
    else:
        seen = featured(rows, model.counts, model.overall)
    rule, margin = F.col("ruled.rule"), F.col("margin")
    found = seen.select("row", "at", ruled(F.col("at"), rules).alias("ruled"), model.margin(F.col("x")).alias("margin"))
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(margin > 0, F.lit("block")).otherwise(F.lit("allow")))
    judged = F.struct("at.host", "at.path", rule.alias("rule"), verdict.alias("verdict"), margin.alias("margin"))
    return found.select(*[F.col(f"row.`{c}`") for c in pages.columns if c != into], judged.alias(into))
