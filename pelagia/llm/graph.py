"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import cut_lineage
from pelagia.session import at_most, discard


def _toward_least(edges: DataFrame, both: bool) -> DataFrame:
    """One star step: link neighbours to the least node known around each node.

    The least neighbour is a partial aggregate, so a node with very many neighbours is not gathered;
    the join back to its edges is a plain equi-join that adaptive execution may split.
    """
    if both:
        around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    if both:
        linked = around.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        pairs = around.join(least, "a")
        linked = pairs.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
    return linked.filter(F.col("a") != F.col("b")).distinct()


def _crossed(edges: DataFrame) -> DataFrame:
    """Nodes that keep ``edges`` (distinct, ``a`` above ``b``) from being stars around least nodes: with two links down, or with one down and one up."""
    down, up = (edges.select(F.col(c).alias("node"), F.lit(c == "a").cast("int").alias("down"), F.lit(c == "b").cast("int").alias("up")) for c in ("a", "b"))
    return down.union(up).groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter((F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root`` for every node of ``edges``; the root is the least node reachable.

    Runs until all that is left are stars (a logarithmic number of rounds in practice); every round is a written table,
    so a lost executor costs one round. Stars are told by one grouped count, where another round would take six shuffles. Nulls and self links are left out; an empty table gives an empty table.
    """
    now = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    while True:
        last, now = now, cut_lineage(_toward_least(_toward_least(now, True), False))
        discard(last)
        if at_most(_crossed(now), 0):
            break
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(leaves.select(F.col("root").alias("node"), "root").distinct())
