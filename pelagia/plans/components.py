"""Connected components of grid cells (4 neighbours), label = smallest flat index.

1. Each tile (bounded number of cells) is labelled on its own.
2. Cells on tile borders give edges between tile labels: a graph far smaller than the grid.
3. That graph is solved by repeated minimum over neighbours plus pointer jumping.
4. The solved labels are joined back on the tile label.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pelagia.session import cut_lineage

TILE = 64


def _label_tile(height: int, width: int, grid_width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        top, left = i.min(), j.min()
        big = np.iinfo(np.int64).max
        labels = np.full((i.max() - top + 3, j.max() - left + 3), big, dtype=np.int64)
        r, c = i - top + 1, j - left + 1
        labels[r, c] = i.astype(np.int64) * grid_width + j
        mask = labels != big
        while True:
            near = np.minimum.reduce([labels, np.roll(labels, 1, 0), np.roll(labels, -1, 0),
                                      np.roll(labels, 1, 1), np.roll(labels, -1, 1)])
            new = np.where(mask, near, big)
            if np.array_equal(new, labels):
                break
            labels = new
        return pdf.assign(tile_label=labels[r, c])
    return run


def connected_components(cells: DataFrame, keys: list[str], grid_width: int, tile: int = TILE) -> DataFrame:
    """Adds ``label`` to mask cells ``(keys..., i, j)``."""
    base = cells.select(*keys, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))
    fields = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in [*keys, "i", "j", "_ti", "_tj"] if k in fields)
    tiled = base.withColumns({"_ti": F.floor(F.col("i") / tile).cast("int"),
                              "_tj": F.floor(F.col("j") / tile).cast("int")})
    local = cut_lineage(
        tiled.groupBy(*keys, "_ti", "_tj").applyInPandas(
            _label_tile(tile, tile, grid_width), schema + ", _ti int, _tj int, tile_label bigint"))

    def border(di: int, dj: int) -> DataFrame:
        axis = "i" if di else "j"
        a = local.where(F.col(axis) % tile == tile - 1).select(
            *keys, (F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), F.col("tile_label").alias("a"))
        b = local.where(F.col(axis) % tile == 0).select(*keys, "i", "j", F.col("tile_label").alias("b"))
        return a.join(b, [*keys, "i", "j"]).select(*keys, "a", "b")

    edges = cut_lineage(border(1, 0).unionByName(border(0, 1)).distinct())
    labels = graph_components(edges, keys)
    return (local.join(labels.withColumnRenamed("node", "tile_label"), [*keys, "tile_label"], "left")
            .select(*keys, "i", "j", F.coalesce("root", "tile_label").alias("label")))


def graph_components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., node, root) with root = smallest node id of the component."""
    both = cut_lineage(edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root"))
    while True:
        state = cut_lineage(state)
        # Offer my root to my neighbours, and to my current root (so trees merge at the top).
        offers = both.join(state.select(*keys, F.col("node").alias("a"), "root"), [*keys, "a"]) \
            .select(*keys, F.col("b").alias("node"), "root")
        best = offers.groupBy(*keys, "node").agg(F.min("root").alias("offer"))
        hooked = state.join(best, [*keys, "node"], "left").select(
            *keys, "node", F.col("root").alias("old"), F.least("root", F.coalesce("offer", "root")).alias("root"))
        lifted = hooked.groupBy(*keys, F.col("old").alias("node")).agg(F.min("root").alias("lift"))
        merged = hooked.join(lifted, [*keys, "node"], "left").select(
            *keys, "node", "old", F.least("root", F.coalesce("lift", "root")).alias("root"))
        # Pointer jumping halves the remaining depth.
        parent = merged.select(*keys, F.col("node").alias("root"), F.col("root").alias("grand"))
        jumped = cut_lineage(merged.join(parent, [*keys, "root"], "left").select(
            *keys, "node", "old", F.least("root", F.coalesce("grand", "root")).alias("root")))
        changed = jumped.where(F.col("root") != F.col("old")).limit(1).count()
        state = jumped.drop("old")
        if not changed:
            return state
