"""Near-duplicate vectors by navigable small-world graphs per shard.

Exact copies are grouped first and stand for one node with a size, so a vector that fills a third of the table is one
node. The nodes of a label are dealt into shards of bounded size; each shard gets a hierarchical navigable small-world
graph, written to a table. Every node then queries every shard of its label, in blocks. A query runs a beam through the
graph and from its best nodes floods along graph edges while similarity stays near the threshold, so groups wider than
the beam are found whole. Each block audits itself: for some queries the exact answer is computed, and while recall is
below the goal the beam and the flood's margin widen, up to an exact scan. Every pair is verified by its cosine in double
precision. Pairs stay in the task: it returns link counts and the roots of its own components, which are united globally.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import cut_lineage
from pelagia.llm.graph import components

#: Most nodes of a shard, most queries of a block.
SHARD, BLOCK = 16_384, 4_096
#: Edges kept per node (twice as many on the ground layer), beam while building, first beam of queries.
DEGREE, BUILD_BEAM, BEAM = 12, 48, 32
#: Audited queries per block and the recall they must show.
AUDIT, GOAL = 48, 0.98


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, by cosine."""

    def __init__(self, vectors: np.ndarray):
        self.x = vectors
        n = len(vectors)
        random = np.random.default_rng(n)
        self.level = np.minimum((-np.log(random.random(n)) / np.log(DEGREE)).astype(int), 6)
        self.edges: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int32) for _ in range(lv + 1)] for lv in self.level]
        self.entry = 0
        for i in range(1, n):
            self._insert(i)
        for i in range(n):  # trimmed lists may have lost a node from all others: its nearest neighbour always names it
            if len(self.edges[i][0]):
                v = int(self.edges[i][0][0])
                if i not in self.edges[v][0]:
                    self.edges[v][0] = np.append(self.edges[v][0], np.int32(i))

    def _beam(self, q: np.ndarray, start: list[int], width: int, layer: int) -> list[tuple[float, int]]:
        """Best ``width`` nodes of a layer as (similarity, node), best first."""
        seen = set(start)
        sims = self.x[start] @ q
        todo = [(-s, v) for s, v in zip(sims.tolist(), start)]
        heapq.heapify(todo)
        best = [(s, v) for s, v in zip(sims.tolist(), start)]
        heapq.heapify(best)
        while todo:
            s, at = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            new = [v for v in self.edges[at][layer].tolist() if v not in seen]
            if not new:
                continue
            seen.update(new)
            for s, v in zip((self.x[new] @ q).tolist(), new):
                if len(best) < width:
                    heapq.heappush(best, (s, v))
                    heapq.heappush(todo, (-s, v))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, v))
                    heapq.heappush(todo, (-s, v))
        return sorted(best, reverse=True)

    def _choose(self, ranked: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that are nearer to the node than to any chosen before; filled up with the best left out."""
        chosen: list[int] = []
        left: list[int] = []
        for s, v in ranked:
            if len(chosen) >= most:
                break
            if chosen and float((self.x[chosen] @ self.x[v]).max()) > s:
                left.append(v)
            else:
                chosen.append(v)
        return chosen + left[:most - len(chosen)]

    def _descend(self, q: np.ndarray, to: int) -> list[int]:
        """Greedy walk from the entry down to the layer above ``to``."""
        at = self.entry
        for layer in range(int(self.level[self.entry]), to, -1):
            at = self._beam(q, [at], 1, layer)[0][1]
        return [at]

    def _insert(self, i: int) -> None:
        q, top = self.x[i], int(self.level[i])
        start = self._descend(q, top)
        for layer in range(min(top, int(self.level[self.entry])), -1, -1):
            ranked = self._beam(q, start, BUILD_BEAM, layer)
            most = DEGREE * (2 if layer == 0 else 1)
            mine = self._choose(ranked, DEGREE)
            self.edges[i][layer] = np.array(mine, dtype=np.int32)
            for v in mine:
                theirs = np.append(self.edges[v][layer], np.int32(i))
                if len(theirs) > most:
                    sims = self.x[theirs] @ self.x[v]
                    order = np.argsort(-sims)
                    theirs = np.array(self._choose([(float(sims[k]), int(theirs[k])) for k in order], most), dtype=np.int32)
                self.edges[v][layer] = theirs
            start = [v for _, v in ranked]
        if top > self.level[self.entry]:
            self.entry = i

    def near(self, q: np.ndarray, least: float, width: int, margin: float) -> np.ndarray:
        """Nodes found with cosine ``least`` or more."""
        best = self._beam(q, self._descend(q, 0), width, 0)
        seen = np.zeros(len(self.x), dtype=bool)
        inside = [v for s, v in best if s >= least - margin]
        if not inside:
            return np.zeros(0, dtype=np.int64)
        seen[inside] = True
        front = np.array(inside)
        while len(front):
            around = np.unique(np.concatenate([self.edges[v][0] for v in front.tolist()]))
            around = around[~seen[around]]
            around = around[self.x[around] @ q >= least - margin]
            seen[around] = True
            front = around
        found = np.flatnonzero(seen)
        return found[self.x[found] @ q >= least]


def search(graph: Graph, queries: np.ndarray, own: np.ndarray, least: float, goal: float = GOAL) -> list[np.ndarray]:
    """Per query the graph's nodes at ``least`` or more; the beam widens until the audit passes.

    ``own`` is each query's own node in the graph, or -1. Audited are ``AUDIT`` queries that have a partner besides themselves, or
    all that have one, told by exact comparison of as many queries as that takes. Recall is the average over these queries,
    so one dense group does not outweigh lone pairs.
    """
    audited = []
    order = np.random.default_rng(len(queries)).permutation(len(queries))
    for at in range(0, len(order), 256):
        some = order[at:at + 256]
        near = graph.x @ queries[some].T >= least
        near[own[some][own[some] >= 0], np.flatnonzero(own[some] >= 0)] = False
        audited.extend((int(k), np.flatnonzero(near[:, i])) for i, k in enumerate(some) if near[:, i].any())
        if len(audited) >= AUDIT:
            break
    width, margin = BEAM, 0.06
    while width < len(graph.x):
        found = [len(np.intersect1d(t, graph.near(queries[k], least, width, margin))) / len(t) for k, t in audited]
        if not found or np.mean(found) >= goal:
            return [graph.near(q, least, width, margin) for q in queries]
        width, margin = 2 * width, margin + 0.06
    return [np.flatnonzero(graph.x @ q >= least) for q in queries]


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked numbers the least label around, in place, until nothing changes."""
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            return
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def unit(frame: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in frame])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` per row of ``vectors``.

    Rows link within a label only, at cosine ``least`` or more. Rows whose id, label or vector is null, and vectors that
    are empty, zero or hold null or non-finite numbers, link with nothing: no links, their own component, kept.
    Vectors of another length than a label's others form a group of their own. Repeated rows count as vectors each.
    Extra columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    clean = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & clean, F.lit(False))
    rows = rows.withColumn("mark", F.when(valid, F.xxhash64("label", "v")))
    classes = cut_lineage(rows.filter(valid).groupBy("mark", F.struct("label", F.size("v").alias("width")).alias("group"), "v").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size")).withColumn("node", F.monotonically_increasing_id()))
    sizes = classes.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = classes.select("group", "node", "size", "v").join(sizes, "group").withColumn(
        "shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    group_type = classes.schema["group"].dataType.simpleString()

    def build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        data = pickle.dumps((frame["node"].to_numpy(), frame["size"].to_numpy(), Graph(unit(frame["v"]))))
        return pd.DataFrame({"group": [key[0]], "shard": [key[1]], "blocks": [int(frame["blocks"].iloc[0])], "graph": [data]})

    graphs = cut_lineage(dealt.groupBy("group", "shard").applyInPandas(build, f"group {group_type}, shard int, blocks int, graph binary"))

    def query(frame: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(frame) or not len(index):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        nodes, weight, graph = pickle.loads(index["graph"].iloc[0])
        mine = frame["node"].to_numpy()
        every = np.unique(np.concatenate([nodes, mine]))
        label = np.arange(len(every))
        at_node, at_mine = np.searchsorted(every, nodes), np.searchsorted(every, mine)
        links = np.zeros(len(mine), dtype=np.int64)
        held, count = [], 0
        order = np.argsort(nodes)
        at = np.minimum(np.searchsorted(nodes, mine, sorter=order), len(nodes) - 1)
        found = search(graph, unit(frame["v"]), np.where(nodes[order[at]] == mine, order[at], -1), least)
        for i, hits in enumerate(found):
            hits = hits[nodes[hits] != mine[i]]
            links[i] = weight[hits].sum()
            held.append((np.full(len(hits), at_mine[i]), at_node[hits]))
            count += len(hits)
            if count > 1_000_000 or i == len(found) - 1:
                _unite(label, np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
                held, count = [], 0
        own = np.zeros(len(every), dtype=np.int64)
        own[at_mine] = links
        keep = (label != np.arange(len(every))) | (own > 0)
        return pd.DataFrame({"node": every[keep], "links": own[keep], "root": every[label[keep]]})

    asked = dealt.select("group", "block", "node", "v", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    told = graphs.select("group", "shard", "graph", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    found = cut_lineage(asked.groupBy("group", "shard", "block").cogroup(told.groupBy("group", "shard", "block")).applyInPandas(
        query, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found, "node", "root")
    placed = classes.join(links, "node", "left").join(roots, "node", "left").select(
        "mark", "v", "group", "least", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    placed = cut_lineage(placed)
    least_of = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = placed.join(least_of, "root").select("mark", F.col("v").alias("w"), F.col("group.label").alias("of"), "n_links", "component_id")
    joined = rows.join(answer, (rows["mark"] == answer["mark"]) & (rows["v"] == answer["w"]) & (rows["label"] == answer["of"]), "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
