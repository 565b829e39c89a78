"""SimHash fingerprints and near-duplicate groups through pivot distance tables.

A fingerprint is the bitwise majority of the 64-bit hashes of a text's word shingles. Two fingerprints link when
at most ``bits`` bits differ. A pair that close agrees on whole blocks of the fingerprint (with five blocks, on two
at least when three bits differ), so pairs are only looked for among fingerprints that share such blocks: an
equi-join key, no cross join. Inside such a bucket the distances to many fixed reference fingerprints, the pivots,
form a table; by the triangle inequality a pair whose distances to any pivot differ by more than ``bits`` is
discarded without being compared, and only the survivors' exact distance is taken.

Pairs are not emitted: a bucket returns a spanning forest of its links, which carries the same components.

``similar_texts`` looks further: texts that share four fifths of their word runs differ in more bits than whole blocks can
promise, so fingerprints only propose links there and an equi-join on each text's least common runs finds all others.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import arrow_stage, cut_lineage
from pelagia.llm.graph import components
from pelagia.session import at_most, discard

SEED = 42
#: Number of reference fingerprints in the distance table.
PIVOTS = 48
#: Most fingerprints of one bucket in one task; larger buckets are dealt out in pairs of chunks.
BUCKET = 4096
#: Common runs that are put last, at most; the order of the others does not matter.
COMMON = 1 << 20
#: Slots of the hash space in the sketch of a text that joined pairs are sieved by.
SLOTS = 1024
#: Members up to which all pairs of a run are sent on: at most half as many pairs for each member.
SMALL = 12
#: Rows up to which a table is broadcast.
FEW = 500_000


def fingerprint(text: str | None, shingle: int) -> int:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return 0
    if n <= shingle:
        grams = [b" ".join(found)]
    else:
        grams = map(b" ".join, zip(*(found[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):  # bits of so many hashes at a time
        part = hashes[i:i + 65_536]
        ones += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id``, ``fp`` (the unsigned fingerprint's bits in a long) per row of ``docs``.

    Texts are lower-cased in A-Z and cut at the six ASCII white-space characters. A text with fewer words than a
    shingle is one shingle; an empty or null text has fingerprint zero.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_stage(plain, step, "id long, fp long")


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints: hashes of their own numbers."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), SEED) for i in range(count)], dtype=np.uint64)


def forest(values: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest (index pairs) of the links at ``bits`` or fewer differing bits.

    Breadth first: every fingerprint meets those not reached yet once. Memory is one row of the pivot table per
    fingerprint, whatever the number of links.
    """
    edges: list[tuple[int, int]] = []
    distances = np.bitwise_count(values[:, None] ^ pivots()[None, :]).astype(np.int8)
    rest = np.arange(len(values))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = rest
            for lo in range(0, PIVOTS, 12):  # the first pivots discard most; the others see what is left
                gap = np.abs(distances[near, lo:lo + 12] - distances[at, lo:lo + 12]).max(axis=1)
                near = near[gap <= bits]
                if not len(near):
                    break
            if len(near):
                near = near[np.bitwise_count(values[near] ^ values[at]) <= bits]
            if len(near):
                edges.extend((at, int(x)) for x in near)
                queue.extend(int(x) for x in near)
                rest = np.setdiff1d(rest, near, assume_unique=True)
    return edges


def pair_within(pairs: np.ndarray, bits: int) -> np.ndarray:
    """Which of many (n x 2) pairs differ in at most ``bits`` bits: discarded by pivots first, then verified."""
    live = np.arange(len(pairs))
    for p in pivots():
        if not len(live):
            break
        gap = np.bitwise_count(pairs[live, 0] ^ p).astype(np.int8) - np.bitwise_count(pairs[live, 1] ^ p).astype(np.int8)
        live = live[np.abs(gap) <= bits]
    good = np.zeros(len(pairs), dtype=bool)
    good[live] = np.bitwise_count(pairs[live, 0] ^ pairs[live, 1]) <= bits
    return good


def block_masks(bits: int) -> list[int]:
    """Pairs of whole blocks, on one of which two fingerprints at ``bits`` or fewer differing bits agree for certain."""
    edge = [i * 64 // (bits + 2) for i in range(bits + 3)]
    return [sum((1 << edge[i + 1]) - (1 << edge[i]) for i in pair) for pair in itertools.combinations(range(bits + 2), 2)]


def links(distinct: DataFrame, bits: int = 3, bucket: int = BUCKET) -> DataFrame:
    """``a``, ``b``: links between fingerprints (column ``fp``, distinct) that span all groups at ``bits`` bits.

    Buckets are pairs of whole blocks and no link is lost. A bucket with more than ``bucket`` members is split into
    chunks and every pair of chunks is a group of its own, so no group is unbounded.
    """
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in block_masks(bits)]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("part", "key"))
    sizes = keyed.groupBy("part", "key").count().filter("count > 1").select(
        "part", "key", F.ceil(F.col("count") / bucket).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    dealt = keyed.join(sizes, ["part", "key"]).withColumn("own", own).select(
        "part", "key", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.struct(
            F.least(F.col("own"), other).alias("i"), F.greatest(F.col("own"), other).alias("j")))).alias("of"))
    groups = dealt.groupBy("part", "key", "of").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            twos = np.array([f for f in frame["fps"] if len(f) == 2], dtype=np.int64).reshape(-1, 2)
            close = pair_within(twos.view(np.uint64), bits)
            found.extend(map(tuple, twos[close].tolist()))
            for fps in frame["fps"]:
                if len(fps) == 2:
                    continue
                values = np.asarray(fps, dtype=np.int64)
                found.extend((values[i], values[j]) for i, j in forest(values.view(np.uint64), bits))
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return groups.mapInPandas(step, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """``id``, ``fingerprint`` (16 hex digits), ``component_id`` per row of ``docs``.

    ``component_id`` is the least id reachable over links, the row's own included. Repeated rows each come back;
    a row with a null id is grouped by its text, and a group of null ids only has a null component. Empty texts share
    fingerprint zero. Extra columns are ignored; an empty table gives no rows.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    found = grouped(rows, distinct, components(links(distinct.select("fp"), bits)))
    return found.select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(rows: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (``id``, ``fp``) with ``root`` and ``component_id``, given each fingerprint's least id and the parts (``node``, ``root``)."""
    rooted = cut_lineage(distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp")


def runs_of(text: str | None, width: int) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of the runs of ``width`` words, A-Z lower-cased; shorter texts are one run."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(found) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found, itertools.repeat(SEED)), dtype=np.uint64, count=len(found))
    n = len(found) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = (out ^ hashes[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def node_of(runs: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(runs.tobytes(), SEED)


def signed(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), signed(np.concatenate(arrays)))


def common_runs(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs met in several of every eighth text, ascending, and how often.

    They only decide which runs come last in the order of ``similar_texts``; its result is the same without them.
    """
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([signed(np.concatenate([runs_of(t.as_py(), width) for t in batch.column(0)]))], ["run"])

    some = texts.filter(F.pmod(F.xxhash64("id", "text"), F.lit(8)) == 0).select("text")
    counts = cut_lineage(arrow_stage(some, step, "run long").groupBy("run").count().filter("count >= 3"))
    least, left = 3, COMMON
    for r in sorted(counts.groupBy("count").agg(F.count(F.lit(1)).alias("runs")).collect(), key=lambda r: -r["count"]):
        left -= r["runs"]
        if left < 0:
            least = r["count"] + 1
            break
    found = counts.filter(F.col("count") >= least).toArrow()
    runs, often = found["run"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(runs)
    return runs[order], often[order]


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) of run sets whose Jaccard similarity is ``least`` or more."""
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs = [runs_of(t.as_py(), width) for t in batch.column(0)]
        return pa.RecordBatch.from_arrays([signed([node_of(r) for r in runs]), lists(runs)], ["node", "runs"])

    ends = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    shown = arrow_stage(texts.select("text"), step, "node long, runs array<long>").join(few(ends), "node")
    runs = cut_lineage(shown.groupBy("node").agg(F.first("runs").alias("runs")))
    both = pairs.join(runs.select(F.col("node").alias("a"), F.col("runs").alias("x")), "a").join(
        runs.select(F.col("node").alias("b"), F.col("runs").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    good = cut_lineage(both.filter(shared >= least * (F.size("x") + F.size("y") - shared)).select("a", "b"))
    discard(ends)
    return good


def parity(runs: np.ndarray, slots: int) -> np.ndarray:
    """Per slot of the hash space (a power of two of them), whether an odd number of the runs lies in it, as words of bits."""
    odd = np.bincount((runs >> np.uint64(32)).astype(np.int64) % slots, minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def slots_for(n: int) -> int:
    """Slots of the sketch of ``n`` runs: enough that texts without common runs differ in far more of them than similar ones."""
    return max(64, 1 << max(n - 1, 1).bit_length())


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The same sketch over fewer slots."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def sieved(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` that may be similar: their run sets differ at least in as many runs as parities, and no pair with
    more than (1 - least) / (1 + least) of both sizes of differing runs is similar. None that is similar is lost."""
    x = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("odd").alias("x"))
    y = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("y"))
    differ = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + c)
    return pairs.join(x, "a").join(y, "b").filter((F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-6) & (
        differ <= (1 - least) / (1 + least) * (F.col("na") + F.col("nb")) + 1e-6)).select("a", "b")


def few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if at_most(table, FEW) else table


def ordered_pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def proposals(rows: DataFrame) -> DataFrame:
    """``a``, ``b``: texts whose fingerprints are equal or linked at three bits."""
    of = cut_lineage(rows.groupBy("fp").agg(F.min("node").alias("m")))
    near = links(of.select("fp"), 3)
    near = near.join(of.select(F.col("fp").alias("a"), F.col("m").alias("x")), "a").join(of.select(F.col("fp").alias("b"), F.col("m").alias("y")), "b")
    same = rows.select("fp", "node").distinct().join(of, "fp").select(F.col("node").alias("x"), F.col("m").alias("y"))
    return near.select("x", "y").union(same).filter("x <> y").select(*ordered_pair("x", "y"))


def turn(a: np.ndarray, b: np.ndarray, among: int) -> np.ndarray:
    """A number from 0 up to ``among`` that a pair of nodes has for good, evenly spread."""
    x = (a ^ b).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.float64) * (among / 2.0 ** 32)


def near_pairs(texts: dict[str, np.ndarray], sketches: list[np.ndarray], two: bool, among: int, least: float, low: int, high: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of a group that may be similar, lie in two parts and have a turn from ``low`` to below ``high``; whether later ones are left.

    ``texts`` has ``node``, ``n``, ``pos``, ``root``, ``side``; ``among`` is the number of the run's members. With ``two``, members of one side are not compared.
    Two texts that share a run first at ``pos`` share no more than that and what follows it in both; and they differ at least in as
    many runs as in parities. Neither loses a similar pair. A pair is looked at from its shorter sketch.
    """
    node, n, pos, root, side = (texts[c] for c in ("node", "n", "pos", "root", "side"))
    words = np.array([len(x) for x in sketches])
    share = least / (1 + least)
    left, right, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], False
    for size in np.unique(words):
        members = np.flatnonzero(words >= size)
        table = np.stack([folded(sketches[i], size) for i in members])
        for k in np.flatnonzero(words == size):
            may = (root[members] != root[k]) & (np.minimum(n[members] - pos[members], n[k] - pos[k]) >= share * (n[members] + n[k]) - 1e-6)
            may &= (np.minimum(n[members], n[k]) >= least * np.maximum(n[members], n[k]) - 1e-6) & ((words[members] > size) | (members > k))
            if two:
                may &= side[members] != side[k]
            others = np.flatnonzero(may)
            if len(others):
                differ = np.bitwise_count(table[others] ^ folded(sketches[k], size)).sum(axis=1)
                others = others[differ <= (1 - least) / (1 + least) * (n[members[others]] + n[k]) + 1e-6]
            other = node[members[others]]
            when = turn(other, node[k], among)
            more |= bool((when >= high).any())
            other = other[(when >= low) & (when < high)]
            left.append(np.minimum(other, node[k]))
            right.append(np.maximum(other, node[k]))
    return np.concatenate(left), np.concatenate(right), more


def small_pairs(met: DataFrame, least: float) -> DataFrame:
    """``a``, ``b``: as ``apart``, all turns at once, for runs with at most ``SMALL`` members."""
    some = met.groupBy("run").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter(
        (F.col("m") <= SMALL) & (F.col("lo") < F.col("hi"))).select("run")
    texts = met.join(some, "run").groupBy("run").agg(F.collect_list(F.struct("node", "n", "pos", "root")).alias("texts"))
    share = least / (1 + least)

    def may(x: Column, y: Column) -> Column:
        left = lambda t: t["n"] - t["pos"]
        return (x["node"] < y["node"]) & (x["root"] != y["root"]) & (F.least(left(x), left(y)) >= share * (x["n"] + y["n"]) - 1e-6) & (
            F.least(x["n"], y["n"]) >= least * F.greatest(x["n"], y["n"]) - 1e-6)

    pairs = F.flatten(F.transform("texts", lambda x: F.transform(F.filter("texts", lambda y: may(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    return texts.select(F.inline(pairs)).distinct()


def apart(met: DataFrame, sketches: DataFrame, least: float, bucket: int, low: int, high: int) -> DataFrame:
    """``a``, ``b``: pairs that may be similar, share a run of ``met``, lie in two parts (``root``) and whose turn comes from ``low`` to
    below ``high``; a row of nulls where later turns are left. Runs with at most ``SMALL`` members are left to ``small_pairs``.

    ``met`` has ``run``, ``node``, the text's number of runs ``n``, the run's place ``pos`` in its order and ``root``. Members of a
    run's largest part are only compared with the others, in blocks of at most ``bucket`` of each; the others are also
    compared among themselves. A row is so sent once for each block of the others, not once for each block of its own part.
    """
    parts = met.groupBy("run", "root").agg(F.count(F.lit(1)).alias("m"))
    chunks = lambda c: F.greatest(F.ceil(c / bucket), F.lit(1)).cast("int")
    sizes = parts.groupBy("run").agg(F.max_by("root", F.struct("m", "root")).alias("top"), F.max("m").alias("m"), F.sum("m").alias("all")).filter(
        (F.col("all") > F.col("m")) & (F.col("all") > SMALL)).select("run", "top", "all", chunks(F.col("m")).alias("ours"), chunks(F.col("all") - F.col("m")).alias("others"))
    live = met.join(few(cut_lineage(sizes)), "run")
    place = lambda c: F.pmod(F.xxhash64("node", F.lit(7)), c).cast("int")
    upto = lambda c: F.sequence(F.lit(0), c - 1)
    block = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    big, mine = F.col("root") == F.col("top"), place(F.col("others"))
    blocks = F.when(big, F.transform(upto(F.col("others")), lambda j: block("across", place(F.col("ours")), j))).otherwise(F.concat(
        F.transform(upto(F.col("ours")), lambda i: block("across", i, mine)),
        F.transform(upto(F.col("others")), lambda j: block("among", F.least(mine, j), F.greatest(mine, j)))))
    side = F.when(F.col("of.kind") == "across", big.cast("int")).otherwise(mine)
    dealt = live.withColumn("of", F.explode(blocks)).select("run", "of", "all", "node", "n", "pos", "root", side.alias("side"))
    texts = dealt.join(sketches.select("node", F.col("wide").alias("odd")), "node")
    groups = texts.groupBy("run", "of").agg(F.first("all").alias("all"), F.collect_list(F.struct("node", "n", "pos", "root", "side", "odd")).alias("texts")).filter(F.size("texts") > 1).select(
        ((F.col("of.kind") == "across") | (F.col("of.i") < F.col("of.j"))).alias("two"), "all", *[F.col("texts")[c].alias(c) for c in ("node", "n", "pos", "root", "side", "odd")])

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            left, right, beyond = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], False
            for two, among, *columns, odd in frame.itertuples(index=False, name=None):
                held = dict(zip(("node", "n", "pos", "root", "side"), (np.asarray(c, dtype=np.int64) for c in columns)))
                x, y, more = near_pairs(held, [np.asarray(o, dtype=np.int64).view(np.uint64) for o in odd], two, among, least, low, high)
                left.append(x)
                right.append(y)
                beyond |= more
            found = pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)}, dtype="Int64")
            yield pd.concat([found, pd.DataFrame({"a": [pd.NA], "b": [pd.NA]}, dtype="Int64")]) if beyond else found

    return groups.mapInPandas(step, "a long, b long").distinct()


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8,
                  bucket: int = 1024, reach: int = 512) -> DataFrame:
    """``id``, ``digest`` (of the text: xxhash64), ``root``, ``component_id`` per row of ``docs``: texts linked at Jaccard similarity ``least`` of
    their ``width``-word runs; ``root`` names the group, ``component_id`` is the least id in it.

    No link is lost: in one order of all runs, common ones last, two similar texts share one of the first
    n - least * n + 1 of a text's n runs. Fingerprints at three bits, and the least and greatest text of each shared
    run, propose pairs first; what they link need not be compared again. Every pair that still lies in two parts is, in rounds:
    every pair has a turn for good, spread evenly over a run's members; a round tests the first ``reach`` turns (then 64 times as many,
    and so on) and joins the parts it links, so the first sends some ``reach`` pairs for each member, and most pairs never need a test. Pairs
    are sieved by sketches that reject no similar one and verified on the whole run sets. Nulls, repeats and
    empty texts as in ``near_duplicates``; rows that repeat an id with another text are texts of their own.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    common, often = common_runs(texts, width)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, nodes, sizes, odd, wide, firsts = [], [], [], [], [], []
        for t in batch.column(1):
            runs = runs_of(t.as_py(), width)
            n = len(runs)
            order = np.arange(n)
            if len(common):
                at = np.minimum(np.searchsorted(common, runs), len(common) - 1)
                order = np.argsort(np.where(common[at] == runs, often[at], 0), kind="stable")
            firsts.append(runs[order[:n - int(np.ceil(least * n - 1e-6)) + 1]])
            fps.append(fingerprint(t.as_py(), 3))
            nodes.append(node_of(runs))
            sizes.append(n)
            odd.append(parity(runs, SLOTS))
            wide.append(parity(runs, slots_for(n)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), signed(fps), signed(nodes), pa.array(sizes, pa.int32()), lists(odd), lists(wide), lists(firsts)],
                                          ["id", "digest", "fp", "node", "n", "odd", "wide", "firsts"])

    rows = cut_lineage(arrow_stage(texts.withColumn("digest", F.xxhash64("text")), step,
                                   "id long, digest long, fp long, node long, n int, odd array<long>, wide array<long>, firsts array<long>"))
    entries = rows.select("node", "n", F.posexplode("firsts").alias("pos", "run"))
    shared = cut_lineage(entries.groupBy("run").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi"))
    met = cut_lineage(entries.join(few(shared), "run").groupBy("run", "node").agg(*[F.min(c).alias(c) for c in ("n", "pos", "lo", "hi")]))
    discard(shared)
    stars = met.select("node", F.explode(F.array("lo", "hi")).alias("centre")).filter("node <> centre").select(*ordered_pair("node", "centre"))
    sketches = cut_lineage(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "odd", "wide")]))
    tested = cut_lineage(sieved(stars.union(proposals(rows)).distinct(), sketches, least))
    linked = verified(tested, texts, width, least)
    met = met.select("run", "node", "n", "pos")
    parts = components(linked)
    labelled = cut_lineage(met.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node")))
    low, high = 0, reach
    while True:
        found = apart(labelled, sketches, least, bucket, low, high)
        found = cut_lineage(found if low else found.union(small_pairs(labelled, least)))
        more = cut_lineage(sieved(found.filter("a is not null").distinct(), sketches, least).join(tested, ["a", "b"], "left_anti"))
        new = None if at_most(more, 0) else verified(more, texts, width, least)
        if new is not None and not at_most(new, 0):  # parts change only with new links
            linked = cut_lineage(linked.union(new))
            parts = None
        last = at_most(found.filter("a is null"), 0)
        discard(found)
        discard(more)
        if last:
            break
        if not low or parts is None:
            if not low:  # small runs are done
                large = met.groupBy("run").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > SMALL).select("run")
                met = cut_lineage(met.join(large, "run"))
            parts = components(linked) if parts is None else parts
            old, labelled = labelled, cut_lineage(met.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node")))
            discard(old)
        low, high = high, 64 * high
    rows = rows.select("id", "digest", F.col("node").alias("fp"))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    return grouped(rows, distinct, components(linked) if parts is None else parts)
