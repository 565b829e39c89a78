"""Ranked lexical search by bag deduplication: equal documents, seen through the queries' words, are scored once.

For a block of items (the queries) a document is restricted to the block's words. What is left, the term frequencies and
the length measure m, decides the score for every item, so documents with the same restricted bag form a class. Bags are
grouped by their hash and by the bag itself, which verifies that members are identical. A class is scored once for all items of the
block with exact integers; a task keeps only the best classes of each item, ordered by score and least id of a member,
since a document among the best ``top`` lies in one of the best ``top`` classes of that order. Only then are members expanded,
by ascending id and at most ``top`` of each class.

Documents are read once for each block, and a block is a bounded number of items, so a task holds a block's words and its best
classes. Document frequencies count all documents: a class counts with the number of its members.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagia.llm.common import arrow_stage, cut_lineage

#: What a byte of a UTF-8 text is in a term: letters lower-cased, digits and bytes of characters from U+0080 on as they are; the rest parts terms.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Items of a block on average; their number of blocks grows with the items.
ITEMS = 2000
#: Classes scored at a time in a task.
CLASSES = 512
#: Products of a class's entry and an item added up at a time.
PRODUCTS = 500_000
#: Columns of a class that is among an item's best.
COLUMNS = ["item", "score", "m", "least", "terms", "tfs"]
LAST = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters from U+0080 on, A-Z lower-cased, in UTF-8; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(BYTES).split()


def restricted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``id``, ``n`` (terms with repeats), ``terms`` (numbers, ascending), ``tfs`` per row of ``docs`` (``id``, ``text``)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, ends, numbers, often = [], [0], [], []
        for text in batch.column(1):
            found = terms(text.as_py())
            bag = Counter(map(vocabulary.get, found))
            bag.pop(None, None)
            kept = sorted(bag)
            numbers.extend(kept)
            often.extend(map(bag.__getitem__, kept))
            sizes.append(len(found))
            ends.append(len(numbers))
        cuts = pa.array(ends, pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(cuts, pa.array(numbers, pa.int32())),
                                           pa.ListArray.from_arrays(cuts, pa.array(often, pa.int32()))], ["id", "n", "terms", "tfs"])

    return arrow_stage(docs, step, "id long, n long, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Items:
    """Items of a block by term: which items ask for it and how often."""

    def __init__(self, asked: list[tuple[int, dict[int, int]]], size: int, weights: np.ndarray):
        self.ids = [i for i, _ in asked]
        found = sorted((t, k, q) for k, (_, bag) in enumerate(asked) for t, q in bag.items())
        by_term = np.array([t for t, _, _ in found], dtype=np.int64)
        self.start = np.searchsorted(by_term, np.arange(size + 1))
        self.item = np.array([k for _, k, _ in found], dtype=np.int64)
        # how often an item repeats a term times the term's weight
        self.gain = np.array([q for _, _, q in found], dtype=np.int64) * weights[by_term]

    def scores(self, m: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Scores (class by item), in exact integers, of classes given by their entries (``owner``, ``term``, ``tf``)."""
        part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[owner])
        count = self.start[term + 1] - self.start[term]
        done = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(len(m) * len(self.ids), dtype=np.int64)
        cuts = np.searchsorted(done, np.arange(0, done[-1], PRODUCTS))
        for a, b in zip(cuts, [*cuts[1:], len(term)]):
            entry = np.repeat(np.arange(a, b), count[a:b])
            place = np.arange(done[a], done[b]) - (done[entry] - self.start[term[entry]])
            np.add.at(out, owner[entry] * len(self.ids) + self.item[place], self.gain[place] * part[entry])
        return out.reshape(len(m), len(self.ids))


def best_classes(classes: DataFrame, items: Items, top: int) -> DataFrame:
    """``item`` (number in the block), ``score`` and the class (``m``, ``terms``, ``tfs``, ``least``): the best of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        floor = np.ones(len(items.ids), dtype=np.int64)  # the least score that can still be among an item's best
        for whole in batches:
            for at in range(0, whole.num_rows, CLASSES):
                batch = whole.slice(at, CLASSES)
                m, _, lists, often = batch.columns
                sizes = lists.value_lengths().to_numpy()
                score = items.scores(m.to_numpy(), np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy().astype(np.int64), often.flatten().to_numpy().astype(np.int64))
                row, item = np.nonzero(score >= floor)
                if not len(row):
                    continue
                new = pa.table([pa.array(item.astype(np.int32)), pa.array(score[row, item]), *batch.take(pa.array(row)).columns], COLUMNS)
                best, floor = _best(new if best is None else pa.concat_tables([best, new]), len(items.ids), top)
        if best is not None:
            yield from best.to_batches()

    return classes.select(*COLUMNS[2:]).mapInArrow(run, "item int, score long, m long, least long, terms array<int>, tfs array<int>")


def _best(table: pa.Table, items: int, top: int) -> tuple[pa.Table, np.ndarray]:
    """The ``top`` classes of each item by score and least id, and each item's least score of use from now on."""
    item, score, least = (table[c].to_numpy() for c in ("item", "score", "least"))
    order = np.lexsort((least, -score, item))
    item, score = item[order], score[order]
    place = np.arange(len(item)) - np.searchsorted(item, item)
    floor = np.ones(items, dtype=np.int64)
    floor[item[place == top - 1]] = score[place == top - 1]
    return table.take(pa.array(order[place < top])).combine_chunks(), floor


def ranked(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", block: int = ITEMS) -> DataFrame:
    """``item``, ``rank`` (from 1), ``id``, ``score`` (long): the ``top`` rows of ``docs`` for each row of ``items``.

    A term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))), a document's m is 75 + 25 n N div L, and its score sums
    w ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included; N counts documents with a term and L their
    terms. Only scores above zero are listed. Equal scores are ordered by ascending id, rows without an id last; rows with the
    same id are documents of their own. An item id that is repeated, or null, is an item for each row. Null and empty
    texts have no terms. Extra columns are ignored; an empty table, of documents or of items, gives no rows.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    blocks = max(1, -(-asked.count() // block))
    out = None
    for k in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        found = _ranked_block(plain, [(r["item"], Counter(terms(r["text"]))) for r in some.toLocalIterator()], top)
        out = found if out is None else out.union(found)
    return out


def _class() -> list[Column]:
    return [F.xxhash64("terms", "tfs", "m").alias("hash"), F.col("m"), F.col("terms"), F.col("tfs")]


def _ranked_block(docs: DataFrame, asked: list[tuple[int, Counter]], top: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: k for k, t in enumerate(sorted({t for _, bag in asked for t in bag}))}
    bags = cut_lineage(restricted(docs, vocabulary).filter("n > 0"))
    whole = bags.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = whole["docs"], whole["terms"] or 1
    measured = bags.filter(F.size("terms") > 0).withColumn("m", F.lit(75).cast("long") + F.expr(f"(25L * n * {n_docs}L) div {n_terms}L"))
    members = measured.select(*_class(), "id")
    classes = cut_lineage(members.groupBy("hash", "m", "terms", "tfs").agg(F.count(F.lit(1)).alias("members"), F.min(F.coalesce("id", F.lit(LAST))).alias("least")))
    df = {r["t"]: r["df"] for r in classes.select(F.explode("terms").alias("t"), "members").groupBy("t").agg(F.sum("members").alias("df")).collect()}
    weights = np.array([weight(n_docs, df.get(t, 0)) for t in range(len(vocabulary))], dtype=np.int64)
    block = Items([(k, {vocabulary[t]: q for t, q in bag.items()}) for k, (_, bag) in enumerate(asked)], len(vocabulary), weights)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "least")
    chosen = cut_lineage(best_classes(classes, block, top).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).drop("place", "least"))
    # at most ``top`` classes for each item of the block, so they may be broadcast
    wanted = F.broadcast(chosen.select(*_class()).distinct())
    ours = Window.partitionBy("hash", "m", "terms", "tfs").orderBy(F.col("id").asc_nulls_last())
    first = members.join(wanted, ["hash", "m", "terms", "tfs"], "left_semi").withColumn("place", F.row_number().over(ours)).filter(F.col("place") <= top).drop("place")
    found = first.join(F.broadcast(chosen.select("item", "score", *_class())), ["hash", "m", "terms", "tfs"])
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    listed = found.select("item", rank.alias("rank"), "id", "score").filter(F.col("rank") <= top)
    names = F.broadcast(spark.createDataFrame([(k, i) for k, (i, _) in enumerate(asked)], "item int, name long"))
    return listed.join(names, "item").select(F.col("name").alias("item"), "rank", "id", "score")
