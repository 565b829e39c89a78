"""Repeated passages removed by distributed prefix doubling.

A byte goes when a string of ``width`` bytes over it also starts in a document with a smaller id. As in suffix sorting by
prefix doubling, the rank of a position for length 2 L is made of its ranks for length L at the position and L further
on; ranks are 64-bit fingerprints, equal where the strings are, so a document computes its own and only comparing them
needs the cluster. That is done twice, each time by sorting ranks in Spark, and positions whose rank is unique drop out
in between:

* at half the width, for the least rank in each window of that width. Equal windows have equal least ranks, so a window
  whose least rank occurs once in all documents is unique and is not looked at again;
* at the full width, which is past the threshold, for the positions that are left.

Documents are dealt into chunks by ranges of their id that hold about as many bytes each; an id with more bytes than a chunk has
chunks of its own, as have rows without an id. A chunk sends its distinct ranks as sorted lists, cut by rank range; a
range's task sorts what all chunks sent and answers each list with one bit a rank (seen elsewhere; seen in an earlier
range of ids). Lists hold a rank once however often the chunk has it, so copies and common passages stay small, and no
task holds more than a chunk or a range. Whole copies of a text are told beforehand from digests. Ranks are put in order in
place and looked up document by document or list by list, so a task holds little more than each rank once or twice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import arrow_stage, cut_lineage
from pelagia.llm.lm_score import from_planes, planes

#: Bytes of text in a chunk and bytes of text for each rank range, on average.
CHUNK_BYTES, RANGE_BYTES = 5_000_000, 12_000_000
#: Ranks that a range's task puts in order at a time, about.
SLICE = 4_000_000
#: Ranks of single bytes.
_BYTE = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), dtype="<u8").astype(np.uint64)


#: Odd multipliers of the doubling steps.
_STEPS = [int.from_bytes(hashlib.blake2b(b"step%d" % i, digest_size=8).digest(), "little") | 1 for i in range(8)]


def _pair(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """Sum of ranks of a string's two parts: linear in the ranks of its bytes, with its own factor at every place."""
    x = a * np.uint64(_STEPS[step])
    x += b
    return x


def _spread(x: np.ndarray) -> np.ndarray:
    """The same ranks spread evenly over the 64-bit range; different sums stay different."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def ranks(data: np.ndarray, lengths: list[int], at: np.ndarray | None = None) -> list[np.ndarray]:
    """Ranks of the strings of each length, lengths ascending, by doubling; at every position with room or those ``at``."""
    now, size, step, out = _BYTE[data], 1, 0, []
    for want in lengths:
        while 2 * size <= want:
            now = _pair(now[:-size], now[size:], step) if len(now) > size else now[:0]
            size, step = 2 * size, step + 1
        over = want - size
        if at is not None and over:
            whole = _pair(now[at], now[at + over], 7)
        else:
            whole = now if not over else _pair(now[:-over], now[over:], 7) if len(now) > over else now[:0]
            whole = whole if at is None else whole[at]
        out.append(_spread(whole))
    return out


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    now, size = values, 1
    while 2 * size <= width:
        now = np.minimum(now[:-size], now[size:]) if len(now) > size else now[:0]
        size *= 2
    over = width - size
    return now if not over else np.minimum(now[:-over], now[over:]) if len(now) > over else now[:0]


class Chunk:
    """Documents of a chunk in ascending id order, without whole copies of earlier ones."""

    def __init__(self, frame: pd.DataFrame, copies: set[tuple[int, str]], width: int):
        self.width, self.half = width, width // 2
        frame = frame.assign(last=frame["id"].isna()).sort_values(["last", "id"], kind="stable", ignore_index=True)
        self.ids = [None if last else int(i) for i, last in zip(frame["id"], frame["last"])]
        self.none, self.also = frame["none"].tolist(), frame["also"].tolist()
        self.data = [bytes(t) for t in frame["text"]]
        self.copy = [(i, d) in copies for i, d in zip(self.ids, frame["digest"])]

    def marks(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per document: least half-width ranks of its windows as runs (value, length)."""
        out = []
        for data, copy in zip(self.data, self.copy):
            if copy or len(data) < self.width:
                out.append((np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)))
                continue
            half = ranks(np.frombuffer(data, dtype=np.uint8), [self.half])[0]
            least = least_in_windows(half, self.width - self.half + 1)
            start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            out.append((least[start], np.diff(start, append=len(least)).astype(np.int32)))
        return out

    def candidates(self, told: np.ndarray, known: np.ndarray, runs: list) -> tuple[list[np.ndarray], np.ndarray]:
        """Per document the window starts whose mark occurs elsewhere; the full-width ranks of all of them, in that order."""
        starts = []
        for value, length in runs:
            again = told[np.searchsorted(known, value)]
            starts.append(np.flatnonzero(np.repeat(again, length)).astype(np.int32) if again.any() else np.zeros(0, dtype=np.int32))
        every, end = np.empty(sum(map(len, starts)), dtype=np.uint64), 0
        for data, at in zip(self.data, starts):
            if len(at):
                every[end:end + len(at)] = ranks(np.frombuffer(data, dtype=np.uint8), [self.width], at)[0]
                end += len(at)
        return starts, every


def _sort_out(values: np.ndarray) -> np.ndarray:
    """The distinct ``values``, ascending; the array itself is put in order."""
    values.sort()
    new = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values if new.all() else values[new]


def _ask(chunk: int, order: int, known: np.ndarray, ranges: int) -> pd.DataFrame:
    """A sorted list of ranks cut by range."""
    of = np.minimum((known >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.uint64(ranges - 1)).astype(np.int64)
    cuts = np.searchsorted(of, np.arange(ranges + 1))
    rows = [(chunk, order, r, planes(np.diff(known[cuts[r]:cuts[r + 1]], prepend=np.uint64(0)))) for r in range(ranges) if cuts[r + 1] > cuts[r]]
    return pd.DataFrame(rows, columns=["chunk", "order", "range", "data"])


def _answer(frame: pd.DataFrame, kind: int) -> pd.DataFrame:
    """One bit for each rank of each list: held by another chunk or twice (1), or by an earlier range of ids (2).

    Chunks of the same ``order`` share one range: an id with many bytes, or the documents without an id, which come after all others.
    """
    frame = frame.sort_values(["order", "chunk"], ignore_index=True)
    lists = [np.cumsum(from_planes(d), dtype=np.uint64) for d in frame["data"]]
    bits = [np.zeros(len(x), dtype=bool) for x in lists]
    low, high = min(int(x[0]) for x in lists), max(int(x[-1]) for x in lists)
    slices = -(-sum(map(len, lists)) // SLICE)
    edges = np.array([low + (high - low) * k // slices for k in range(1, slices)], dtype=np.uint64)  # ranks lie evenly in their range
    cuts = [[0, *np.searchsorted(x, edges).tolist(), len(x)] for x in lists]
    owners = frame["order"].tolist()
    for k in range(slices):
        parts = [(x[c[k]:c[k + 1]], bit[c[k]:c[k + 1]], owner) for x, bit, c, owner in zip(lists, bits, cuts, owners) if c[k + 1] > c[k]]
        every = np.concatenate([x for x, _, _ in parts]) if parts else np.zeros(0, dtype=np.uint64)
        every.sort()
        met = _sort_out(every[1:][every[1:] == every[:-1]])
        del every
        if not len(met):
            continue
        first = np.full(len(met), -1, dtype=np.int32)
        for x, bit, owner in parts:  # in the order of ids
            at = np.minimum(np.searchsorted(met, x), len(met) - 1)
            hit = met[at] == x
            bit[:] = hit
            if kind == 2:
                at = at[hit]
                before = first[at]
                first[at[before < 0]] = owner
                bit[hit] = (before >= 0) & (before < owner)
    return pd.DataFrame([(int(c), kind, int(r), np.packbits(bit).tobytes(), None, None) for c, r, bit in zip(frame["chunk"], frame["range"], bits)],
                        columns=["chunk", "kind", "range", "data", "id", "digest"])


def _told(reply: pd.DataFrame, kind: int, known: np.ndarray, ranges: int) -> np.ndarray:
    """The answers to a chunk's list, in its order."""
    of = np.minimum((known >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.uint64(ranges - 1)).astype(np.int64)
    cuts = np.searchsorted(of, np.arange(ranges + 1))
    out = np.zeros(len(known), dtype=bool)
    mine = reply[reply["kind"] == kind]
    for r, data in zip(mine["range"], mine["data"]):
        a, b = cuts[int(r)], cuts[int(r) + 1]
        out[a:b] = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=b - a).astype(bool)
    return out


class Ranges:
    """Ranges of ids in ascending order: the greatest id of each and how many chunks it has; at last, the chunks of rows without an id."""

    def __init__(self, last: np.ndarray, chunks: np.ndarray):
        self.last, self.chunks = last, chunks
        self.start = np.cumsum(chunks) - chunks

    def of(self, ids: pa.Array, digests: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Chunk and range of each row; in a range of several chunks by the text's digest."""
        none = ids.is_null().to_numpy(zero_copy_only=False)
        order = np.searchsorted(self.last, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left")
        order[none] = len(self.last)
        chunk = self.start[order]
        for k in np.flatnonzero(self.chunks[order] > 1):
            chunk[k] += int(digests[int(k)].as_py()[:15], 16) % self.chunks[order[k]]
        return chunk, order


def id_ranges(narrow: DataFrame, chunk_bytes: int) -> Ranges:
    """Ranges of about ``chunk_bytes`` of text from ``narrow`` (``id``, ``size``).

    Ids are sorted in Spark by ranges and each task closes ranges as it reads on; a row for each range comes to the driver,
    as the bounds of any range partitioning do.
    """
    sized = narrow.filter("id is not null").groupBy("id").agg(F.sum("size").alias("size"))
    total, none = narrow.agg(F.sum(F.when(F.col("id").isNotNull(), F.col("size"))), F.sum(F.when(F.col("id").isNull(), F.col("size")))).first()

    def close(batches):
        last, held, out = None, 0, []
        for batch in batches:
            for i, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and held + size > chunk_bytes:
                    out.append((last, 1))
                    held = 0
                if size > chunk_bytes:
                    out.append((i, -(-size // chunk_bytes)))
                    held = 0
                else:
                    held += size
                last = i
        if last is not None and (not out or out[-1][0] != last):
            out.append((last, 1))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([n for _, n in out], pa.int64())], ["last", "chunks"])

    parts = max(1, -(-(total or 0) // (64 * chunk_bytes)))
    found = sorted(map(tuple, sized.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(close, "last long, chunks long").collect()))
    chunks = [n for _, n in found] + [max(1, -(-(none or 0) // chunk_bytes))]
    return Ranges(np.array([i for i, _ in found], dtype=np.int64), np.array(chunks, dtype=np.int64))


def _remaining(chunk: Chunk, starts: list[np.ndarray], every: np.ndarray, known: np.ndarray, earlier: np.ndarray) -> pd.DataFrame:
    width, rows, end = chunk.width, [], 0
    # the first document of the chunk that has a rank; documents are in id order, those without id last
    first = np.full(len(known), -1, dtype=np.int32)
    ids = np.array([np.iinfo(np.int64).max if i is None else i for i in chunk.ids], dtype=np.int64)
    for k, (doc, data, copy, at) in enumerate(zip(chunk.ids, chunk.data, chunk.copy, starts)):
        n = len(data)
        if copy and n >= width:
            rows.append((doc, n, [0], [n], b""))
            continue
        if len(at):
            rank = np.searchsorted(known, every[end:end + len(at)])
            end += len(at)
            first[rank[first[rank] < 0]] = k
            at = at[earlier[rank] | (ids[first[rank]] < ids[k])]
        if not len(at):
            rows.append((doc, n, [], [], data))
            continue
        step = np.zeros(n + 1, dtype=np.int32)
        step[at] += 1
        step[at + width] -= 1
        cover = np.cumsum(step[:n]) > 0
        edge = np.flatnonzero(np.diff(cover.astype(np.int8), prepend=0, append=0))
        rows.append((doc, n, edge[::2].tolist(), edge[1::2].tolist(), np.frombuffer(data, dtype=np.uint8)[~cover].tobytes()))
    out = pd.DataFrame(rows, columns=["id", "n_bytes", "starts", "ends", "kept"])
    out["id"] = out["id"].astype("Int64")
    return out


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), as_text: bool = False,
                   chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``id``, ``n_bytes``, ``starts``, ``ends`` (removed runs, maximal), ``kept`` (the other bytes) per row of ``docs``.

    ``carry`` names columns to take along. With ``as_text``, ``kept`` is a string, without the rest of characters that a
    removed run cuts; a null text stays null then.

    Null texts are empty. Rows of one id do not remove each other's bytes, nor their own; rows with a null id count as
    later than all others and not as earlier than any. Texts shorter than ``width`` stay whole. Extra columns are ignored;
    an empty table gives no rows.
    """
    taken = docs.select(*carry).schema
    also = F.to_json(F.struct(*[F.col(c) for c in carry])) if carry else F.lit(None).cast("string")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
                        F.col(text_col).isNull().alias("none"), also.alias("also"))
    plain = plain.withColumn("digest", F.md5("text"))
    narrow = cut_lineage(plain.select("id", "digest", F.octet_length("text").cast("long").alias("size")))
    total = narrow.agg(F.sum("size")).first()[0]
    ranges, of_ids = max(1, -(-(total or 0) // range_bytes)), id_ranges(narrow, chunk_bytes)
    chunks = int(of_ids.chunks.sum())

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        chunk, order = of_ids.of(batch.column("id"), batch.column("digest"))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk, pa.int32()), pa.array(order, pa.int32())], [*batch.schema.names, "chunk", "order"])

    dealt = arrow_stage(plain, deal, "id long, text binary, none boolean, also string, digest string, chunk int, order int").repartition(chunks, "chunk")
    firsts = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    copies = arrow_stage(narrow.join(firsts, "digest").filter("id > first").select("id", "digest").distinct(), deal, "id long, digest string, chunk int, order int").select(
        "chunk", F.lit(0).alias("kind"), F.lit(0).alias("range"), F.lit(None).cast("binary").alias("data"), "id", "digest")

    def parts(frame: pd.DataFrame, reply: pd.DataFrame) -> tuple[Chunk, list, np.ndarray, np.ndarray]:
        """The chunk, its marks, the distinct ones, and which of those occur more than once in it."""
        copies = reply[reply["kind"] == 0]
        chunk = Chunk(frame, set(zip(copies["id"].astype("int64"), copies["digest"])), width)
        runs = chunk.marks()
        known, count = np.unique(np.concatenate([v for v, _ in runs]), return_counts=True)
        return chunk, runs, known, count > 1

    def windows_of(frame: pd.DataFrame, reply: pd.DataFrame) -> tuple[Chunk, list, np.ndarray]:
        """The chunk, its documents' windows that may occur elsewhere, and their ranks."""
        chunk, runs, known, twice = parts(frame, reply)
        return chunk, *chunk.candidates(_told(reply, 1, known, ranges) | twice, known, runs)

    def ask_marks(frame: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return _ask(0, 0, np.zeros(0, dtype=np.uint64), ranges)
        return _ask(int(frame["chunk"].iloc[0]), int(frame["order"].iloc[0]), parts(frame, reply)[2], ranges)

    def ask_windows(frame: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return _ask(0, 0, np.zeros(0, dtype=np.uint64), ranges)
        return _ask(int(frame["chunk"].iloc[0]), int(frame["order"].iloc[0]), _sort_out(windows_of(frame, reply)[2]), ranges)

    def finish(frame: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["id", "n_bytes", "starts", "ends", "kept", "also"])
        chunk, starts, every = windows_of(frame, reply)
        windows = _sort_out(every.copy())
        out = _remaining(chunk, starts, every, windows, _told(reply, 2, windows, ranges))
        if as_text:
            out["kept"] = [None if none else k.decode("utf-8", "ignore") for k, none in zip(out["kept"], chunk.none)]
        return out.assign(also=chunk.also)

    def round_of(kind: int, ask, replies: DataFrame) -> DataFrame:
        asked = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(ask, "chunk int, order int, range int, data binary")
        return asked.groupBy("range").applyInPandas(lambda f: _answer(f, kind), "chunk int, kind int, range int, data binary, id long, digest string")

    told = copies.union(round_of(1, ask_marks, copies))
    told = told.union(round_of(2, ask_windows, told))
    done = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(
        finish, f"id long, n_bytes long, starts array<long>, ends array<long>, kept {'string' if as_text else 'binary'}, also string")
    back = F.from_json("also", taken) if carry else None
    return done.select("id", "n_bytes", "starts", "ends", "kept", *[back[c].alias(c) for c in carry])
