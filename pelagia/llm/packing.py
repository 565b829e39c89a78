"""Token sequences packed by best-fit decreasing.

Documents are tokenised, closed with an end id and, where longer than a sequence, cut: whole sequences are taken from
the end, so the first piece is the short one. Pieces are then placed longest first into the open sequence with the
least room that still holds them. A segment tree over remaining capacities finds that sequence in a logarithmic
number of steps. A piece that fills a sequence alone needs no search.

The pieces are dealt into shards by a hash of their document; a shard is packed by one task, and only piece lengths
travel, never texts. A shard holds a bounded number of tokens, so the number of shards grows with the input while
each can waste a fraction of one sequence at most more than a packing of all pieces at once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import arrow_stage, cut_lineage
from pelagia.llm.word_bpe import byte_letters

#: How a byte-level tokenizer cuts text (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept between batches.
CACHE = 250_000
#: Tokens one task packs.
SHARD_TOKENS = 8_000_000


class ByteBpe:
    """Ids of whole texts as the tokenizers library gives them for a byte-level vocabulary file.

    In texts whose words are parted by single blanks or line ends, a word's ids do not depend on its neighbours, so they
    are kept. New words go through tiktoken with the same vocabulary, which merges faster; any other text is encoded
    as a whole by the tokenizers library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[str, bytes] = {}
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.added = added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(map(byte.__getitem__, w)): i for w, i in self.tokenizer.get_vocab(False).items() if w not in added}
        self.words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line_end = self.tokenizer.token_to_id("\u010a")

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words without a line end, asked for many at once: the line end between them has an id of its own."""
        out: list[bytes] = []
        for at in range(0, len(words), 4096):
            some = words[at:at + 4096]
            ids = np.array(self.words.encode_ordinary("\n".join(some)), dtype="<u4")
            raw, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == self.line_end)).tolist()
            out.extend([raw[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)])])
        return out

    def plain(self, text: str) -> bool:
        """Words parted by one blank or line end each, no other white space at all, no special token."""
        return text.split() == text.replace("\n", " ").split(" ") and not any(a in text for a in self.added)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text."""
        # a word that opens a line keeps the line end and has no blank before it; a text's first word is like that too
        rows = [("\n" + t.replace("\n", " \n")).split(" ") if self.plain(t) else None for t in texts]
        wanted: set[str] = set()
        for row in rows:
            if row:
                wanted.update(row)
        if len(self.cache) + len(wanted) > CACHE:
            self.cache.clear()
        new = [w for w in wanted if w not in self.cache]
        opening, inner = [w for w in new if w[0] == "\n"], [w for w in new if w[0] != "\n"]
        end = int(self.line_end).to_bytes(4, "little")
        self.cache.update((w, end + ids) for w, ids in zip(opening, self._words([w[1:] for w in opening])))
        self.cache.update(zip(inner, self._words([" " + w for w in inner])))
        known, out = self.cache.__getitem__, []
        for text, row in zip(texts, rows):
            out.append(self._ids([text])[0] if row is None else b"".join(map(known, row))[4:])
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One encoder per Python worker and file."""
    return ByteBpe(path)


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``ids`` (packed little-endian 32-bit): every document's ids and end id, cut.

    Null texts are empty and consist of the end id. Rows of one id are separate documents.
    """
    close = np.array([end_id], dtype="<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        bpe = load(path)
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = 0
        while at < len(ids):
            upto, held = at, 0
            while upto < len(ids) and (upto == at or held < 4_000_000):
                held += len(texts[upto] or "")
                upto += 1
            rows = []
            for doc, packed in zip(ids[at:upto], bpe.encode_batch([t or "" for t in texts[at:upto]])):
                packed += close
                n = len(packed) // 4
                start, stop, k = 0, n % size or size, 0
                while start < n:
                    rows.append((doc, k, start, stop - start, packed[4 * start:4 * stop]))
                    start, stop, k = stop, stop + size, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                                             ["id", "piece", "start", "length", "ids"])
            at = upto

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_stage(plain, cut, "id long, piece int, start long, length long, ids binary")


class Rooms:
    """Segment tree over remaining capacities 0..size: which of them some open sequence has."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.open = [0] * (2 * self.base)

    def add(self, room: int, by: int) -> None:
        at = room + self.base
        while at:
            self.open[at] += by
            at >>= 1

    def tightest(self, need: int) -> int:
        """Least capacity of an open sequence that is ``need`` or more; -1 if none."""
        at = need + self.base
        if self.open[at]:
            return need
        while at > 1 and (at & 1 or not self.open[at + 1]):
            at >>= 1
        if at <= 1:
            return -1
        at += 1
        while at < self.base:
            at *= 2
            if not self.open[at]:
                at += 1
        return at - self.base


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, placed in descending order."""
    where, offset = np.empty(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    rooms, by_room, used = Rooms(size), [[] for _ in range(size + 1)], 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = rooms.tightest(need)
        if room < 0:
            where[i], room = used, size
            used += 1
        else:
            where[i] = by_room[room].pop()
            rooms.add(room, -1)
        offset[i] = size - room
        if room > need:
            by_room[room - need].append(int(where[i]))
            rooms.add(room - need, 1)
    return where, offset


def pack(cut: DataFrame, size: int = 2048, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``cut`` (one row per piece with ``key``, ``length``) and ``sequence_id``, ``offset``; no piece is left out.

    ``key`` tells pieces apart. An empty table gives an empty table.
    """
    total = cut.agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "key"], ascending=[False, True], ignore_index=True)
        where, offset = best_fit(frame["length"].to_numpy(), size)
        return pd.DataFrame({"key": frame["key"], "sequence_id": where * shards + int(frame["shard"].iloc[0]), "offset": offset})

    dealt = cut.select("key", "length", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    placed = dealt.groupBy("shard").applyInPandas(place, "key long, sequence_id long, offset long")
    return cut.join(placed, "key")


def best_fit_packing(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids``).

    A document no longer than a sequence is one piece; longer ones are cut into whole sequences after a first piece
    that may be shorter. Offsets in a sequence leave no gap. Null texts are empty documents, repeated rows are packed
    each, a null id stays null, extra columns are ignored.
    """
    cut = pieces(docs, path, size, end_id, id_col, text_col).withColumn("ids_crc32", F.crc32("ids"))
    cut = cut if with_ids else cut.drop("ids")
    cut = cut_lineage(cut.withColumn("key", F.monotonically_increasing_id()))
    return pack(cut, size).drop("key")
