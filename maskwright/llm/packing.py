"""Packed token-id output: best-fit-decreasing with a segment tree over the free room.

Documents are encoded, and a document longer than a row is cut into full rows and a rest, so that
its pieces in order are its ids. The pieces of a shard are placed by falling length, each into the
row with the least room that is enough, and into the first of these; when no row has it, a new row
is begun. The rows with a given room are found by a segment tree over the room, so a search takes
steps in proportion to the logarithm of the row length.

A shard is the documents that follow one another where they are read, up to SHARD_TOKENS tokens, and
never a part of a document, so neither texts nor ids are shuffled, and memory is one shard. Each shard
gives a matrix of ids, one row of the output per row of the matrix: the ids as little-endian numbers
of two or four bytes, padded at the end; the cumulative lengths of its segments, from zero on; and the
places where positions begin anew, with the position that the segment begins with in its document.

Defined cases: a null or empty text has no tokens and no piece, it is counted in no row; repeated rows
are packed as often as they come; a null doc_id stays null in doc_ids; an empty table gives no rows;
extra columns are not used.
"""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import bpe
from maskwright.llm.common import arrow_rows, table

#: Tokens of a row, of a shard, and the id of the padding.
ROW, SHARD_TOKENS, PAD = 2048, 1 << 21, 0
#: Words and stretches of text that a worker remembers with their ids; a few hundred bytes each.
WORDS, STRETCHES = 800_000, 1_200_000


class Rooms:
    """Rows by their free room, with the least sufficient room found by a segment tree."""

    def __init__(self, most: int):
        self.size = 1 << max(most, 1).bit_length()
        self.has = bytearray(2 * self.size)  # whether any row below has that much room
        self.rows: list[deque[int]] = [deque() for _ in range(most + 1)]

    def _mark(self, room: int, there: bool) -> None:
        at = room + self.size
        self.has[at] = there
        while at > 1:
            at //= 2
            now = self.has[2 * at] | self.has[2 * at + 1]
            if self.has[at] == now:
                break
            self.has[at] = now

    def add(self, row: int, room: int) -> None:
        if not self.rows[room]:
            self._mark(room, True)
        self.rows[room].append(row)

    def least(self, need: int) -> int | None:
        """The smallest room of at least ``need`` that some row has."""
        at = need + self.size
        if self.has[at]:
            return need
        while at > 1:  # up, to the first subtree on the right that has any
            if not at & 1 and self.has[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.has[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None

    def take(self, room: int) -> int:
        row = self.rows[room].popleft()
        if not self.rows[room]:
            self._mark(room, False)
        return row


def best_fit_decreasing(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Rows of at most ``most`` in all, as lists of places in ``lengths``; each length is 1 to ``most``."""
    rooms, rows = Rooms(most), []
    for place in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[place])
        room = rooms.least(need)
        if room is None:
            row, room = len(rows), most
            rows.append([])
        else:
            row = rooms.take(room)
        rows[row].append(place)
        if room > need:
            rooms.add(row, room - need)
    return rows


def cut(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of all documents: document, start in it, and length."""
    pieces = -(-sizes // most)
    doc = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return doc, nth * most, np.minimum(sizes[doc] - nth * most, most)


OUT = (
    "shard long, row long, ids binary, n_tokens int, cu_seqlens array<int>, reset_at array<int>, reset_to array<long>, doc_ids array<long>"
)


def pack(docs: DataFrame, path: str, row: int = ROW, shard_tokens: int = SHARD_TOKENS, pad: int = PAD) -> DataFrame:
    """The packed rows of ``docs`` (doc_id, text), with the vocabulary at ``path``."""
    source = docs.sparkSession.sparkContext.broadcast(bpe.read_vocabulary(path))
    schema = pa.schema([
        ("shard", pa.int64()), ("row", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())),
        ("reset_at", pa.list_(pa.int32())), ("reset_to", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())),
    ])

    def matrix(shard: int, docs_: list[int | None], texts: list[bytes], width: np.dtype) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(t) // width.itemsize for t in texts], dtype=np.int64)
        doc, start, length = cut(sizes, row)
        rows = best_fit_decreasing(length, row)
        first = np.cumsum(sizes) - sizes
        tokens = np.frombuffer(b"".join(texts), dtype=width)
        for k in range(0, len(rows), 500):
            out = {n: [] for n in schema.names}
            for number, places in enumerate(rows[k : k + 500], k):
                line = np.full(row, pad, dtype=width)
                ends = [0]
                for p in places:
                    a = int(first[doc[p]] + start[p])
                    line[ends[-1] : ends[-1] + length[p]] = tokens[a : a + length[p]]
                    ends.append(ends[-1] + int(length[p]))
                out["shard"].append(shard)
                out["row"].append(number)
                out["ids"].append(line.tobytes())
                out["n_tokens"].append(ends[-1])
                out["cu_seqlens"].append(ends)
                out["reset_at"].append(ends[:-1])
                out["reset_to"].append([int(start[p]) for p in places])
                out["doc_ids"].append([docs_[doc[p]] for p in places])
            yield arrow_rows(schema, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec = bpe.worker_codec(source.value)
        codec.most_words = WORDS
        width = np.dtype("<u2" if max(codec.names) < 1 << 16 and pad < 1 << 16 else "<u4")
        letter = "H" if width.itemsize == 2 else "I"
        known = codec.known(f"bytes{width.itemsize}", lambda c: struct.pack(f"<{len(ids := codec.encode_stretch(c))}{letter}", *ids), STRETCHES)
        shard = TaskContext.get().partitionId() << 32
        docs_, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = b"".join([known[c] for c in codec.chunks(text or "")])
                n = len(ids) // width.itemsize
                if texts and held + n > shard_tokens:
                    yield from matrix(shard, docs_, texts, width)
                    docs_, texts, held, shard = [], [], 0, shard + 1
                docs_.append(doc_id)
                texts.append(ids)
                held += n
        if texts:
            yield from matrix(shard, docs_, texts, width)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)


def unpack(packed: DataFrame, row: int = ROW) -> DataFrame:
    """doc_id, start and ids of every piece, the reverse of ``pack``."""
    schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in schema.names}
            for r in batch.to_pylist():
                line = np.frombuffer(r["ids"], dtype="<u2" if len(r["ids"]) == 2 * row else "<u4")
                for k, doc_id in enumerate(r["doc_ids"]):
                    out["shard"].append(r["shard"])
                    out["doc_id"].append(doc_id)
                    out["start"].append(r["reset_to"][k])
                    out["ids"].append(line[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]].tolist())
            yield arrow_rows(schema, out)

    return packed.select("shard", "ids", "cu_seqlens", "reset_to", "doc_ids").mapInArrow(run, "shard long, doc_id long, start long, ids array<int>")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), bpe.default_path())
