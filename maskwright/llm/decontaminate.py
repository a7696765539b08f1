"""Benchmark decontamination with a positional inverted index, split by documents.

The documents are dealt into shards of bounded text where they are read. A shard stores one row per
term with the rising positions of the term in the shard, as a packed list of gaps, and one row that
says where each document begins. Positions count words; between two documents one is left out, so
no phrase can run over a border. The index is a table in the shared folder and serves any number of
searches.

A search meets every shard: only the lists of the terms that the search uses are read and dealt by
shard, together with the phrases, in blocks of bounded text. Within a shard the terms of a phrase
are taken from the rarest on: the positions of the rarest, less its offset, are the starts that are
still possible, and each further list, less its offset, is intersected with them. A phrase with a
term that the shard lacks costs one look. No row of documents or postings goes to the driver, and
no common term gathers in one task, since its list is one row per shard.

Defined cases: null texts have no words; an item without words has no phrase and is never found;
repeated documents give repeated rows; repeated item ids are one item with the phrases of all its
rows, a null item_id included (it is left out of the list of ids); extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import arrow_rows, free_names, materialize, pieces_of, table

#: Words of a window, bytes of text in a shard, and bytes of benchmark text in a block of phrases.
WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20
#: Lower-cases A-Z, keeps digits, letters and all bytes beyond ASCII, and makes the rest a space.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD).split() if text else []


def pack(positions: np.ndarray) -> bytes:
    """Gaps of a rising list, seven bits a byte."""
    gaps = np.diff(positions, prepend=0).astype(np.uint64)
    return pack_many(gaps, np.array([0]))[0]


def pack_many(gaps: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The lists of gaps that begin at ``starts``, each packed with seven bits a byte."""
    size = np.ones(len(gaps), dtype=np.int64)
    for k in range(1, 9):
        size += gaps >= np.uint64(1 << 7 * k)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[at[has] + k] = ((gaps[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    whole, cuts = out.tobytes(), [*at[starts].tolist(), len(out)]
    return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


def unpack(packed: bytes) -> np.ndarray:
    """The rising list of ``pack``."""
    raw = np.frombuffer(packed, dtype=np.uint8)
    first = np.flatnonzero(np.r_[True, raw[:-1] < 128]) if len(raw) else np.zeros(0, np.int64)
    if len(first) == len(raw):
        return np.cumsum(raw, dtype=np.int64)
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.r_[first, len(raw)]))
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first))


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Postings of ``docs`` (doc_id, text): shard, term, packed, docs.

    The row with a null term has, in ``docs``, doc_id, start and number of words of each document.
    """
    doc = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
    schema = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("packed", pa.binary()), ("docs", pa.list_(doc))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for k, piece in enumerate(pieces_of(batches, "text", shard_bytes)):
            ids: dict[bytes, int] = {}
            found, starts, counts, at = [], [], [], 1
            for text in piece.column("text").to_pylist():
                words = words_of(text)
                found.append(np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int32))
                starts.append(at)
                counts.append(len(words))
                at += len(words) + 1
            rows = [{"doc_id": d, "start": s, "n": n} for d, s, n in zip(piece.column("doc_id").to_pylist(), starts, counts)]
            yield arrow_rows(schema, {"shard": [base + k], "term": [None], "packed": [None], "docs": [rows]})
            tokens = np.concatenate(found)
            if not len(tokens):
                continue
            where = np.arange(len(tokens)) + np.repeat(np.arange(len(counts)), counts) + 1
            order = np.argsort(tokens, kind="stable")
            cuts = np.searchsorted(tokens[order], np.arange(len(ids)))
            gaps = np.diff(where[order], prepend=0)
            gaps[cuts] = where[order][cuts]
            packed = pack_many(gaps.astype(np.uint64), cuts)
            terms = list(ids)
            for a in range(0, len(terms), 20_000):
                part = terms[a : a + 20_000]
                yield arrow_rows(schema, {"shard": np.full(len(part), base + k), "term": part, "packed": packed[a : a + len(part)], "docs": [None] * len(part)})

    out = "shard long, term binary, packed binary, docs array<struct<doc_id: long, start: long, n: long>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, out)


def phrases_of(items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, words array<binary> and block of every item with words, in blocks of about ``block_bytes``."""
    split = F.filter(F.split(_lowered(), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")
    rows = items.select("item_id", F.transform(split, lambda w: w.cast("binary")).alias("words"), F.length(F.col("text").cast("binary")).alias("size"))
    rows = rows.filter(F.size("words") > 0)
    blocks = F.lit(block_bytes).cast("double")
    total = rows.agg((F.coalesce(F.sum("size"), F.lit(0)) / blocks).alias("n"))
    # one number; an item is dealt to one of as many blocks as the texts fill
    n = int(total.first()[0]) + 1
    return rows.select("item_id", "words", F.pmod(F.xxhash64("item_id", "words"), F.lit(n)).alias("block"))


def _lowered():
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.col("text"), F.lit("")), upper, upper.lower())


class Shard:
    """The lists of one shard that a search needs."""

    def __init__(self, terms: list[bytes], packed: list[bytes]):
        self.packed = dict(zip(terms, packed))
        self.lists: dict[bytes, np.ndarray] = {}

    def get(self, term: bytes) -> np.ndarray:
        if term not in self.lists:
            self.lists[term] = unpack(self.packed[term])
        return self.lists[term]

    def phrase(self, words: list[bytes]) -> np.ndarray:
        """Starts of all exact occurrences of a phrase."""
        if any(w not in self.packed for w in words):
            return np.zeros(0, np.int64)
        order = sorted(range(len(words)), key=lambda k: len(self.packed[words[k]]))
        starts = self.get(words[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            other = self.get(words[k])
            at = np.minimum(np.searchsorted(other, starts + k), len(other) - 1)
            starts = starts[other[at] == starts + k]
        return starts

    def near(self, words: list[bytes], span: int, firsts: np.ndarray) -> np.ndarray:
        """Starts of all stretches of ``span`` words that hold every one of ``words`` and begin with one of them.

        firsts: where the documents start; a stretch ends with the document that it starts in.
        """
        if any(w not in self.packed for w in words):
            return np.zeros(0, np.int64)
        order = sorted(set(words), key=lambda w: len(self.packed[w]))
        rare = self.get(order[0])
        starts = np.unique((rare[:, None] - np.arange(span)[None, :]).ravel())
        starts = starts[starts >= firsts[0]]
        ends = np.minimum(starts + span, np.r_[firsts, np.iinfo(np.int64).max][np.searchsorted(firsts, starts, side="right")])
        begins = np.zeros(len(starts), dtype=bool)
        for w in order:
            other = self.get(w)
            at = np.searchsorted(other, starts)
            nearest = other[np.minimum(at, len(other) - 1)]
            inside = (at < len(other)) & (nearest < ends)
            starts, ends, begins = starts[inside], ends[inside], begins[inside] | (nearest[inside] == starts[inside])
        return starts[begins]


def search(index: DataFrame, phrases: DataFrame, window: int = WINDOW, near: int = 0) -> DataFrame:
    """Matches by document: shard, doc_no, doc_id, n_words, the items found and the spans of words they cover.

    Each item is cut into all windows of ``window`` words (a shorter one is a single window) and each
    window has to occur as it stands. With ``near`` over 0 instead, all words of an item have to occur
    within as many consecutive words of a document. One row per document and block of phrases.
    """
    phrases = materialize(phrases, "phrases")
    terms = phrases.select("block", F.explode("words").alias("term")).distinct()
    blocks = phrases.groupBy("block").agg(F.collect_list(F.struct("item_id", "words")).alias("phrases"))
    shards = index.filter("term is null").select("shard", "docs")
    lists = index.filter("term is not null").join(terms, "term").select("shard", "block", "term", "packed")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_last_block(phrases)).cast("long")))
    asked = shards.select("*", every.alias("block")).join(blocks, "block", "left").select(
        F.col("shard").alias("at_shard"), F.col("block").alias("at_block"), "docs", "phrases"
    )

    def run(key, found: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        docs, wanted = about["docs"].iloc[0], about["phrases"].iloc[0]
        starts = np.array([d["start"] for d in docs], dtype=np.int64)
        shard = Shard(found["term"].tolist(), found["packed"].tolist())
        items: list[list] = [[] for _ in docs]
        spans: list[list] = [[] for _ in docs]
        for item in wanted if wanted is not None else ():
            words = [bytes(w) for w in item["words"]]
            if near:
                hits, width = shard.near(words, near, starts), near
            else:
                width = min(window, len(words))
                hits = np.concatenate([shard.phrase(words[k : k + width]) for k in range(len(words) - width + 1)])
            if len(hits):
                hits = np.unique(hits)
                owner = np.searchsorted(starts, hits, side="right") - 1
                for d in np.unique(owner).tolist():
                    items[d].append(item["item_id"])
                    spans[d] += [{"start": a, "stop": b} for a, b in merged((hits[owner == d] - starts[d]).tolist(), width, docs[d]["n"])]
        return pd.DataFrame({
            "shard": key[0], "doc_no": np.arange(len(docs)), "doc_id": pd.array([d["doc_id"] for d in docs], dtype="Int64"),
            "n_words": [d["n"] for d in docs], "item_ids": items, "spans": spans,
        })

    out = "shard long, doc_no long, doc_id long, n_words long, item_ids array<long>, spans array<struct<start: long, stop: long>>"
    return lists.groupBy("shard", "block").cogroup(asked.groupBy("at_shard", "at_block")).applyInPandas(run, out)


def _last_block(phrases: DataFrame) -> int:
    return phrases.agg(F.max("block")).first()[0] or 0


def merged(starts: list[int], width: int, most: int) -> list[tuple[int, int]]:
    """Stretches that the windows at rising ``starts`` cover, within ``most`` words."""
    out: list[list[int]] = []
    for a in starts:
        b = min(a + width, most)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and item_ids of every row of ``docs``."""
    index = materialize(build_index(docs), "postings")
    found = search(index, phrases_of(items, window), window)
    # a document has one row for each block of phrases; the usual benchmark is one block
    whole = found.groupBy("shard", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("stop"))
    add = lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], s["stop"]))).alias("n"), F.greatest(s["stop"], x["stop"]).alias("stop")
    )
    n_hit = F.aggregate("spans", zero, add, lambda s: s["n"])
    listed = F.array_join(F.sort_array(F.transform(F.filter("item_ids", lambda i: i.isNotNull()), lambda i: i.cast("string"))), ",")
    return whole.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "item_ids",
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a benchmark passage; a row is known by a hash of its id and text.

    Null and empty texts hold none and stay, as do repeated rows and rows without an id where their text
    is clean. The columns, whatever their names, stay as they are; an empty table stays empty.
    """
    name = free_names(docs, "row_key")[0]
    key = F.xxhash64("doc_id", "text")
    found = contamination(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = materialize(found.filter("contaminated").select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.withColumn(name, key).join(bad, name, "left_anti").select(*docs.columns)
