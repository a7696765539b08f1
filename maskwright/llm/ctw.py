"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each at a node of the binary tree over bytes. Each of these nodes
has its own context tree over the bytes before, up to DEPTH of them. A node of that tree has the
counts a, b of zeros and ones seen there, and the Krichevsky-Trofimov estimate of them; its weighted
probability is half the estimate, half the product of its children's weighted probabilities, and at
the full depth the estimate alone. With the counts of a corpus held fixed, the probability of a
decision is a mix of the estimates of all depths along its context,

    p_d = w_d * (b + 1/2) / (a + b + 1) + (1 - w_d) * p_(d+1),

where w_d is the share of a node's own estimate in its weighted probability, and the path ends where
the tree has no deeper node. The code length of a text is the sum over its bytes and one end byte; a
text begins after DEPTH end bytes. So the probabilities of all texts add up to one.

Counting: every training byte counts, and every context that was seen has its nodes; the tree grows
with the corpus. It is a table dealt by the last NEAR bytes of context: documents are gathered to
chunks within tasks, the different stretches of DEPTH + 1 bytes of a chunk go to the buckets of their
last bytes with their counts, and there the tree is weighed from its full depth up to NEAR. Only the
depths above are on the driver and broadcast, at most 256^NEAR (context, byte) pairs at any corpus
size. With them a bucket knows the code length of each stretch that a chunk asked for, and the chunk
gets these lengths back for its documents.

The plain word model beside it, the base, has one count for every different word of the corpus, a
table that grows with it. Counts of the words seen most are broadcast, at most FREQUENT words of at
most FREQUENT_BYTES bytes; all other words of all documents are looked up by a join on the word.

Defined cases: a null text is the empty text, it costs the end byte; without training text each bit
costs one bit, and the base is zero; repeated rows give repeated rows and count as often; a null
doc_id is in fold 0, so it trains; extra columns are not used.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import LOWER, arrow_rows, fold_of, materialize, table

#: Bytes of context, bytes of it that the tree is dealt by, and the words whose counts are broadcast.
DEPTH, NEAR, FREQUENT, FREQUENT_BYTES = 5, 3, 200_000, 64
#: Different stretches that a task merges at once, words that it counts before it hands them on, bytes of
#: text of a chunk, and buckets that the contexts are dealt to. None of them changes results.
HELD, CHUNK, BUCKETS = 1_000_000, 32_000_000, 2_048
#: Never part of UTF-8.
END = 255
_LN2 = float(np.log(2.0))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural logarithm of the gamma function for x > 0: Stirling's series beyond 9, recursion below."""
    x = np.asarray(x, dtype=float)
    shift = np.ones_like(x)
    y = x.copy()
    for _ in range(9):
        low = y < 9
        if not low.any():
            break
        shift[low] *= y[low]
        y[low] += 1
    inverse = 1 / (y * y)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


_SMALL = np.arange(4_096)
_GAMMA = {shift: log_gamma(_SMALL + shift) for shift in (0.5, 1.0)}


def log_gamma_of(n: np.ndarray, shift: float) -> np.ndarray:
    """``log_gamma(n + shift)`` of counts n; most are small and come from a table."""
    out = _GAMMA[shift][np.minimum(n, len(_SMALL) - 1)]
    large = n >= len(_SMALL)
    out[large] = log_gamma(n[large] + shift)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov probability of a zeros and b ones in any fixed order."""
    return log_gamma_of(a, 0.5) + log_gamma_of(b, 0.5) - log_gamma_of(a + b, 1.0) - np.log(np.pi)


def mask(size: int) -> np.uint64:
    return np.uint64((1 << 8 * size) - 1)


def stretches(texts: list[bytes | None], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts, for each byte and the end, the last ``depth`` bytes and it as one number, the byte
    in the lowest place; and where the texts begin."""
    lead = bytes([END]) * depth
    lengths = np.array([len(t or b"") + 1 for t in texts], dtype=np.int64)
    joined = np.frombuffer(b"".join([lead + (t or b"").translate(LOWER) + lead[:1] for t in texts]) if depth else
                           b"".join([(t or b"").translate(LOWER) + bytes([END]) for t in texts]), dtype=np.uint8).astype(np.uint64)
    keys = joined.copy()
    for k in range(1, depth + 1):
        keys[k:] |= joined[:-k] << np.uint64(8 * k)
    starts = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) + np.repeat((np.arange(len(texts)) + 1) * depth, lengths)
    return keys[at], starts


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, rising, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


class Places:
    """Places of keys in an array of different keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.r_[keys, np.uint64(0)]
        self.bits = max(10, int(3 * max(len(keys), 1) - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        slot = self._slot(keys)
        found = self.slots[slot]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found[open_] = self.slots[slot[open_]]
            still = (found[open_] >= 0) & (self.keys[found[open_]] != keys[open_])
            open_ = open_[still]
        return found


def decisions(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (context, place in the tree of the byte) with the zeros and ones that were seen there."""
    context, byte = keys >> np.uint64(8) << np.uint64(8), keys & np.uint64(255)
    nodes, zeros, ones = [], [], []
    for level in range(8):
        node = context | (np.uint64(1 << level) | byte >> np.uint64(8 - level))
        one = (byte >> np.uint64(7 - level) & np.uint64(1)).astype(np.int64) * counts
        new = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
        if len(new):
            nodes.append(node[new])
            both = np.add.reduceat(counts, new)
            ones.append(np.add.reduceat(one, new))
            zeros.append(both - ones[-1])
    if not nodes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in (nodes, zeros, ones))


def grown(levels: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """By depth, the nodes and the code lengths in bits of a zero and of a one where the path ends at the node.

    Both outcomes have a sum of their own: one minus the other would be nothing where one of them was hardly ever seen.

    levels: by depth from 0, the kept stretches of that many context bytes and a byte, rising, with counts.
    """
    counted = [decisions(k, n) for k, n in levels]
    depth = len(levels) - 1
    parents: list[np.ndarray] = [None] * len(levels)
    weights: list[np.ndarray] = [None] * len(levels)
    below = None
    for d in range(depth, -1, -1):
        nodes, a, b = counted[d]
        own = log_kt(a, b)
        if d == depth:
            weights[d], below = np.ones(len(nodes)), own
            continue
        deeper, da, db = counted[d + 1]
        parents[d + 1] = parent = Places(nodes).find(deeper & mask(d + 1))
        rest_a, rest_b, children = a.copy(), b.copy(), np.zeros(len(nodes))
        if len(deeper):
            children += np.bincount(parent, below, len(nodes))
            # what the children that were cut off have seen counts as one more child
            rest_a -= np.bincount(parent, da, len(nodes)).astype(np.int64)
            rest_b -= np.bincount(parent, db, len(nodes)).astype(np.int64)
        cut = rest_a + rest_b > 0
        children[cut] += log_kt(rest_a[cut], rest_b[cut])
        whole = np.logaddexp(own - _LN2, children - _LN2)
        weights[d], below = np.exp(own - _LN2 - whole), whole
    out = []
    spent, left = np.zeros((2, 0)), np.zeros(0)
    for d, (nodes, a, b) in enumerate(counted):
        estimate = (np.stack([a, b]) + 0.5) / (a + b + 1.0)
        before = spent[:, parents[d]] if d else np.zeros((2, len(nodes)))
        share = left[parents[d]] if d else np.ones(len(nodes))
        out.append((nodes, (-np.log2(before + share * estimate)).astype(np.float32)))
        spent, left = before + share * weights[d] * estimate, share * (1 - weights[d])
    return out


def weighed(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray | None, deep: int, first: int) -> tuple[list, tuple]:
    """From the nodes of depth ``deep`` up: by depth from ``first`` nodes, zeros, ones, share of the own estimate
    and place of the parent; and the nodes above ``first`` with zeros, ones and the product of their children.

    below: logarithm of the product of the children of ``nodes``, None at the full depth.
    """
    levels = []
    for d in range(deep, first - 1, -1):
        own = log_kt(a, b)
        whole = own if below is None else np.logaddexp(own, below) - _LN2
        share = np.ones(len(nodes)) if below is None else np.exp(own - _LN2 - whole)
        # the byte of a node is in the lowest place, so a mask of d bytes leaves d - 1 of context
        up, place = np.unique(nodes & mask(d), return_inverse=True) if d else (nodes, None)
        levels.append((nodes, a, b, share, place))
        if d:
            a, b = (np.bincount(place, x, len(up)).astype(np.int64) for x in (a, b))
            nodes, below = up, np.bincount(place, whole, len(up))
    return levels[::-1], (nodes, a, b, below)


def ends_of(levels: list, spent: np.ndarray | None = None, left: np.ndarray | None = None) -> tuple[list, np.ndarray, np.ndarray]:
    """By depth, nodes and code lengths as ``grown`` has them, for the levels of ``weighed``; and of the last
    depth, what the mix has so far of a zero and of a one, and the share that is left for deeper nodes.

    spent, left: these two of the depth above, by its nodes; None at the root.
    """
    out = []
    for nodes, a, b, weight, place in levels:
        estimate = (np.stack([a, b]) + 0.5) / (a + b + 1.0)
        before = np.zeros((2, len(nodes))) if spent is None else spent[:, place]
        share = np.ones(len(nodes)) if left is None else left[place]
        out.append((nodes, (-np.log2(before + share * estimate)).astype(np.float32)))
        spent, left = before + share * weight * estimate, share * (1 - weight)
    return out, spent, left


class Tree:
    """Code lengths by the nodes of ``grown``, remembered for the stretches that were seen.

    top: a tree of the depths above those of ``nodes``.
    """

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]], seen: np.ndarray, top: Tree | None = None):
        self.places = (top.places if top else []) + [Places(keys) for keys, _ in nodes]
        self.ends = (top.ends if top else []) + [x for _, x in nodes]
        self.depth = len(self.places) - 1
        self.seen = Places(seen)
        self.lengths = np.r_[self.slow(seen), 0.0].astype(np.float32)

    def slow(self, keys: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each stretch, decision by decision."""
        total = np.zeros(len(keys))
        byte = keys & np.uint64(255)
        for level in range(8):
            node = np.uint64(1 << level) | byte >> np.uint64(8 - level)
            one = (byte >> np.uint64(7 - level) & np.uint64(1)).astype(np.int64)
            length = np.ones(len(keys))
            open_ = np.arange(len(keys))
            for d in range(self.depth, -1, -1):
                found = self.places[d].find((keys[open_] >> np.uint64(8) << np.uint64(8) & mask(d + 1)) | node[open_])
                hit = found >= 0
                length[open_[hit]] = self.ends[d][one[open_[hit]], found[hit]]
                open_ = open_[~hit]
                if not len(open_):
                    break
            total += length
        return total

    def bits(self, texts: list[bytes | None]) -> np.ndarray:
        """Code length of each text with its end."""
        out = [np.zeros(0)]
        for start in range(0, len(texts), 200):
            keys, starts = stretches(texts[start : start + 200], self.depth)
            at = self.seen.find(keys)
            length = self.lengths[at].astype(float)
            new = np.flatnonzero(at < 0)
            length[new] = self.slow(keys[new])
            out.append(np.add.reduceat(length, starts))
        return np.concatenate(out)


class Lengths:
    """Code lengths of texts by the lengths of all their stretches."""

    def __init__(self, depth: int, answers: list[tuple[bytes, bytes]]):
        self.depth = depth
        self.places = Places(np.frombuffer(b"".join(k for k, _ in answers), np.uint64))
        self.lengths = np.frombuffer(b"".join(n for _, n in answers), np.float32).astype(float)

    def bits(self, texts: list[bytes | None]) -> np.ndarray:
        """Code length of each text with its end."""
        out = [np.zeros(0)]
        for start in range(0, len(texts), 200):
            keys, starts = stretches(texts[start : start + 200], self.depth)
            at = self.places.find(keys)
            if (at < 0).any():
                raise ValueError("a stretch of a document is missing in its chunk")
            out.append(np.add.reduceat(self.lengths[at], starts))
        return np.concatenate(out)


def blobs(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The values from each start to the next as bytes."""
    offsets = np.r_[starts, len(values)].astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def buckets_of(keys: np.ndarray, near: int) -> np.ndarray:
    """Bucket of each stretch, by the last ``near`` bytes of its context."""
    mixed = (keys >> np.uint64(8) & mask(near)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS


def chunked(rows: DataFrame, depth: int, near: int) -> DataFrame:
    """Rows of doc_id, text (binary), held_out with the chunk they are gathered to; and rows of bucket with its different
    stretches in a chunk, rising, and how often training rows have them."""
    schema = pa.schema([
        ("chunk", pa.int64()), ("doc_id", pa.int64()), ("text", pa.binary()), ("held_out", pa.bool_()),
        ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()),
    ])
    most = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, size = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def gathered():
            keys, counts = added(*(np.concatenate(x) for x in zip(*held)))
            bucket = buckets_of(keys, near)
            order = np.argsort(bucket, kind="stable")
            keys, counts, bucket = keys[order], counts[order].astype(np.uint32), bucket[order]
            new = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            none = {f.name: pa.nulls(len(new), f.type) for f in schema}
            yield arrow_rows(schema, none | {
                "chunk": np.full(len(new), at), "bucket": bucket[new], "keys": blobs(keys, new), "counts": blobs(counts, new),
            })

        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts, outs = (part.column(k).to_pylist() for k in (1, 2))
                for out in (False, True):
                    if some := [t for t, o in zip(texts, outs) if o == out]:
                        keys = np.sort(stretches(some, depth)[0])
                        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                        held.append((keys[new], np.diff(np.r_[new, len(keys)]) * (not out)))
                none = {f.name: pa.nulls(len(texts), f.type) for f in schema}
                yield arrow_rows(schema, none | {
                    "chunk": np.full(len(texts), at), "doc_id": part.column(0), "text": part.column(1), "held_out": part.column(2),
                })
                size += sum(len(t or b"") for t in texts)
                if sum(len(k) for k, _ in held) > 4 * HELD:
                    held = [added(*(np.concatenate(x) for x in zip(*held)))]
                if size >= most:
                    yield from gathered()
                    held, size, at = [], 0, at + 1
        if held:
            yield from gathered()

    out = "chunk long, doc_id long, text binary, held_out boolean, bucket long, keys binary, counts binary"
    return rows.select("doc_id", "text", "held_out").mapInArrow(run, out)


def bucket_pairs(asked: DataFrame, depth: int, near: int, most: int) -> DataFrame:
    """Of bucket, keys, counts: by bucket the stretches of the training rows with their counts, and the nodes above its
    contexts of ``near`` bytes with their zeros, ones and the product of the children that are in the bucket."""
    schema = pa.schema([("bucket", pa.int64()), *((n, pa.binary()) for n in ("keys", "counts", "up", "zeros", "ones", "below"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last, size, merged = None, 0, 0

        def whole():
            keys, counts = added(*(np.concatenate(x) for x in zip(*held)))
            if len(keys):
                above = weighed(*decisions(keys, counts), None, depth, near)[1] if near else ()
                parts = dict(zip(("up", "zeros", "ones", "below"), above))
                yield arrow_rows(schema, {"bucket": [last], "keys": [keys.tobytes()], "counts": [counts.tobytes()]} | {
                    n: [parts[n].tobytes() if n in parts else b""] for n in ("up", "zeros", "ones", "below")
                })

        for batch in batches:
            for bucket, keys, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if held and bucket != last:
                    yield from whole()
                    held, size, merged = [], 0, 0
                last, n = bucket, np.frombuffer(counts, np.uint32).astype(np.int64)
                held.append((np.frombuffer(keys, np.uint64)[n > 0], n[n > 0]))
                size += len(held[-1][0])
                if size > 2 * merged + most:
                    held = [added(*(np.concatenate(x) for x in zip(*held)))]
                    size = merged = len(held[0][0])
        if held:
            yield from whole()

    out = "bucket long, keys binary, counts binary, up binary, zeros binary, ones binary, below binary"
    return asked.select("bucket", "keys", "counts").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, out)


def learn_top(pairs: DataFrame, near: int) -> tuple[list, np.ndarray, np.ndarray]:
    """The depths of less than ``near`` bytes as ``ends_of`` has them; at most 256^near pairs at any corpus size."""
    schema = pa.schema([("node", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("below", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for up, a, b, below in zip(*(batch.column(k).to_pylist() for k in range(4))):
                yield arrow_rows(schema, {
                    "node": np.frombuffer(up, np.int64), "a": np.frombuffer(a, np.int64), "b": np.frombuffer(b, np.int64), "below": np.frombuffer(below),
                })

    nodes = pairs.select("up", "zeros", "ones", "below").mapInArrow(run, "node long, a long, b long, below double")
    found = nodes.groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below")).toArrow()
    node, a, b, below = (found.column(n).to_numpy() for n in ("node", "a", "b", "below"))
    order = np.argsort(node)
    return ends_of(weighed(node[order].view(np.uint64), a[order], b[order], below[order], near - 1, 0)[0])


def stretch_lengths(asked: DataFrame, pairs: DataFrame, depth: int, near: int, most: int) -> DataFrame:
    """chunk, keys and lengths (float32) of all bucket, chunk, keys: code lengths in bits by the tree of all pairs."""
    spark = asked.sparkSession
    above = spark.sparkContext.broadcast(learn_top(pairs, near) if near else None)
    schema = pa.schema([("chunk", pa.int64()), ("keys", pa.binary()), ("lengths", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = Tree(above.value[0], np.zeros(0, np.uint64)) if near else None
        nothing = [(np.zeros(0, np.uint64), np.zeros((2, 0), np.float32))] * (depth - near + 1)
        tree, last, size = None, None, 0
        held: list[tuple[int, bytes]] = []

        def branch(keys, counts):
            levels, (up, *_) = weighed(*decisions(keys, counts), None, depth, near)
            if not near:
                return ends_of(levels)[0]
            at = top.places[-1].find(up)
            return ends_of(levels, above.value[1][:, at], above.value[2][at])[0]

        def measured():
            keys = np.frombuffer(b"".join(k for _, k in held), np.uint64)
            different, place = np.unique(keys, return_inverse=True)
            lengths = tree.slow(different).astype(np.float32)[place]
            starts = np.cumsum([0, *(len(k) // 8 for _, k in held)])[:-1]
            yield arrow_rows(schema, {"chunk": [c for c, _ in held], "keys": [k for _, k in held], "lengths": blobs(lengths, starts)})

        for batch in batches:
            for bucket, chunk, keys, counts in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and (bucket != last or size > most):
                    yield from measured()
                    held, size = [], 0
                if bucket != last:
                    tree, last = Tree(nothing, np.zeros(0, np.uint64), top), bucket
                if counts is not None:
                    tree = Tree(branch(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)), np.zeros(0, np.uint64), top)
                else:
                    held.append((chunk, keys))
                    size += len(keys) // 8
        if held:
            yield from measured()

    # the row of a bucket's tree comes before what its chunks ask for
    known = pairs.select("bucket", F.lit(-1).cast("long").alias("chunk"), "keys", "counts")
    both = known.union(asked.select("bucket", "chunk", "keys", F.lit(None).cast("binary")))
    return both.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, "chunk long, keys binary, lengths binary")


_words: dict[str, dict[bytes, float]] = {}


def worker_words(key: str, words: pa.Table, floor: float) -> dict[bytes, float]:
    """The logarithms of the words of a broadcast, built once per worker process."""
    if key not in _words:
        _words.clear()
        logs = np.log10(words.column("n").to_numpy() + 0.5) - floor
        _words[key] = dict(zip(words.column("word").to_pylist(), logs.tolist()))
    return _words[key]


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary) and n of all ``text`` (binary), counted within tasks before the shuffle."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows():
            words, counts = list(held), list(held.values())
            for k in range(0, len(words), 50_000):
                yield arrow_rows(schema, {"word": words[k : k + 50_000], "n": counts[k : k + 50_000]})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update((text or b"").translate(LOWER).split())
            if len(held) > HELD // 2:
                yield from rows()
                held.clear()
        yield from rows()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(words: DataFrame, most: int = FREQUENT) -> tuple[pa.Table, Column]:
    """The words seen most with their counts, at most ``most`` and ``FREQUENT_BYTES`` bytes each, and the condition that picks them."""
    short = words.filter(F.length("word") <= FREQUENT_BYTES)
    step = F.floor(F.log2("n") * 8)
    spread = sorted(((r["step"], r["low"], r["words"]) for r in short.groupBy(step.alias("step")).agg(F.min("n").alias("low"), F.count("*").alias("words")).collect()), reverse=True)
    least, room = 1 << 62, most
    for _, low, n in spread:
        if n > room:
            break
        least, room = low, room - n
    picked = (F.col("n") >= least) & (F.length("word") <= FREQUENT_BYTES)
    return words.filter(picked).select("word", "n").toArrow().combine_chunks(), picked


def score(docs: DataFrame, training: Column, depth: int = DEPTH, held: int = HELD, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row of
    ``docs`` (doc_id, text), learned from the rows where ``training`` holds.

    held: stretches of a bucket that a task looks up or merges at once; results do not depend on it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), (~training).alias("held_out"))
    train = rows.filter("not held_out").select("text")
    words = materialize(word_counts(train), "words")
    near = min(NEAR, depth)
    parts = materialize(chunked(rows, depth, near), "chunks")
    asked = parts.filter("bucket is not null")
    pairs = materialize(bucket_pairs(asked, depth, near, held), "pairs")
    lengths = stretch_lengths(asked, pairs, depth, near, held)
    known, picked = frequent_words(words, frequent)
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = train.count()
    total, different = size["n"] + ends, size["v"] + (ends > 0)
    floor = float(np.log10(total + 0.5 * (different + 1)))
    of = lambda c: float(np.log10(c + 0.5)) - floor
    # arrays as they came: the table of a worker is built from them where it is used
    model = spark.sparkContext.broadcast((uuid.uuid4().hex, known))
    del known
    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_frequent", pa.int64()),
        ("base", pa.float64()), ("bits", pa.float64()), ("bytes", pa.int64()), ("rare", pa.list_(pa.binary())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        logs = worker_words(*model.value, floor)
        at = TaskContext.get().partitionId() << 40
        found, last = None, None
        asked_: list[tuple[bytes, bytes]] = []
        for batch in batches:
            # by chunk, first its stretches and then its documents
            chunks, answers = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            edges = np.flatnonzero(np.r_[True, (chunks[1:] != chunks[:-1]) | (answers[1:] != answers[:-1])]) if len(chunks) else []
            for start, end in zip(edges, [*edges[1:], len(chunks)]):
                part = batch.slice(start, end - start)
                if chunks[start] != last:
                    found, last, asked_ = None, chunks[start], []
                if answers[start] == 0:
                    asked_ += zip(part.column(5).to_pylist(), part.column(6).to_pylist())
                    continue
                if found is None:
                    found, asked_ = Lengths(depth, asked_), []
                yield scored_rows(part, found, logs, at)
                at += part.num_rows

    def scored_rows(batch: pa.RecordBatch, found: Lengths, logs: dict[bytes, float], at: int) -> pa.RecordBatch:
        texts = batch.column(3).to_pylist()
        out = {n: [] for n in ("n_tokens", "n_frequent", "base", "rare")}
        for text in texts:
            tokens = (text or b"").translate(LOWER).split()
            rare = [t for t in tokens if t not in logs]
            out["n_tokens"].append(len(tokens) + 1)
            out["n_frequent"].append(len(tokens) - len(rare))
            out["base"].append(sum([logs[t] for t in tokens if t in logs]))
            out["rare"].append(rare)
        return arrow_rows(schema, out | {
            "row": np.arange(at, at + len(texts)), "doc_id": batch.column(2), "held_out": batch.column(4),
            "bits": found.bits(texts), "bytes": [len(t or b"") + 1 for t in texts],
        })

    out = "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, base double, bits double, bytes long, rare array<binary>"
    none = F.lit(None).cast("binary")
    documents = parts.filter("bucket is null").select("chunk", F.lit(1).alias("part"), "doc_id", "text", "held_out", none.alias("keys"), none.alias("lengths"))
    answers = lengths.select("chunk", F.lit(0).alias("part"), F.lit(None).cast("long"), none, F.lit(None).cast("boolean"), "keys", "lengths")
    both = documents.union(answers).repartition("chunk").sortWithinPartitions("chunk", "part")
    scored = materialize(both.mapInArrow(run, out), "scored")
    model.destroy()  # the scores are a table now
    rare = scored.select("row", F.explode("rare").alias("word")).join(words.filter(~picked), "word", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5) - floor).alias("rare_base"), F.count("n").alias("n_rare")
    )
    return scored.drop("rare").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + F.lit(of(ends))).alias("base_score"),
        (-F.col("bits") * float(np.log10(2.0))).alias("score"),
        (F.col("bits") / F.col("bytes")).alias("bits_per_byte"),
    )


def op7_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), fold_of(F.col("doc_id")) != 1)
