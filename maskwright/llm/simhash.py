"""SimHash near-duplicates by an inverted index over byte positions, with count filtering.

A fingerprint of 64 bits is eight bytes at eight positions. Two fingerprints that differ in at
most ``d`` bits differ in at most ``d`` bytes, so they share at least ``8 - d`` positional bytes.
A single posting list (position, byte) holds 1/256 of all fingerprints, and tallying the pairs of
such lists is quadratic. The index therefore stores the lists already intersected, as many at a time
as the guarantee says: a pair reaches the guaranteed tally exactly when it meets in at least one of
these lists. So the intersections do the counting, and no tally is kept beside them. A list that
fixes ``8 - d`` bytes can never hold more than ``256 ** d`` different fingerprints. Inside a list the
pairs are verified by their differing bits. A list gives a spanning forest of its links and never all its pairs.

The near-duplicate stage links other fingerprints, those of the different words of a text: two texts
link if they differ in at most FAR bits, and if the fingerprints of their different pairs of words, which
aren't indexed, differ in at most CHECKED bits. Bytes would guarantee one that is shared, so its index
has BANDS narrower bands, of which ``BANDS - FAR`` are always shared. Two texts of which a word in
fifty was replaced have about 0.8 of their shingles of five words in common, but nearly all of their words.

Rows with equal fingerprints are one entry of the index, so copies cost nothing. Components are
found by alternating star contractions over tables in the shared folder.

Defined cases: a null or empty text has fingerprint zero and links like any other; repeated rows
give repeated rows; a null doc_id is never a component_id while its group has another id, and the
component_id of a group without any id is null; extra columns of the input are not used. Ids have
to be below 2**62.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import LOWER, arrow_rows, free_names, hash_of_rows, keep_only, materialize, table

#: Words of a shingle, the hash seed, and the most differing bits of a link.
WORDS, SEED, BITS = 3, 42, 2
#: The stage: words of a shingle, bands of the index and differing bits of a link; words and differing bits of the second fingerprint.
STAGE_WORDS, BANDS, FAR, CHECK_WORDS, CHECKED = 1, 10, 7, 2, 12
#: Lists up to this size are compared pair by pair, larger ones by looking up their neighbours.
DENSE = 64
_NO_ID = 1 << 62


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> list[int]:
    """Hashes of all word shingles of a text, repeats included; a shorter text is one shingle."""
    found = text.translate(LOWER).split()
    if not found:
        return []
    line = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(line, seed)]
    ends = list(accumulate(len(w) + 1 for w in found))
    digest = xxhash.xxh64_intdigest
    return [digest(line[a : b - 1], seed) for a, b in zip([0, *ends], ends[words - 1 :])]


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """Bit by bit the strict majority of the shingle hashes."""
    hashes = shingle_hashes(text or b"", words, seed)
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def stage_prints(text: bytes | None) -> tuple[int, int]:
    """Fingerprints of the different words and of the different pairs of words of a text, in little memory for a very long one."""
    found = (text or b"").translate(LOWER).split()
    out = []
    for words in (STAGE_WORDS, CHECK_WORDS):
        if words == 1:
            hashes = (xxhash.xxh64_intdigest(w, SEED) for w in set(found))
        else:
            last = max(len(found) - words + 1, min(len(found), 1))
            hashes = (xxhash.xxh64_intdigest(b" ".join(found[i : i + words]), SEED) for i in range(last))
        different = np.unique(np.fromiter(hashes, np.uint64))
        ones = np.zeros(64, np.int64)
        for start in range(0, len(different), 8192):
            part = different[start : start + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(different), bitorder="little").view("<u8")[0]) if len(different) else 0)
    return out[0], out[1]


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row, without a shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield arrow_rows(schema, {"doc_id": batch.column(0), "fp": pa.array(prints.view(np.int64))})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def _roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each member's component, for links between 0 .. n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _links(members: np.ndarray, masks: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the sorted, different ``members`` of a list that are links."""
    if len(members) <= DENSE:
        left, right = np.triu_indices(len(members), 1)
    else:
        at = [np.searchsorted(members, members ^ m) for m in masks]
        left = np.tile(np.arange(len(members)), len(masks))
        right = np.minimum(np.concatenate(at), len(members) - 1)
        hit = members[right] == members[left] ^ np.repeat(masks, len(members))
        left, right = left[hit], right[hit]
    near = np.bitwise_count(members[left] ^ members[right]) <= bits
    return left[near], right[near]


def _masks(free: tuple[int, ...], bits: int) -> np.ndarray:
    """All ways to flip 1 .. ``bits`` bits inside the byte positions ``free``."""
    places = [8 * p + k for p in free for k in range(8)]
    return np.array([sum(1 << x for x in c) for n in range(1, bits + 1) for c in combinations(places, n)], dtype=np.uint64)


def _tree(members: np.ndarray, checks: np.ndarray, bits: int, checked: int, lower: np.ndarray = np.zeros(0, np.uint64)) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what the links of a list connect, without what pairs that share a band of ``lower`` connect.

    Who isn't reached yet is compared with one reached member at a time. Members that such links connect are one group
    from the start, reached together.
    """
    def near(at: int, rest: np.ndarray) -> np.ndarray:
        return (np.bitwise_count(members[rest] ^ members[at]) <= bits) & (np.bitwise_count(checks[rest] ^ checks[at]) <= checked)

    group = np.arange(len(members))
    rest = np.arange(len(members) if len(lower) else 0)
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        first = reached[0]
        while reached and len(rest):
            at = reached.pop()
            found = near(at, rest) & _shares(members[rest] ^ members[at], lower)
            group[rest[found]] = first
            reached += rest[found].tolist()
            rest = rest[~found]
    order = np.argsort(group, kind="stable")
    ends = np.r_[np.flatnonzero(np.diff(group[order])) + 1, len(order)]
    mates = {int(group[order[lo]]): order[lo:hi] for lo, hi in zip(np.r_[0, ends[:-1]], ends)} if len(order) else {}
    left, right = [], []
    rest = np.arange(len(members))
    while len(rest):
        reached = mates[int(group[rest[0]])].tolist()
        rest = rest[group[rest] != group[rest[0]]]
        while reached and len(rest):
            at = reached.pop()
            found = np.unique(group[rest[near(at, rest)]])
            if len(found):
                left += [at] * len(found)
                right += found.tolist()
                for g in found.tolist():
                    reached += mates[g].tolist()
                rest = rest[~np.isin(group[rest], found)]
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def _shares(differ: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """Whether one of the masks ``bands`` meets no differing bit."""
    out = np.zeros(len(differ), dtype=bool)
    for mask in bands:
        out |= (differ & mask) == 0
    return out


def _bands(n: int) -> list[int]:
    """Masks of ``n`` bands of consecutive bits, as wide as each other or wider by one; eight are the bytes."""
    edges = [64 * k // n for k in range(n + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]


def _small_lists(new: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions inside lists that begin at ``new``, by their distance."""
    for k in range(1, int(sizes.max(initial=1))):
        new, sizes = new[sizes > k], sizes[sizes > k]
        room = sizes - k
        left = np.repeat(new - np.r_[0, np.cumsum(room)[:-1]], room) + np.arange(room.sum())
        yield left, left + k


def link_forest(distinct: DataFrame, bits: int = BITS, bands: int = 8, checked: int | None = None) -> DataFrame:
    """Links between different fingerprints (columns fp, node, and check with ``checked``) as edges u > v of nodes that connect the same groups.

    Fingerprints link if they differ in at most ``bits`` bits, and their checks in at most ``checked`` bits. Of
    ``bands`` bands they then share ``bands - bits``, so no link is left out. With ``checked``, a link belongs to the first list
    in which its two meet. What links of earlier lists connect inside a list is connected by those lists, so
    only what connects such groups is given, once, and a group of near copies gives few edges in all its lists together.
    """
    masked = _bands(bands)
    kept = list(combinations(range(bands), bands - bits))
    entries = F.array(*[
        F.struct(F.lit(k).cast("short").alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(sum(masked[p] for p in c)))).alias("bytes"))
        for k, c in enumerate(kept)
    ])
    columns = ["fp", "node", "check"] if checked is not None else ["fp", "node"]
    lists = distinct.select(*columns, F.explode(entries).alias("list")).select("list.part", "list.bytes", *columns)
    dealt = lists.repartition("part", "bytes").sortWithinPartitions("part", "bytes", "fp")
    masks = [_masks(tuple(sorted(set(range(8)) - set(c))), bits) for c in kept] if checked is None else []
    # of a list: the other bands before its last one; who shares one of them has met in an earlier list
    lower = [np.array([masked[p] for p in range(c[-1]) if p not in c], dtype=np.uint64) for c in kept]
    earlier = np.zeros((len(kept), bands), dtype=bool)
    for k, c in enumerate(kept):
        earlier[k, [p for p in range(c[-1]) if p not in c]] = True
    band_masks = np.array(masked, dtype=np.uint64)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def checked_edges(part, new, sizes, prints, nodes, checks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        small = sizes <= DENSE
        links = [np.zeros((2, 0), np.int64)]
        for left, right in _small_lists(new[small], sizes[small]):
            near = (np.bitwise_count(prints[left] ^ prints[right]) <= bits) & (np.bitwise_count(checks[left] ^ checks[right]) <= checked)
            links.append(np.array([left[near], right[near]]))
        left, right = np.concatenate(links, axis=1)
        met = (((prints[left] ^ prints[right])[:, None] & band_masks == 0) & earlier[part[left]]).any(axis=1)
        group = _roots(left[met], right[met], len(part))
        low = _roots(group[left[~met]], group[right[~met]], len(part))
        moved = np.flatnonzero(low != np.arange(len(part)))
        yield nodes[moved], nodes[low[moved]]
        for start, size in zip(new[~small], sizes[~small]):
            left, right = _tree(prints[start : start + size], checks[start : start + size], bits, checked, lower[part[start]])
            yield nodes[start + left], nodes[start + right]

    def edges_of(part, keys, prints, nodes, *checks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        new = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (keys[1:] != keys[:-1])])
        sizes = np.diff(np.r_[new, len(part)])
        if checks:
            yield from checked_edges(part, new, sizes, prints, nodes, checks[0])
            return
        pairs = new[sizes == 2]
        near = np.bitwise_count(prints[pairs] ^ prints[pairs + 1]) <= bits
        yield nodes[pairs[near]], nodes[pairs[near] + 1]
        for start, size in zip(new[sizes > 2], sizes[sizes > 2]):
            order = start + np.argsort(prints[start : start + size])
            left, right = _links(prints[order], masks[part[start]], bits)
            if len(left):
                low = _roots(left, right, size)
                moved = np.flatnonzero(low != np.arange(size))
                yield nodes[order[moved]], nodes[order[low[moved]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            now = [x.view(np.uint64) if k in (2, 4) else x for k, x in enumerate(now)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [x[cut:] for x in now]
            if cut:
                yield from out(edges_of(*(x[:cut] for x in now)))
        if held is not None:
            yield from out(edges_of(*held))

    def out(found) -> Iterator[pa.RecordBatch]:
        got = [(np.maximum(u, v), np.minimum(u, v)) for u, v in found if len(u)]
        if got:
            u, v = (np.concatenate(x) for x in zip(*got))
            yield arrow_rows(schema, {"u": pa.array(u), "v": pa.array(v)})

    return dealt.mapInArrow(run, "u long, v long").distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node for every node of ``edges`` (u, v): columns node, root.

    Large-star and small-star steps in turn until the edges no longer change. Every step is a
    table in the shared folder, so a join of a hub has two dealt sides that Spark can split.
    """
    edges = materialize(edges, "edges")
    before = None
    while True:
        for large in (True, False):
            if large:
                both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            else:
                both = edges
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            least = materialize(least, "least")
            joined = both.join(least, "u")
            if large:
                step = joined.filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                step = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
                    least.select("u", F.col("m").alias("v"))
                )
            edges = materialize(step.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs`` (doc_id, text)."""
    prints = materialize(fingerprints(docs, words, seed), "prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("node")).select(
        # rows without an id get a node beyond all ids, so that they can still link others
        "fp", F.coalesce("node", F.lit(_NO_ID) + F.shiftrightunsigned("fp", 3)).alias("node")
    )
    distinct = materialize(distinct, "distinct")
    roots = components(link_forest(distinct, bits))
    least = materialize(
        distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root")), "roots"
    )
    return prints.join(least, "fp").select(
        "doc_id", "fp", F.when(F.col("root") < _NO_ID, F.col("root")).alias("component_id")
    )


def hex_of(fp: str):
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def row_groups(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` (two longs that tell rows apart), doc_id and root of every row of ``docs``; rows with one root are near-duplicates."""
    schema = pa.schema([(keys[0], pa.int64()), (keys[1], pa.int64()), ("doc_id", pa.int64()), ("fp", pa.int64()), ("check", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("simhash")
        for batch in batches:
            prints = np.array([stage_prints(t.as_py()) for t in batch.column(3)], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy())], schema=schema)

    rows = docs.select(*keys, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary"))
    prints = materialize(rows.mapInArrow(run, f"`{keys[0]}` long, `{keys[1]}` long, doc_id long, fp long, check long"), "prints")
    distinct = materialize(prints.select("fp", "check").distinct().withColumn("node", F.monotonically_increasing_id()), "distinct")
    roots = components(link_forest(distinct, FAR, BANDS, CHECKED))
    rooted = distinct.join(roots, "node", "left").select("fp", "check", F.coalesce("root", "node").alias("root"))
    return prints.join(materialize(rooted, "roots"), ["fp", "check"]).select(*keys, "doc_id", "root")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of each group of near-duplicates, by row and not by doc_id.

    It is the row with the smallest doc_id, rows without one last, and of several such rows with the
    smallest hash of its id and text. Rows of one doc_id with unlike texts are unlike rows and stay; of
    rows with equal id and text one stays, that with the smallest hash of its columns. Null and empty texts are
    one group. The columns, whatever their names, stay as they are; an empty table stays empty.
    """
    first, second, whole = free_names(docs, "k1", "k2", "row")
    keyed = docs.withColumns({first: F.xxhash64("doc_id", "text"), second: F.xxhash64(F.lit(1), "text", "doc_id")})
    # the columns that the fingerprints need, under names of their own
    bare = keyed.select("doc_id", "text", F.col(first).alias("k1"), F.col(second).alias("k2"))
    found = materialize(row_groups(bare, ["k1", "k2"]), "groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    best = found.groupBy("root").agg(F.min(order).alias("best")).select("root", F.col("best.k1").alias("b1"), F.col("best.k2").alias("b2"))
    rows = found.groupBy("root", "k1", "k2").agg(F.count("*").alias("n")).join(materialize(best, "best"), "root")
    rows = materialize(rows.select("k1", "k2", "n", ((F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2"))).alias("stays")), "rows")
    names = {"k1": first, "k2": second}
    # the rows that go are a share of all rows, so the join is a dealt one at every size
    gone = rows.filter(~F.col("stays")).select("k1", "k2").withColumnsRenamed(names).hint("merge")
    kept = keyed.join(gone, [first, second], "left_anti")
    repeated = rows.filter("stays and n > 1").select("k1", "k2").withColumnsRenamed(names)
    if not repeated.head(1):
        return kept.select(*docs.columns)
    kept = materialize(kept, "kept")
    # combined before it is dealt, so a row that is repeated very often gathers nowhere
    same = kept.join(repeated, [first, second], "left_semi")
    least = same.groupBy(first, second).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), hash_of_rows(same)).alias(whole))
    once = least.select(F.col(f"{whole}.*"))
    return kept.join(repeated, [first, second], "left_anti").select(*docs.columns).unionByName(once)
