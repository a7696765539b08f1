"""SimHash groups against brute force over all pairs."""

from itertools import combinations

import numpy as np
import pytest
import xxhash

from maskwright.llm import simhash


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_groups(prints):
    """prints: (doc_id, fp) pairs."""
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, p), (b, q) in combinations(prints, 2):
        if (p ^ q).bit_count() <= 2:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d: find(d) for d, _ in prints}


def test_query_matches_brute_force(spark, sf):
    rows = simhash.op10_simhash(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = [(d, brute_print(t)) for d, t in sorted(docs.items())]
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{p:016x}" for d, p in prints}
    assert {r.doc_id: r.component_id for r in rows} == brute_groups(prints)


@pytest.mark.parametrize("bits", [1, 2])
def test_links_of_random_prints(spark, bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2**63, 30, dtype=np.int64)
    prints = set()
    for b in base.tolist():
        prints.add(b)
        for _ in range(40):
            for x in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                b ^= 1 << x
            prints.add(b - (1 << 64) if b >= 1 << 63 else b)
    rows = [(p, n) for n, p in enumerate(sorted(prints))]
    frame = spark.createDataFrame(rows, "fp long, node long")
    got = {r.node: r.root for r in simhash.components(simhash.link_forest(frame, bits)).collect()}
    mask = (1 << 64) - 1
    root = {n: n for _, n in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (p, a), (q, b) in combinations(rows, 2):
        if ((p & mask) ^ (q & mask)).bit_count() <= bits:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert {n: got.get(n, n) for _, n in rows} == {n: find(n) for _, n in rows}


def test_large_lists_use_neighbours():
    rng = np.random.default_rng(5)
    members = np.unique(rng.integers(0, 1 << 16, 300).astype(np.uint64))
    masks = simhash._masks((0, 1), 2)
    got = {frozenset(x) for x in zip(*(a.tolist() for a in simhash._links(members, masks, 2)))}
    want = {frozenset((i, j)) for i, j in combinations(range(len(members)), 2) if (int(members[i]) ^ int(members[j])).bit_count() <= 2}
    assert got == want


def test_defined_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(5, None, "x"), (3, "", "x"), (9, " \n", "x"), (7, "One two", "y"), (8, "one TWO", "y"), (8, "one TWO", "y"),
            (None, "one two", "z"), (11, long, "z"), (12, long, "z"), (None, "unlike all else", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    want = [(5, 3), (3, 3), (9, 3), (7, 7), (8, 7), (8, 7), (-1, 7), (11, 11), (12, 11), (-1, None)]
    assert got == sorted(want, key=str)
    # the stage decides by rows: the copy without an id goes, the other text without an id stays
    kept = simhash.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7, 11]
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.dedup_stage(spark, empty, "").count() == 0


def brute_stage(rows):
    """rows: (doc_id, text); the kept ones, by the rule of the stage over all pairs."""
    def prints(text, words):
        w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        found = {xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), seed=42) for i in range(max(1, len(w) - words + 1))} if w else set()
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))

    n = len(rows)
    fps = [(prints(t, 1), prints(t, 2)) for _, t in rows]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(n), 2):
        x, y = fps[i][0] ^ fps[j][0], fps[i][1] ^ fps[j][1]
        if x.bit_count() <= 7 and y.bit_count() <= 12:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(i)
    return groups


def near_copies(seed, groups=40, copies=5, length=120):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        words = [f"w{x}" for x in rng.integers(0, 4000, length)]
        for c in range(copies):
            mine = list(words)
            for at in rng.integers(0, length, c):
                mine[at] = f"new{g}x{c}x{at}"
            rows.append((1000 * g + c, " ".join(mine)))
    return rows


def test_stage_against_all_pairs(spark):
    rows = near_copies(3) + [(90_000 + i, f"a few words {i}") for i in range(30)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, root string")
    got = {r.doc_id for r in simhash.dedup_stage(spark, docs.repartition(3), "").collect()}
    groups = brute_stage(rows)
    assert got == {min(rows[i][0] for i in members) for members in groups.values()}
    # near copies go, unlike texts stay
    assert sum(i < 90_000 and i % 1000 > 0 for i in got) <= 16 and sum(i >= 90_000 for i in got) == 30


def test_tree_connects_what_is_linked():
    rng = np.random.default_rng(8)
    members = rng.integers(0, 1 << 12, 200).astype(np.uint64)
    checks = rng.integers(0, 1 << 4, 200).astype(np.uint64)
    left, right = simhash._tree(members, checks, 2, 1)
    linked = [(i, j) for i, j in combinations(range(200), 2)
              if (int(members[i]) ^ int(members[j])).bit_count() <= 2 and (int(checks[i]) ^ int(checks[j])).bit_count() <= 1]
    assert {frozenset(x) for x in zip(left.tolist(), right.tolist())} <= {frozenset(x) for x in linked}
    want = simhash._roots(*(np.array(x) for x in zip(*linked)), 200)
    assert (simhash._roots(left, right, 200) == want).all() and len(left) == 200 - len(set(want.tolist()))


def test_stage_keeps_unlike_texts_of_one_id(spark):
    a, b, c = "one text of its own " * 9, "quite another story about ships " * 9, "the third of them tells nothing new " * 9
    schema = "doc_id long, text string, k1 string, K2 string, _key int"
    run = lambda rows: sorted(((r.doc_id, r.text) for r in simhash.dedup_stage(spark, spark.createDataFrame(rows, schema), "").collect()), key=str)
    assert run([(5, a, "x", "y", 1), (7, a, "x", "y", 1), (7, b, "x", "y", 1)]) == [(5, a), (7, b)]
    assert run([(1, a, "x", "y", 1), (1, c, "x", "y", 1)]) == [(1, a), (1, c)]
    # copies without an id: one stays, or none beside a row with an id
    assert run([(None, a, "x", "y", 1), (None, a, "x", "y", 1), (None, b, "x", "y", 1)]) == sorted([(None, a), (None, b)], key=str)
    assert run([(None, a, "x", "y", 1), (9, a, "x", "y", 1)]) == [(9, a)]
    # rows of equal id and text: always the same one stays
    rows = [(4, a, "x", "y", n) for n in range(6)] + [(4, a, None, None, None)]
    kept = {tuple(r) for k in range(3) for r in simhash.dedup_stage(spark, spark.createDataFrame(rows[k:] + rows[:k], schema).repartition(k + 1), "").collect()}
    assert len(kept) == 1 and kept <= set(rows)
    kept = simhash.dedup_stage(spark, spark.createDataFrame(rows, schema), "")
    assert kept.columns == ["doc_id", "text", "k1", "K2", "_key"] and kept.count() == 1


def test_stage_links_are_all_within_its_bits(spark):
    """Every pair within the bits of the stage is connected, also one that shares a single byte."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 60, dtype=np.int64).astype(np.uint64)
    # one bit in each of seven bytes: a single byte is shared
    spread = np.uint64(sum(1 << 8 * k + 3 for k in range(7)))
    prints = [(int(b), int(c)) for b, c in zip(base, rng.integers(0, 2**62, 60))]
    prints += [(f ^ int(spread), c ^ 0b111) for f, c in prints[:20]]
    for f, c in prints[20:50]:
        flips = sum(1 << int(x) for x in rng.choice(64, rng.integers(1, 10), replace=False))
        prints.append((f ^ flips, c ^ sum(1 << int(x) for x in rng.choice(62, rng.integers(1, 15), replace=False))))
    prints += [(prints[0][0] ^ k, prints[0][1]) for k in range(1, 150)]
    prints = sorted(set(prints))
    rows = [(simhash._signed(f), n, c) for n, (f, c) in enumerate(prints)]
    frame = spark.createDataFrame(rows, "fp long, node long, check long")
    got = {r.node: r.root for r in simhash.components(simhash.link_forest(frame, simhash.FAR, simhash.BANDS, simhash.CHECKED)).collect()}
    linked = [(i, j) for i, j in combinations(range(len(prints)), 2)
              if (prints[i][0] ^ prints[j][0]).bit_count() <= 7 and (prints[i][1] ^ prints[j][1]).bit_count() <= 12]
    want = simhash._roots(*(np.array(x) for x in zip(*linked)), len(prints)).tolist()
    assert {n: got.get(n, n) for n in range(len(prints))} == dict(enumerate(want))


@pytest.mark.parametrize("apart", [1, 3])
def test_near_copies_give_few_edges(spark, apart):
    """A group of near copies meets in most of the 120 lists, large and small, and gives about an edge for each of its members in all of them."""
    rng = np.random.default_rng(apart)
    prints = {(0, 0)}
    while len(prints) < 600:
        flips = [sum(1 << int(x) for x in rng.choice(62, rng.integers(0, most + 1), replace=False)) for most in (apart, 4)]
        prints.add((0x123456789ABCDEF ^ flips[0], flips[1]))
    rows = [(f, n, c) for n, (f, c) in enumerate(sorted(prints))]
    edges = simhash.link_forest(spark.createDataFrame(rows, "fp long, node long, check long"), simhash.FAR, simhash.BANDS, simhash.CHECKED)
    assert edges.count() <= 3 * len(rows)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    linked = [(i, j) for i, j in combinations(range(len(rows)), 2)
              if (rows[i][0] ^ rows[j][0]).bit_count() <= 7 and (rows[i][2] ^ rows[j][2]).bit_count() <= 12]
    want = simhash._roots(*(np.array(x) for x in zip(*linked)), len(rows)).tolist()
    assert {n: got.get(n, n) for n in range(len(rows))} == dict(enumerate(want))


def test_tree_leaves_out_what_earlier_lists_connect():
    rng = np.random.default_rng(9)
    members = rng.integers(0, 1 << 12, 200).astype(np.uint64)
    checks = rng.integers(0, 1 << 4, 200).astype(np.uint64)
    lower = np.array([0b111, 0b111000], dtype=np.uint64)
    linked = [(i, j) for i, j in combinations(range(200), 2)
              if (int(members[i]) ^ int(members[j])).bit_count() <= 2 and (int(checks[i]) ^ int(checks[j])).bit_count() <= 1]
    early = [(i, j) for i, j in linked if any((int(members[i]) ^ int(members[j])) & int(m) == 0 for m in lower)]
    of = lambda pairs: simhash._roots(*np.array(pairs).reshape(-1, 2).T, 200)
    left, right = simhash._tree(members, checks, 2, 1, lower)
    assert (of(early + list(zip(left.tolist(), right.tolist()))) == of(linked)).all()
    assert len(left) == len(set(of(early).tolist())) - len(set(of(linked).tolist()))
