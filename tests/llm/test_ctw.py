"""Context-tree weighting against its recursion, the base against counting, defined cases."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from maskwright.llm import ctw


def levels_of(texts, depth, least=0):
    keys, n = ctw.added(ctw.stretches(texts, depth)[0], np.ones(sum(len(t) + 1 for t in texts), np.int64))
    out = []
    for d in range(depth + 1):
        k, c = ctw.added(keys & ctw.mask(d + 1), n)
        context = k >> np.uint64(8)
        total = dict(zip(*(x.tolist() for x in ctw.added(context, c))))
        keep = np.array([total[x] >= least for x in context.tolist()], dtype=bool)
        out.append((k[keep], c[keep]))
    return out


def plain_bits(texts, query, depth, least=0):
    """Every node as a dictionary entry, every weight by its definition."""
    counts = [defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]
    seen = [Counter() for _ in range(depth + 1)]
    for t in texts:
        line = b"\xff" * depth + t.lower() + b"\xff"
        for i in range(depth, len(line)):
            for d in range(depth + 1):
                context = line[i - d : i]
                seen[d][context] += 1
                for level in range(8):
                    counts[d][context, 1 << level | line[i] >> (8 - level)][line[i] >> (7 - level) & 1] += 1

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted, weight = {}, {}
    for d in range(depth, -1, -1):
        below = defaultdict(list)
        if d < depth:
            for (context, node), ab in counts[d + 1].items():
                below[context[1:], node].append((context, ab))
        for (context, node), (a, b) in counts[d].items():
            own = kt(a, b)
            if d == depth:
                weighted[context, node], weight[context, node] = own, 1.0
                continue
            children, cut = 0.0, [0, 0]
            for child, (x, y) in below[context, node]:
                if seen[d + 1][child] >= least:
                    children += weighted[child, node]
                else:
                    cut = [cut[0] + x, cut[1] + y]
            if sum(cut):
                children += kt(*cut)
            whole = np.logaddexp(own, children) - math.log(2)
            weighted[context, node], weight[context, node] = whole, math.exp(own - math.log(2) - whole)

    def p_one(line, i, node, d):
        context = line[i - d : i]
        a, b = counts[d][context, node]
        own = (b + 0.5) / (a + b + 1)
        deeper = line[i - d - 1 : i]
        if d == depth or (deeper, node) not in counts[d + 1] or seen[d + 1][deeper] < least:
            return own
        w = weight[context, node]
        return w * own + (1 - w) * p_one(line, i, node, d + 1)

    line = b"\xff" * depth + query.lower() + b"\xff"
    bits = 0.0
    for i in range(depth, len(line)):
        for level in range(8):
            node = 1 << level | line[i] >> (8 - level)
            p = p_one(line, i, node, 0) if (b"", node) in counts[0] else 0.5
            bits -= math.log2(p if line[i] >> (7 - level) & 1 else 1 - p)
    return bits


TEXTS = [b"abracadabra", b"the cat sat on the mat", b"", b"The THE the", "daß öde Bäume".encode(), b"cab"]


@pytest.mark.parametrize("depth,least", [(0, 0), (1, 0), (3, 0), (3, 2), (2, 4)])
def test_tree_follows_its_definition(depth, least):
    levels = levels_of(TEXTS, depth, least)
    tree = ctw.Tree(ctw.grown(levels), levels[-1][0])
    queries = [*TEXTS, b"zebra", b"the mad cat", "ß".encode(), b"\x00\x01"]
    want = [plain_bits(TEXTS, q, depth, least) for q in queries]
    assert np.allclose(tree.bits(queries), want, rtol=1e-5)


def test_bytes_after_a_context_add_up_to_one():
    levels = levels_of(TEXTS, 3)
    tree = ctw.Tree(ctw.grown(levels), levels[-1][0])
    for context in (b"the", b"xyz", b"\xff\xffa", b"at "):
        keys = np.array([int.from_bytes(context + bytes([b])) for b in range(256)], dtype=np.uint64)
        assert math.isclose((2.0 ** -tree.slow(keys)).sum(), 1, rel_tol=1e-5)


@pytest.mark.parametrize("n", [2 * 10**7, 10**9])
def test_a_zero_after_ones_only_has_a_length(n):
    # the byte 255 and nothing else: each of its eight decisions has seen ones only
    levels = [(np.array([(1 << 8 * d) - 1 << 8 | 255], dtype=np.uint64), np.array([n], dtype=np.int64)) for d in range(2)]
    tree = ctw.Tree(ctw.grown(levels), levels[-1][0])
    bits = tree.slow(np.array([255 << 8 | 254, 255 << 8 | 127, 255 << 8 | 255], dtype=np.uint64))
    # after the first zero of 127 the path has no node: one bit each
    assert np.allclose(bits[:2], math.log2(2 * (n + 1)) + np.array([0, 7]), rtol=1e-5) and 0 < bits[2] < 1e-5


def plain_base(train, text):
    words = lambda t: [w for w in t.translate(ctw.LOWER).split()] + [None]
    counts = Counter(w for t in train for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return (sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(text)), len(words(text)), sum(counts[w] > 0 for w in words(text)), n)


@pytest.mark.parametrize("frequent,nodes", [(50, 700_000), (100_000, 3_000)])
def test_scores(spark, sf, frequent, nodes):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in ctw.score(docs, ctw.fold_of(docs.doc_id) != 1, 3, nodes, frequent).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    assert got.keys() == texts.keys()
    levels = levels_of(train, 3)
    if nodes < sum(len(k) for k, _ in levels):
        least = next(x for x in range(2, 10**6) if sum(len(k) for k, _ in levels_of(train, 3, x)) <= nodes)
        assert sum(len(k) for k, _ in levels_of(train, 3, least)) > 0
    else:
        tree = ctw.Tree(ctw.grown(levels), levels[-1][0])
        assert np.allclose([got[i].score for i in texts], -tree.bits(list(texts.values())) * math.log10(2), rtol=1e-5)
    counts = Counter(w for t in train for w in [*t.translate(ctw.LOWER).split(), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        words = [*t.translate(ctw.LOWER).split(), None]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)


def test_no_context_is_cut_off(spark, sf, monkeypatch):
    # full depth, chunks and blocks much smaller than the corpus: the same tree as that of all texts at once
    monkeypatch.setattr(ctw, "CHUNK", 20_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.score for r in ctw.score(docs, ctw.fold_of(docs.doc_id) != 1, 5, 2_000).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    levels = levels_of([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1], 5)
    assert sum(len(k) for k, _ in levels) > 2_000
    tree = ctw.Tree(ctw.grown(levels), levels[-1][0])
    assert np.allclose([got[i] for i in texts], -tree.bits(list(texts.values())) * math.log10(2), rtol=1e-5)


def test_defined_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (2, "", 0), (None, "a word", 0), (3, "w " * 60_000, 0), (7, "x" * 90_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = ctw.score(docs, ctw.fold_of(docs.doc_id) != 1, 2).collect()
    train = [(t or "").encode() for i, t, _ in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    want = sorted((str(i), *plain_base(train, (t or "").encode())) for i, t, _ in rows)
    for r, w in zip(sorted(got, key=lambda r: (str(r.doc_id), r.base_score)), want):
        assert (str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens) == (w[0], w[2], w[3], w[4]) and math.isclose(r.base_score, w[1], rel_tol=1e-9)
        assert r.score < 0
    none = ctw.score(docs, ctw.F.lit(False), 2).collect()
    assert sorted(r.score for r in none) == pytest.approx(sorted(-8 * math.log10(2) * (len(t or "") + 1) for _, t, _ in rows))
    assert all(r.base_score == 0 and r.n_known == 0 for r in none)
    assert ctw.score(docs.limit(0), ctw.F.lit(True), 2).count() == 0
