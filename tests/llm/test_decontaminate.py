"""Benchmark passages in documents against a scan of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from maskwright.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    doc = words(text)
    hit, found = set(), set()
    for item, passage in items:
        w = words(passage)
        width = min(window, len(w))
        for k in range(len(w) - width + 1 if w else 0):
            for a in range(len(doc) - width + 1):
                if doc[a : a + width] == w[k : k + width]:
                    found.add(item)
                    hit |= set(range(a, a + width))
    listed = ",".join(sorted(str(i) for i in found if i is not None))
    return len(doc), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)


def test_query(spark, sf):
    rows = {r.doc_id: tuple(r)[1:6] for r in d.op3_decontaminate(spark, sf).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {}
    for item, passage in items:
        w = words(passage)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    seen = 0
    for doc in docs:
        w = words(doc.text)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                got = windows.get(tuple(w[a : a + n]))
                if got:
                    found |= got
                    hit |= set(range(a, a + n))
        seen += bool(hit)
        listed = ",".join(sorted(map(str, found)))
        assert rows[doc.doc_id] == (len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit))
    assert seen


@pytest.mark.parametrize("shard,block", [(1 << 20, 1 << 20), (60, 40)])
def test_random_texts(spark, monkeypatch, shard, block):
    rng = random.Random(shard)
    text = lambda n: " ".join(rng.choice("a b c dé E f".split()) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    items = [(i, text(rng.choice([0, 1, 3, 5, 6, 8]))) for i in range(12)] + [(3, "c c c c c"), (None, "b b b b b")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = d.build_index(frame, shard)
    monkeypatch.setattr(d, "build_index", lambda _: index)
    real = d.phrases_of
    monkeypatch.setattr(d, "phrases_of", lambda f, w: real(f, w, block))
    got = {r.doc_id: tuple(r)[1:6] for r in d.contamination(frame, spark.createDataFrame(items, "item_id long, text string"), 5).collect()}
    grouped = {}
    for i, passage in items:
        grouped.setdefault(i, []).append(passage)
    assert got == {i: brute(t, items, 5) for i, t in docs}


def test_near(spark):
    docs = spark.createDataFrame([(1, "x a x x b x c a b c"), (2, "a x x x b c")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "c a b")], "item_id long, text string")
    rows = {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in d.search(d.build_index(docs), d.phrases_of(items), near=4).collect()}
    assert rows == {1: [(4, 10)], 2: []}


def test_packing():
    rng = np.random.default_rng(3)
    for high in (3, 200, 70_000, 2**40):
        x = np.unique(rng.integers(1, high, 500))
        assert np.array_equal(d.unpack(d.pack(x)), x)


def test_defined_cases(spark):
    long = "w " * 50_000 + "the secret passage of ten words is put in here " + "w " * 50_000
    rows = [(1, None, 0), (2, "", 0), (3, long, 0), (3, long, 0), (None, "The SECRET passage, of ten words is put in here!", 0), (4, "clean", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    items = spark.createDataFrame([(1, None), (2, " .. "), (9, "the secret passage of ten words is put in here")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items) for r in d.contamination(docs, items).collect())
    assert got == [(-1, 10, 10, 1), (1, 0, 0, 0), (2, 0, 0, 0), (3, 100_010, 10, 1), (3, 100_010, 10, 1), (4, 1, 0, 0)]
    none = d.contamination(docs, items.limit(2)).collect()
    assert len(none) == 6 and not any(r.contaminated for r in none)
    assert d.contamination(docs.limit(0), items).count() == 0


def test_near_ends_with_the_document(spark):
    # red and fox meet only across the border of 1 and 2; both are within 3, and at its very start
    docs = spark.createDataFrame([(1, "one two red"), (2, "fox three four"), (3, "fox red")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(7, "red fox")], "item_id long, text string")
    rows = {r.doc_id: (r.item_ids, [(s.start, s.stop) for s in r.spans]) for r in d.search(d.build_index(docs), d.phrases_of(items), near=4).collect()}
    assert rows == {1: ([], []), 2: ([], []), 3: ([7], [(0, 2)])}
