"""Importance resampling against a plain loop over all features, and against its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from maskwright.llm import resample as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, rank string, weight int"


def features(text, runs):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def brute(docs, items, percent=10, least=20, runs=1, buckets=10_000, seed=2024):
    """docs: (doc_id, text); rows of (doc_id, n_features, weight, score, rank)."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in docs]), (t, items)):
        for x in texts:
            counts.update(map(bucket, features(x, runs)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets))))
    rows = []
    for i, x in docs:
        n, found = features(x, runs)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("runs,head", [(1, 30_000), (1, 3), (2, 40), (3, 500)])
def test_against_a_plain_loop(spark, sf, runs, head):
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()], 30, 20, runs, 999, 7)
    assert got(rs.resample(docs.repartition(3), items, 30, 20, runs, 999, 7, head)) == want
    assert sum(r[4] is not None for r in want) > 10


def test_query_and_sql(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()])
    query = rs.op11_resample(spark, sf)
    assert dict(query.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    assert got(query) == want
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    assert sorted((tuple(r) for r in con.execute(rs.OP11_SQL).fetchall()), key=str) == want


def test_head_is_whole_and_bounded(spark):
    texts = [" ".join([f"w{k}" for k in range(n % 7 + 1)] + [f"rare{n}x{k}" for k in range(30)]) for n in range(300)] + ["x" * 500 + " "] * 50
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    count = Counter(w for t in texts for w in t.split())
    total = sum(count.values())
    for head in (5, 50, 400):
        found = rs.frequent(docs, 1, head)
        must = {w.encode() for w, n in count.items() if n * head >= total and len(w) <= rs.LONGEST_HEAD}
        assert must <= set(found) and len(found) <= 2 * head
    assert (b"w0", b"w1") in rs.frequent(docs, 2, 60)


def test_summary_falls_short_by_its_bound():
    summary = rs.Frequent(20)
    stream = [f"a{k % 4}" if k % 3 else f"z{k}" for k in range(9000)]
    for k in range(0, 9000, 90):
        summary.add(stream[k : k + 90])
    for word, n in Counter(stream).items():
        assert n - 9000 / 20 <= summary.counts.get(word, 0) <= n
    assert len(summary.counts) <= 8 * 20


def test_defined_cases(spark):
    long = "Wörter über alles " * 40_000
    rows = [(1, None), (2, ""), (None, "a b c " * 9), (None, "a b c " * 9), (3, "a b c " * 9), (3, "a b c " * 9), (3, "d " * 25), (4, long), (5, "ÄB\x00c İ ſ K " * 8), (6, "few words")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    items = [(1, "a b", "y"), (2, None, "y"), (None, "über", "y")]
    target = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    assert got(rs.resample(docs, target, 60)) == brute(rows, [t for _, t, _ in items], 60)
    assert got(rs.resample(docs, target.limit(0), 100)) == brute(rows, [], 100)
    assert rs.resample(docs.limit(0), target).count() == 0
    # every row is drawn at most once, ranks have no gap
    ranks = [r.rank for r in rs.resample(docs, target, 100).collect() if r.rank is not None]
    assert sorted(ranks) == list(range(1, 8))


def test_drawn_documents_keep_their_columns(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    drawn = rs.drawn_documents(docs, items)
    want = {r[0] for r in got(rs.op11_resample(spark, sf)) if r[4] is not None}
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == want
    assert rs.drawn_documents(docs.limit(0), items).count() == 0
