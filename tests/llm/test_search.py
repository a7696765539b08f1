"""Top-k search against brute force."""

import math

import duckdb
import numpy as np
import pytest

from maskwright.llm import search


def brute(rows, every, k):
    """rows: (vec_id, list)."""
    fine = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fine.append((i, [math.floor(256 * x) if abs(x) < 2**53 else int(x) * 256 for x in v], v))
    out = set()
    for q in sorted({i for i, _, _ in fine if i % every == 0}):
        query = min((raw, v) for i, v, raw in fine if i == q)[1]
        scored = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v, _ in fine if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("shards,blocks", [(10_000, 10_000), (40, 3)])
def test_query_against_brute_force(spark, sf, shards, blocks):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    v = search.integer_vectors(table)
    got = search.top_k(v, v.filter("vec_id % 50 = 0"), 5, shards, blocks).collect()
    assert {tuple(r) for r in got} == brute(rows, 50, 5) and len(got) == len(set(map(tuple, got)))


def test_sql_says_the_same(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    cursor = con.execute(search.OP1_SQL)
    names = [d[0] for d in cursor.description]
    want = {tuple(dict(zip(names, r))[c] for c in ("query_id", "rank", "vec_id", "score")) for r in cursor.fetchall()}
    assert {tuple(r) for r in search.op1_maxscore(spark, sf).collect()} == want


@pytest.mark.parametrize("kind", ["sparse", "negative", "tied", "dense"])
def test_maxscore_is_exact(kind):
    rng = np.random.default_rng(len(kind))
    x = rng.integers(-40, 41, (400, 24))
    if kind == "sparse":
        x *= rng.random(x.shape) < 0.1
    if kind == "negative":
        x = np.where(np.arange(400)[:, None] % 50 == 0, -np.abs(x), np.abs(x))
    if kind == "tied":
        x = x % 2 * 3
    ids = rng.permutation(400)
    postings = search.Postings(ids, list(x))
    for q in range(0, 400, 7):
        query = x[int(np.flatnonzero(ids == q)[0])]
        got = postings.best(q, query, 5)
        want = sorted((-int(s), int(i)) for i, s in zip(ids, x @ query) if i != q)[:5]
        assert [(-s, i) for i, s in zip(*map(np.ndarray.tolist, got))] == want


def test_defined_cases(spark):
    rows = [(0, [1.0, 0.5], "a"), (0, [0.5, 0.25], "a"), (50, [-1.0], "a"), (1, None, "a"), (2, [], "a"), (3, [None, 1.0], "a"), (4, [float("nan")], "a"),
            (5, [float("inf")], "a"), (None, [1.0, 1.0], "a"), (7, [1.0, 1.0], "a"), (7, [1.0, 1.0], "a"), (8, [0.25, -3.0, 9.0], "a"), (100, [], "a")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    v = search.integer_vectors(frame)
    got = sorted(map(tuple, search.top_k(v, v.filter("vec_id % 50 = 0")).collect()))
    # empty vectors are queries and candidates like any other
    want = brute([(i, x) for i, x, _ in rows], 50, 5)
    assert {r[3] for r in want if r[0] == 100} == {0} and any(r[2] == 2 for r in want)
    # the repeated row 7 is two candidates
    assert set(got) == want and [g[2] for g in got if g[0] == 0].count(7) == 2
    assert search.top_k(v.limit(0), v.limit(0)).count() == 0
    assert search.top_k(v.filter("vec_id = 50"), v.filter("vec_id = 50")).count() == 0


def test_large_components_take_part(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-9, 10, 6) * 10.0 ** (0, 2, 4, 5)[i % 4]]) for i in range(60)]
    rows += [(100, [65_536.0, 0.0, 0.0, 0.0, 0.0, 1.0]), (101, [0.0] * 6 + [1e15]), (102, [1e6, -1e6, 1e6, 0.0, 0.0, 0.5])]
    v = search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = search.top_k(v, v.filter("vec_id % 50 = 0 or vec_id = 7"), 5, 20, 2).collect()
    want = brute(rows, 50, 5) | {r for r in brute(rows, 7, 5) if r[0] == 7}
    assert {tuple(r) for r in got} == want and any(r[2] == 102 for r in want)


def test_a_score_beyond_a_long_is_an_error(spark):
    rows = [(0, [1e9]), (1, [1e9]), (2, [-1e9]), (3, [1.0])]
    v = search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="does not fit a long"):
        search.top_k(v, v.filter("vec_id = 0"), 1).collect()
    # 2 has no place among the two best
    got = search.top_k(v.filter("vec_id <> 1"), v.filter("vec_id = 0"), 1).collect()
    assert [tuple(r) for r in got] == [(0, 1, 3, 256 * 256 * 10**9)]


def test_any_finite_vector_takes_part(spark):
    rows = [(0, [1.0, 0.5]), (50, [0.0, 0.0, 0.0, 2.0]), (1, [0.0, 0.0, 3e38]), (2, [0.0, 0.0, -1.7e308, 4.0]), (3, [2.0, 1.0]), (4, [-1e300, 1e10])]
    v = search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    # what is huge meets a zero, or is so low that it has no place
    got = search.top_k(v, v.filter("vec_id in (0, 50)"), 4, 2, 1).collect()
    want = {r for r in brute(rows, 50, 4)}
    assert {tuple(r) for r in got} == want and {r[2] for r in want} >= {1, 2}


def test_one_very_long_vector():
    rng = np.random.default_rng(6)
    vectors = [rng.integers(-9, 10, 8) for _ in range(2000)] + [rng.integers(-9, 10, 200_000)]
    postings = search.Postings(np.arange(2001), vectors)
    # the lists take room in proportion to the components, not rows times the longest vector
    assert postings.matrix.nbytes + postings.rows.nbytes + postings.values.nbytes < 8e6
    for q in (0, 7, 2000):
        got = postings.best(q, vectors[q], 5)
        want = sorted((-int(vectors[q][:8] @ v[:8]) if q < 2000 else -int(vectors[q][: len(v)] @ v), i) for i, v in enumerate(vectors) if i != q)[:5]
        assert [(-s, i) for i, s in zip(*map(np.ndarray.tolist, got))] == want
