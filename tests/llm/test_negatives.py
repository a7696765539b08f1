"""Hard negatives against brute force over all pairs, and against their SQL."""

import math

import duckdb
import numpy as np
import pytest

from maskwright.llm import negatives as ng


def brute(rows, positives=5, negatives=3, low=50, high=95, every=50):
    """rows: (vec_id, list, label), labels as given."""
    fine = []
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fine.append((i, (y + 1) % 10 if i % 7 == 0 else y, [int(x) * 256 if abs(x) >= 2**53 else math.floor(256 * x) for x in v], v))
    out = []
    for a in sorted({f[0] for f in fine if f[0] % every == 0}):
        _, label, _, vector = min((f[0], f[1], f[3], f[2]) for f in fine if f[0] == a)[:4]
        scored = [(-sum(x * y for x, y in zip(vector, v)), i, y) for i, y, v, _ in fine if i != a]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            window = sorted(x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(window[:negatives])]
    return sorted(out)


def got(df):
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("sizes", [(16_384, 4_000_000, 1_024), (60, 4_000_000, 3), (100, 2_000, 1_024)])
def test_against_all_pairs(spark, sf, sizes):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute([(r.vec_id, list(r.embedding), r.label) for r in table.collect()])
    assert got(ng.mine(ng.usable(table), shard_rows=sizes[0], shard_values=sizes[1], block_rows=sizes[2])) == want and len(want) > 50


def test_sql_says_the_same(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got(ng.op13_negatives(spark, sf)) == sorted(con.execute(ng.OP13_SQL).fetchall())


@pytest.mark.parametrize("kind", ["dense", "sparse", "tied", "falling", "zero"])
def test_every_threshold_is_exact(kind):
    rng = np.random.default_rng(len(kind))
    x = rng.integers(-50, 51, (300, 20)).astype(float)
    if kind == "sparse":
        x *= rng.random(x.shape) < 0.15
    if kind == "tied":
        x = x % 2 * 3
    if kind == "falling":
        x = np.floor(x * 0.6 ** np.arange(20) * 40)
    if kind == "zero":
        x[::3] = 0
    lengths = rng.integers(0, 21, 300) if kind == "sparse" else np.full(300, 20)
    index = ng.Index([row[:n] for row, n in zip(x, lengths)])
    for k, n in enumerate(lengths):
        x[k, n:] = 0
    anchors = x[:24]
    scores = anchors @ x.T
    for share in (0.9, 0.5, 0.1, 0.0, -0.2, -math.inf):
        limits = scores.max(axis=1) * share if share > -math.inf else np.full(24, share)
        for a, (rows, found) in enumerate(index.reaching(index.arranged(list(anchors)), limits)):
            assert sorted(rows) == np.flatnonzero(scores[a] >= limits[a]).tolist()
            assert (found == scores[a][rows]).all()


def test_index_leaves_entries_out():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(500, 32)) * 0.8 ** np.arange(32) * 256)
    index = ng.Index(list(x))
    used = index.list_rest[:] >= 0.6 * index.norm
    assert used.mean() < 0.5


def test_defined_cases(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=3 + i % 4)], int(i % 3)) for i in range(1, 120)]
    rows += [rows[11], rows[48], (50, [0.5, 0.5, 0.1], 1), (50, [0.1, 0.9], 1), (200, None, 1), (250, [1.0], None), (None, [1.0], 1), (300, [], 2), (350, [float("nan")], 1),
             (400, [None, 1.0], 2), (450, [float("inf")], 1), (500, [-3.0, -1.0, 2.0], 4), (0, [0.25], 9), (121, [1.0, 0.0, 0.0], 2)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rank string")
    assert got(ng.mine(ng.usable(frame), shard_rows=50, block_rows=2)) == brute(rows)
    assert ng.mine(ng.usable(frame.limit(0))).count() == 0
    assert ng.mine(ng.usable(frame.filter("vec_id = 50"))).count() == 0


def test_ties_copies_and_one_label(spark):
    rows = [(i, [1.0, 0.5], i % 2) for i in range(300)] + [(i, [0.75, 0.4], 5) for i in range(300, 420)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute(rows)
    assert got(ng.mine(ng.usable(frame), shard_rows=64)) == want and want
    alike = frame.selectExpr("vec_id + 1 as vec_id", "embedding", "3 as label").filter("vec_id % 7 != 0")
    assert ng.mine(ng.usable(alike)).count() == 0


def test_large_and_very_long_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.integers(-9, 10, 5) * 10.0 ** (0, 3)[i % 2]], int(i % 3)) for i in range(60)]
    rows += [(100, [65_536.0, 0.0, 1.0], 1), (101, [0.0, 0.0, 1e6], 1), (103, [0.0] * 20_000 + [3.0], 2), (150, [1e5] + [0.0] * 30_000 + [1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(ng.mine(ng.usable(frame), shard_rows=20)) == brute(rows)
    huge = [*rows, (104, [1e6, 1.0], 1)]
    wide = [(i, [x * 1e3 for x in v], y) for i, v, y in huge if i < 60 or i == 104]
    frame = spark.createDataFrame(wide, "vec_id long, embedding array<double>, label int")
    assert got(ng.mine(ng.usable(frame), shard_rows=20)) == brute(wide)


def test_a_score_beyond_a_long_is_an_error(spark):
    rows = [(0, [1e9], 2), (1, [1e9], 3), (2, [5e8], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="does not fit a long"):
        ng.mine(ng.usable(frame)).collect()
