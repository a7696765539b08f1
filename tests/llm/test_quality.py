"""The classifier: held-out accuracy, the training rule against a plain loop, defined cases."""

import zlib

import numpy as np

from maskwright.llm import quality as q


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in q.op2_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    held = [(labels[i], r.predicted) for i, r in rows.items() if r.held_out and i in labels]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_leader_is_ftrl():
    rng = np.random.default_rng(1)
    size = 20
    leader = q.Leader(size)
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        l1 = q.L1 if i < size else 0.0
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((q.BETA + n[i] ** 0.5) / q.ALPHA + q.L2)

    for _ in range(200):
        slots = np.sort(rng.choice(size, 4, replace=False))
        x = rng.random(4)
        y = int(rng.random() < 0.5)
        leader.learn(slots, x, y)
        w = {i: weight(i) for i in [*slots, size]}
        p = 1 / (1 + np.exp(-(sum(w[i] * v for i, v in zip(slots, x)) + w[size])))
        for i, v in [*zip(slots, x), (size, 1.0)]:
            g = (p - y) * v
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / q.ALPHA
            z[i] += g - s * w[i]
            n[i] += g * g
    assert np.allclose(leader.z, z) and np.allclose(leader.n, n)
    assert np.allclose(leader.weights(np.arange(size + 1)), [weight(i) for i in range(size + 1)])


def test_features_are_a_unit_vector_of_whole_texts():
    slots, x = q.features("Some words, some words!! " * 5000 + "end")
    assert np.isclose(np.dot(x, x), 1) and len(set(slots)) == len(slots)
    assert set(q.features("zyx")[0]) < set(q.features("some words zyx")[0]) | set(q.features("zyx")[0])
    for empty in (None, "", " \n"):
        assert len(q.features(empty)[0]) == 0


def test_table_starts_anew(monkeypatch):
    texts = [" ".join(f"w{i * 7 + k}" for k in range(9)) for i in range(60)]
    want = [q.features(t)[0].tolist() for t in texts]
    monkeypatch.setattr(q, "REMEMBERED", 20)
    small = q._Chunks()
    monkeypatch.setattr(q, "chunk_table", lambda: small)
    assert [q.features(t)[0].tolist() for t in texts] == want


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "", 9), (None, "a text", 9), (3, "w " * 60_000, 9)], "doc_id long, text string, label int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    w = q.train(q.labelled_rows(docs, none))
    assert not w.any()
    assert sorted((r.doc_id or -1, r.score) for r in q.score(docs, w).collect()) == [(-1, 0.5), (1, 0.5), (2, 0.5), (2, 0.5), (3, 0.5)]
    some = spark.createDataFrame([(1, 0), (3, 1), (3, 1), (3, None), (None, 0)], "doc_id long, quality int")
    w = q.train(q.labelled_rows(docs, some))
    assert len(q.score(docs, w).collect()) == 5
    assert q.score(docs.limit(0), w).count() == 0


def test_stage_drops_what_is_rejected(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = q.quality_stage(spark, docs, sf)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in q.op2_quality(spark, sf).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == want
