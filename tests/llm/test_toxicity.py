"""Toxic passages: the segment scan against its definition, word ratios against counting, held-out accuracy, defined cases."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from maskwright.llm import toxicity as tox

INSULTS = ("trash", "idiot", "moron", "scum")


def by_definition(scores, start=0, end=None):
    """The best contiguous stretch, then the same to its left and to its right."""
    end = len(scores) if end is None else end
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(start, end) for b in range(a + 1, end + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    return [*by_definition(scores, start, a), (a, b), *by_definition(scores, b, end)]


@pytest.mark.parametrize("seed", range(12))
def test_scan_finds_all_maximal_segments(seed):
    rng = np.random.default_rng(seed)
    scores = np.round(rng.normal(-0.3 + 0.1 * (seed % 4), 1, 40), 6)
    found = tox.segments(scores)
    assert [(a, b) for a, b, _ in found] == by_definition(scores.tolist())
    assert all(math.isclose(s, scores[a:b].sum()) for a, b, s in found)


def test_scan_is_linear():
    # every candidate starts lower than the one before: a scan of the whole stack would be quadratic
    falling = np.tile([1.0, -1.5], 300_000)
    assert len(tox.segments(falling)) == 300_000
    assert tox.segments(np.zeros(0)) == [] and tox.segments(np.full(5, -1.0)) == []
    assert tox.segments(np.ones(5)) == [(0, 5, 5.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "part byte, label byte, text string")


def test_copies_count_once(spark):
    rows = [(0, 1, "a b a b c")] * 50 + [(0, 1, "x a b y")] + [(1, 0, "b"), (1, 0, None), (1, 0, "")]
    got = {(r.word, r.part, r.label): r.n for r in tox.counted(frame(spark, rows)).collect()}
    want = defaultdict(set)
    for part, label, text in rows:
        w = [None, *re.findall(r"\w+", text or ""), None]
        for k in range(1, len(w) - 1):
            want[w[k], part, label].add((w[k - 1], w[k + 1]))
    assert got == {k: len(v) for k, v in want.items()}


def test_ratios_follow_their_formula(spark):
    rows = [(k % 4, int(k % 3 == 0), f"n{k} {'bad' if k % 3 == 0 and k % 2 else 'good'} m{k} the o{k} the p{k}") for k in range(240)]
    counts = tox.counted(frame(spark, rows))
    cells = {(r.word, r.part, r.label): r.n for r in counts.collect()}
    got = tox.word_scores(counts)

    def ratio(word, parts):
        clean, toxic = (sum(cells.get((word, p, y), 0) for p in parts) for y in (0, 1))
        n_clean, n_toxic = (sum(n for (_, p, y), n in cells.items() if p in parts and y == label) for label in (0, 1))
        prior = max((clean + toxic) * tox.PRIOR / (n_clean + n_toxic), 1e-9)
        d = math.log((toxic + prior) / (n_toxic + tox.PRIOR - toxic)) - math.log((clean + prior) / (n_clean + tox.PRIOR - clean))
        sure = max(abs(d) - tox.CAUTION * math.sqrt(1 / (toxic + prior) + 1 / (clean + prior)), 0)
        return math.copysign(sure, d) if clean + toxic >= tox.LEAST else 0

    for word in ("bad", "good", "the", "n3"):
        want = [ratio(word, [p for p in range(4) if p != without]) for without in range(4)] + [ratio(word, range(4))]
        assert np.allclose(got.get(word, [0] * 5), want)
    assert got["bad"][-1] > 0 > got.get("good", [-1])[-1] and "n3" not in got


def test_tail_and_curve():
    rng = np.random.default_rng(1)
    clean = [(1000, rng.exponential(0.5, rng.poisson(3)).tolist()) for _ in range(2000)]
    tail = tox.fit_tail(clean)
    assert 1.8 < tail.decay < 2.4 and 0.0028 < tail.rate < 0.0032
    assert math.isclose(tail.expected(1.5, 2000), tail.rate * 2000 * math.exp(-1.5 * tail.decay))
    assert tail.evidence([], 10) == 0 == tail.evidence([0.1], 1000) < tail.evidence([9.0], 1000) < tail.evidence([9.0, 9.0], 1000)
    assert tail.evidence([9.0], 1000) > tail.evidence([9.0], 100_000)
    x = np.r_[np.zeros(90), np.full(10, 8.0)]
    bias, slope = tox.fit_curve(x, (x > 0).astype(float))
    assert slope > 0 and 1 / (1 + math.exp(-bias)) < 0.05 and 1 / (1 + math.exp(-bias - 8 * slope)) > 0.8
    assert tox.fit_curve(x, (x == 0).astype(float))[1] == 0
    assert tox.fit_curve(np.zeros(0), np.zeros(0)) == (0.0, 0.0)


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in tox.op12_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    held = [(labels[i], r.predicted) for i, r in rows.items() if r.held_out and i in labels]
    caught = np.mean([p for y, p in held if y])
    left = np.mean([1 - p for y, p in held if not y])
    assert caught > 0.85 and left > 0.97 and len(held) > 500


def plain_model(spark, n=600):
    rng = np.random.default_rng(4)
    docs, marks = [], []
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, 300, 60)]
        if i % 6 == 0:
            for at in rng.integers(0, 60, 5):
                words[at] = INSULTS[int(at) % 4]
        docs.append((i, " ".join(words), "x"))
        marks.append((i, int(i % 6 == 0), 0))
    docs = spark.createDataFrame(docs, "doc_id long, text string, label string")
    return docs, spark.createDataFrame(marks, "doc_id long, label int, quality int")


def test_passages_of_whole_texts(spark):
    docs, marks = plain_model(spark, 5000)
    model = tox.train(docs, marks)
    assert set(INSULTS) <= {w for w, r in model.ratios.items() if r > 0}
    quiet = "w1 w2 w3 " * 30_000
    text = quiet + "You IDIOT, you scum! " + quiet + "Trash, moron."
    rows = spark.createDataFrame([(1, text, 0), (2, quiet, 0)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in tox.toxic_passages(rows, model).collect()}
    assert [text[p.start : p.end] for p in got[1].passages] == ["IDIOT, you scum", "Trash, moron"]
    assert all(p.expected <= tox.ALPHA and p.score > 0 for p in got[1].passages)
    assert got[1].score > 0.3 > got[2].score and not got[2].passages


def test_defined_cases(spark):
    docs, marks = plain_model(spark)
    rows = [(1, None, 7), (2, "", 7), (2, "", 7), (None, "you idiot scum trash", 7), (3, "?! ...", 7), (4, "x" * 200_000, 7)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score int")
    model = tox.train(docs, marks)
    got = sorted(((r.doc_id or -1, r.score) for r in tox.toxic_passages(odd, model).collect()))
    bare = 1 / (1 + math.exp(-model.bias))
    assert len(got) == 6 and got[0][1] > 0.3 and all(math.isclose(s, bare) for i, s in got if i != -1)
    assert tox.toxic_passages(odd.limit(0), model).count() == 0
    none = tox.train(docs, marks.limit(0))
    assert {r.score for r in tox.toxic_passages(odd, none).collect()} == {0.5}
    assert tox.train(docs.limit(0), marks).ratios == {}
    # nulls, several labels of one id, repeated rows, and texts that are null or empty teach without a crash
    more = marks.union(spark.createDataFrame([(None, 1, 0), (5, None, 0), (1, 1, 0), (1, 0, 0), (2, 1, 0)], marks.schema))
    model = tox.train(docs.union(odd.selectExpr("doc_id", "text", "'y'")).union(docs.limit(30)), more)
    assert set(INSULTS) <= {w for w, r in model.ratios.items() if r > 0}


def test_sample_is_bounded(spark):
    docs, marks = plain_model(spark)
    assert tox.sampled(docs, marks, 200).count() < 280
    # one id on very many rows doesn't break the bound
    same = docs.selectExpr("1L as doc_id", "text", "label")
    assert tox.sampled(same, marks, 200).count() < 280


def test_table_of_words_starts_anew(monkeypatch):
    lexicon = tox.Lexicon({"bad": 3.0})
    text = " ".join(f"w{k} Bad" for k in range(50))
    want = lexicon.scan(text)
    monkeypatch.setattr(tox, "REMEMBERED", 7)
    small = tox.Lexicon({"bad": 3.0})
    assert small.scan(text) == want and len(small) <= 7
