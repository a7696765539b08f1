"""Language identification: the models against a plain recursion, held-out accuracy, defined cases."""

import zlib
from collections import Counter

import numpy as np

from maskwright.llm import language as lang


def grams_of(words, order):
    found = Counter()
    for w, n in words.items():
        line = "\x02" * (order - 1) + w + "\x03"
        for k in range(len(line) - order + 1):
            found[line[k : k + order]] += n
    return found


def plain(top, order, word):
    """Interpolated Kneser-Ney, written as its recursion."""
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def p(c, context, n):
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        table = counts[n]
        n1, n2 = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        after = {g[-1]: v for g, v in table.items() if g[:-1] == context}
        if not after:
            return p(c, context[1:], n - 1)
        total = sum(after.values())
        return max(after.get(c, 0) - d, 0) / total * (c in after) + d * len(after) / total * p(c, context[1:], n - 1)

    line = "\x02" * (order - 1) + word + "\x03"
    return sum(np.log(p(line[k], line[k - order + 1 : k], order)) for k in range(order - 1, len(line)))


def test_models_follow_the_recursion():
    one = {"abra": 3, "cadabra": 1, "aba": 2, "daß": 1}
    two = {"brr": 1, "xyz": 4}
    for order in (2, 3, 4):
        tops = {"a": grams_of(one, order), "b": grams_of(two, order)}
        model = lang.Identifier(tops, order)
        words = ["abra", "a", "zzz", "brr", "ßa", "cada"]
        want = [[plain(tops[k], order, w) for k in "ab"] for w in words]
        assert np.allclose(model.log_probabilities(words), want)


def test_probabilities_add_up():
    model = lang.Identifier({"a": grams_of({"ab": 2, "ba": 1, "aab": 1}, 3)}, 3)
    # all words over the letters up to a length, and what goes beyond: at most one in total
    words, total = [""], 0.0
    for _ in range(9):
        words = [w + c for w in words for c in "ab"]
        total += np.exp(model.log_probabilities(words)).sum()
    assert 0.7 < total < 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in lang.op8_language(spark, sf).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [(r.lang_pred, docs[i].lang) for i, r in rows.items() if r.held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert np.mean([r.rejected for r in rows.values()]) < 0.01


def test_defined_cases(spark):
    learned = [(i, "the cat and the dog sat on that mat", "en") for i in range(9)] + [(i + 50, "der hund und die katze sind nicht da", "de") for i in range(9)]
    rows = learned + [(100, None, "en"), (101, "", None), (102, "12 ²½ !!", "en"), (None, "the dog", "xx"), (103, "die katze " * 30_000, None), (103, "the cat", None), (104, "qqqq xxxx zzzz wwww jjjj vvvv", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", lang.F.lit("x"))
    model = lang.learn(docs)
    assert model.langs == ["de", "en"]
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in lang.identify(docs, model).collect() if r.doc_id is None or r.doc_id > 99]
    assert sorted(got, key=str) == sorted([(100, "und", True), (101, "und", True), (102, "und", True), (None, "en", False), (103, "de", False), (103, "en", False), (104, next(g[1] for g in got if g[0] == 104), True)], key=str)
    kept = lang.language_stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    assert {r.lang_pred for r in lang.identify(docs, lang.learn(docs.limit(0))).collect()} == {"und"}
    assert lang.identify(docs.limit(0), model).count() == 0


def test_table_starts_anew(monkeypatch):
    model = lang.Identifier({"a": grams_of({"ab": 2}, 3), "b": grams_of({"ba": 2}, 3)}, 3)
    texts = [f"ab{'ab' * k} ba" for k in range(30)]
    want = list(model.predict(texts))
    monkeypatch.setattr(lang, "REMEMBERED", 5)
    assert [r for t in texts for r in model.predict([t])] == want


def test_sample_is_bounded(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text", "if(id < 3900, 'a', 'b') AS lang")
    sizes = {r.lang: r["count"] for r in lang.sampled(rows, 300).groupBy("lang").count().collect()}
    assert 200 < sizes["a"] < 400 and sizes["b"] == 100
