"""The dictionary of a term table on long texts: bounded batches, the same spans."""

import random
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from maskwright.operators import custom


def test_long_texts_come_in_bounded_parts(spark):
    n = 3 * custom._HELD
    docs = spark.createDataFrame([(1, "the, " * n), (2, "TheK sea; the  sea")], "doc_id long, text string")
    stream = custom._word_stream(docs, ["doc_id"], False, False)
    sizes = [r[0] for r in stream.where("doc_id = 1").selectExpr("size(occ)").collect()]
    # a task never holds all words of a long text at once
    assert sum(sizes) == n and max(sizes) <= custom._HELD
    terms = spark.createDataFrame([("the",), ("the  sea",), ("thek sea;",), ("sea",)], "term string")
    found = custom.detect_dictionary_table(docs, terms)
    assert found.where("doc_id = 1").count() == n
    assert found.where("doc_id = 1 and (start % 5 <> 0 or end <> start + 3 or text <> 'the')").count() == 0
    assert sorted((r.start, r.end, r.text) for r in found.where("doc_id = 2").collect()) == [(0, 9, "TheK sea;"), (10, 18, "the  sea")]


def test_signs_and_edges_of_long_texts(spark):
    text = "-- a" * (custom._HELD + 5) + " --"
    docs = spark.createDataFrame([(7, text)], "doc_id long, text string")
    found = custom.detect_dictionary_table(docs, spark.createDataFrame([("--",)], "term string"))
    # signs beside a word are no span of their own
    want = [s for s in range(len(text)) if text.startswith("--", s) and not (s and text[s - 1].isalnum()) and not text[s + 2 : s + 3].isalnum()]
    assert sorted(r.start for r in found.collect()) == want


def test_a_list_is_settled_in_one_pass(spark, monkeypatch):
    terms = ["the", "the sea", "sea side", "side", "café", "a", "a b", "b c d"]
    rows = [(1, "The sea side a b c d the"), (2, "CAFÉ; cafés theme side_a side"), (3, None), (4, ""), (5, "a b " * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = lambda: sorted((r.doc_id, r.start, r.end, r.text) for r in custom.detect_dictionary(docs, terms).collect())
    got = spans()
    assert [g for g in got if g[0] < 5] == [(1, 0, 7, "The sea"), (1, 8, 12, "side"), (1, 13, 16, "a b"), (1, 21, 24, "the"),
                                            (2, 0, 4, "CAFÉ"), (2, 25, 29, "side")]
    assert len([g for g in got if g[0] == 5]) == 400
    # the same from several blocks, and no growing array is copied for every match
    assert "aggregate(" not in custom.detect_dictionary(docs, terms)._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(custom, "BLOCK_CHARS", 8)
    assert len(custom._blocks(custom._clean(terms))) > 2 and spans() == got


def test_words_and_matches_are_neither_stored_nor_dealt(spark, monkeypatch):
    stored, materialize = [], custom.materialize
    monkeypatch.setattr(custom, "materialize", lambda df, label: stored.append(materialize(df, label)) or stored[-1])
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('the sea, the sea ', id) as text")
    found = custom.detect_dictionary_table(docs, spark.createDataFrame([("the",), ("sea",)], "term string"))
    assert found.count() == 12000
    # the two terms, and their words once for each of the four groups of texts
    assert sum(table.count() for table in stored) <= 2 + 2 * 4
    # texts are dealt before they are matched, and nothing after that
    above, *below = found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
    assert "Exchange" not in above and "Exchange" in below[0]


def test_spans_do_not_depend_on_groups_and_mixed_terms(spark, monkeypatch):
    rng = random.Random(3)
    words = ["sea", "Sea", "side", "ⓐ", "Ⓐ", "λιμ", "ΛΙΜ", "λ\u0345μ", "λ", "ι", "K", "k", "--", "-", "a", "a_b", "é"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " ", ", ", "-", "  "]) for _ in range(rng.randint(0, 25))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    one_word = ["sea", "side", "k", "a", "é", "λ"]
    monkeypatch.setattr(custom, "GROUP_BYTES", 1000)
    for terms in (one_word, [*one_word, "λιμ", "ι"], ["ⓐ", "--", "-", "sea side", "a sea", "side, a", "k k", "a", "λιμ-", "ι a", "zzz a"]):
        for sensitive in (False, True):
            got = custom.detect_dictionary_table(docs, spark.createDataFrame([(t,) for t in terms], "term string"), case_sensitive=sensitive)
            want = custom.detect_dictionary(docs, terms, case_sensitive=sensitive)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tokens_of_texts_in_parts(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", *("".join(rng.choice(["word", "a", " ", ", ", "xyz" * 9]) for _ in range(rng.randint(1, 40))) for _ in range(30))]
    monkeypatch.setattr(custom, "_HELD", 16)
    for token in (custom._WORD, custom._WORD_OR_SIGN, custom._WORD_OR_GAP):
        seen = {n: [] for n in range(len(texts))}
        for tokens, (text, before, start, counts) in custom._tokens(pa.array(texts, pa.string()), token, False):
            assert 0 < len(tokens) <= 16 and counts.sum() == len(tokens)
            tokens = iter(tokens)
            for n, k, at, count in zip(text, before, start, counts):
                assert k == len(seen[n]) and at == sum(map(len, seen[n])) or token is custom._WORD
                seen[n] += [next(tokens) for _ in range(count)]
        for n, text in enumerate(texts):
            if token is custom._WORD_OR_GAP:
                assert "".join(seen[n]) == (text or "")
            else:
                assert seen[n] == token.findall(text or "")


def test_marks_stay_outside_words_when_folded():
    # else a word could be hidden in a longer one by what stands beside it
    table = custom._fold_table()
    assert not [c for c, to in table.items() if custom._WORD.match(chr(to)) and not custom._WORD.match(chr(c))]


def test_ids_that_change_with_every_reading(spark):
    name = F.udf(lambda _: uuid.uuid4().hex).asNondeterministic()
    docs = spark.range(400, numPartitions=4).select(name("id").alias("key"), F.concat(F.lit("w"), "id").alias("text"))
    terms = spark.range(400).selectExpr("concat('W', id) as term")
    assert custom.detect_dictionary_table(docs, terms).count() == 400
