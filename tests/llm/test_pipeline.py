"""The pipeline, stage by stage, against plain versions of the stages' decisions."""

import re

import corpus_pipeline
from tokenizers import Tokenizer

from maskwright.llm import bpe, common, language, quality
from maskwright.llm.common import fold_of, keep_only, table
from tests.llm.test_simhash import brute_stage

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_a_worker_holds_the_tables_of_one_operator(monkeypatch):
    monkeypatch.setattr(common, "_owner", "")
    text = "The quick, brown fox: 12 foxes"
    keep_only("quality")
    before = quality.features(text)
    data = bpe.read_vocabulary(bpe.default_path())
    ids = bpe.worker_codec(data).encode(text)
    keep_only("quality")
    assert len(quality.chunk_table()) and bpe._built  # its own stay, and so does what came while it was at work
    keep_only("simhash")
    assert not len(quality.chunk_table()) and not quality.chunk_table().parts and not bpe._built
    after = quality.features(text)
    assert all((a == b).all() for a, b in zip(before, after)) and bpe.worker_codec(data).encode(text) == ids
    keep_only("bpe")
    assert bpe._built and not len(quality.chunk_table())


def test_every_stage_decides_on_all_it_gets(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "tokens"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = rows_of(docs)
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        after = rows_of(docs)
        kept[name] = (before, after)
        if name != "tokens":
            assert docs.columns == columns
            assert all(before[i] == r for i, r in after.items())

    before, after = kept["quality"]
    first = table(spark, SF, "documents")
    w = quality.learned(spark, first, SF)
    slots = {i: quality.features(r.text) for i, r in before.items()}
    assert set(after) == {i for i, (s, x) in slots.items() if quality.sigmoid(w[-1] + w[s] @ x) >= quality.CUT}
    assert len(after) < len(before)

    before, after = kept["language"]
    frame = spark.createDataFrame(list(before.values()))
    model = language.learn(frame.filter(fold_of(frame.doc_id) != 0))
    assert set(after) == {i for i, r in before.items() if not next(model.predict([r.text]))[2]}

    before, after = kept["near_duplicates"]
    rows = sorted((i, r.text) for i, r in before.items())
    assert set(after) == {rows[members[0]][0] for members in brute_stage(rows).values()} and len(after) < len(before)

    before, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    words = {w for _, t in items for w in re.findall(r"\w+", t.lower())}
    bad = {i for i, r in before.items() if words & set(re.findall(r"\w+", r.text.lower())) and brute_fast(r.text, items)}
    assert set(after) == set(before) - bad and bad

    before, after = kept["tokens"]
    library = Tokenizer.from_file(bpe.default_path())
    assert set(after) == set(before)
    assert all(r.ids == library.encode(before[i].text, add_special_tokens=False).ids for i, r in after.items())
    assert rows_of(corpus_pipeline.run(spark, SF)) == after


def brute_fast(text, items):
    """Whether a window of ten item words occurs in a text; the items here are longer than that."""
    from tests.llm.test_decontaminate import words

    doc = " " + " ".join(words(text)) + " "
    for _, passage in items:
        w = words(passage)
        if any(" " + " ".join(w[k : k + 10]) + " " in doc for k in range(max(1, len(w) - 9))):
            return True
    return False


def test_empty_tables(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_nulls_repeats_and_clashing_columns(spark):
    good = [r for r in table(spark, SF, "documents").collect() if r.lang == "en"][:3]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "x", 1.5, 7, "k", "t", 2, {"a": 1}) for r in good]
    rest = (None,) * 10
    rows += [rows[0], (None, rows[1][1], *rest), (900_001, None, *rest), (900_002, "", *rest), (good[0].doc_id, rows[2][1] + " and something else", *rest)]
    names = "doc_id long, text string, lang string, source string, n_chars long, ids string, score double, n_tokens int, _key string, _text string, row_key int, k1 map<string, int>"
    docs = spark.createDataFrame(rows, names)
    by_values = {(r.doc_id, r.text): r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        for r in kept.collect():
            # no column is overwritten by a helper of the stage
            assert r == by_values[r.doc_id, r.text], name
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert encoded.columns == [c for c in docs.columns if c not in ("text", "ids", "n_tokens")] + ["ids", "n_tokens"]
    assert encoded.count() == len(rows)
    first = encoded.filter(encoded.doc_id == good[1].doc_id).first()
    assert (first["_text"], first["_key"]) == ("t", "k") and first.n_tokens == len(first.ids) > 0
    assert {r.n_tokens for r in encoded.filter("doc_id > 900000").collect()} == {0}
    once = corpus_pipeline.STAGES[2][1](spark, docs, SF)
    # the first id has two unlike texts, and the second of them is a near copy of a row with a larger id
    assert sorted(r.doc_id for r in once.collect()) == [good[0].doc_id, good[0].doc_id, good[1].doc_id, 900_001]
