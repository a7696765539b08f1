"""Encoding against the tokenizers library, decoding against its decode."""

import hashlib
import random
import unicodedata

import pytest
from tokenizers import Tokenizer

from maskwright.llm import bpe


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_vocabulary(bpe.default_path()))


TEXTS = [
    "", " ", "Hello, world's 3rd   test", "don't've'll ’s", "ΟΔΟΣ Σ σς İstanbul Ǆ ß ẞ", "é à́ ẛ̣ 가각", "\x1ca\x1fb\x00c",
    " x y　z\u0085w​v", "<|endoftext|>a<|startoftext|><|endoftext|> <|x|> <|ENDOFTEXT|>", "日本語 العربية हिन्दी 👩‍👩‍👧‍👧 ½ ² ٣",
    "aaaaaaaaaaaaaaaa aaaaaaa hahahahahaha", "x" * 3000, "'s's'S 'T 'ReX", "a\tb\r\n\x0b\x0cc",
]


@pytest.mark.parametrize("text", TEXTS)
def test_hand_picked(codec, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = codec.encode(text)
    assert got == want
    assert codec.decode(got) == library.decode(want, skip_special_tokens=False)


def test_random_strings(codec, library):
    rng = random.Random(7)
    parts = ["a", "e", "th", "in", "er", " ", "'s", "Σ", "é", "é", "ß", "0", "12", ".", "!!", "日", " ", "<|endoftext|>", "<|", "\n", "😀", "aa", "on", "İ", "\x1c"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(3000)]
    # letters that every Unicode version of the last years has; the two sides may differ in later ones
    old = [chr(c) for c in range(1, 0xD800) if unicodedata.ucd_3_2_0.category(chr(c)) != "Cn"]
    texts += ["".join(rng.choice(old[:700] if rng.random() < 0.5 else old) for _ in range(20)) for _ in range(500)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert codec.encode(text) == want.ids, repr(text)


def test_every_token_is_its_own_encoding(codec):
    for token, i in list(codec.ids.items())[::37]:
        if token.endswith(bpe.END) and i in codec.parts:
            assert codec.encode_word(token[:-1]) == (i,)


def test_query(spark, sf, library):
    rows = {r.doc_id: r for r in bpe.op4_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert rows[doc.doc_id][1:] == (len(ids), sha(" ".join(map(str, ids))), sha(text))


def test_defined_cases(spark, library):
    rows = [(1, None, "a"), (2, "", "a"), (3, "to be", "a"), (3, "to be", "a"), (None, "to be", "a"), (4, "to be " * 40_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.round_trip(docs, bpe.default_path()).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == [(-1, 2), (1, 0), (2, 0), (3, 2), (3, 2), (4, 80_000)]
    staged = bpe.encode_stage(spark, docs, "")
    assert staged.columns == ["doc_id", "ids", "n_tokens"]
    back = {r.doc_id: r.text for r in bpe.decode(staged.filter("doc_id in (1, 3)"), bpe.default_path()).collect()}
    assert back == {1: "", 3: library.decode(library.encode("to be").ids, skip_special_tokens=False)}
    assert bpe.round_trip(docs.limit(0), bpe.default_path()).count() == 0
