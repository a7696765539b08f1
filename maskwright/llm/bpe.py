"""BPE encoding and decoding by dynamic programming over prefixes.

The byte pair encoding of a word has this property: each of its prefixes that ends at a token end
is itself encoded by the tokens before, and a sequence of tokens is the encoding of its text
exactly when every two neighbours are compatible, that is, when merging by rank would not join
across their border. So every prefix has one last token. An automaton over the vocabulary gives,
for each prefix, the tokens that are its suffixes; the one whose neighbour, the last token of the
rest, is compatible is stored, and the ids follow from the back-pointers.

Compatibility is decided by undoing, in the order of time, the merges that made the two tokens
along their border. Words and pairs are remembered in bounded tables, so a frequent word costs one
lookup. Texts are encoded where they are read; nothing is shuffled.

The text is prepared as the tokenizer file says: marked tokens are cut out, the rest is normalised
(NFC, white space, lower case), split into pieces and written in the byte alphabet, and the end of
a piece is part of its last symbol. Decoding joins the vocabulary's strings by one space, since the
file names no decoder.

Defined cases: a null text is encoded as the empty text (no ids, decoded text empty); repeated rows
give repeated rows; null ids pass through; extra columns of the input are not used.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import arrow_rows, free_names, table

#: Words, stretches and pairs that a worker remembers before it starts the table anew.
WORDS, STRETCHES, PAIRS = 400_000, 400_000, 400_000
#: Stands for the end of a piece inside a token. It is no letter of the byte alphabet.
END = "\uffff"
#: Characters that Python takes for white space and the tokenizer does not.
_NOT_SPACE = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile("[^\\S\x1c-\x1f]+")
#: Signs that make one piece after a word; an apostrophe may begin another.
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


def byte_alphabet() -> list[str]:
    """The printable letter of each byte: printable Latin-1 stays, the others follow from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """What a tokenizer file with word ends holds, as plain lists that can be broadcast.

    The size is that of the file, whatever the corpus.
    """
    with open(path, "rb") as file:
        content = file.read()
    whole = json.loads(content)
    model = whole["model"]
    split = next(p for p in whole["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {
        "digest": hashlib.sha256(content).hexdigest(),
        "end": model["end_of_word_suffix"],
        "vocab": model["vocab"],
        "merges": [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]],
        "marked": {t["content"]: t["id"] for t in whole["added_tokens"]},
        "pattern": split["pattern"]["Regex"],
    }


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, data: dict):
        end = data["end"]
        inner = lambda token: token[: -len(end)] + END if token.endswith(end) else token
        self.ids = {inner(t): i for t, i in data["vocab"].items()}
        self.names = {i: t for t, i in data["vocab"].items()} | {i: t for t, i in data["marked"].items()}
        #: rank of a merge by its pair of ids; parts and rank by the id that it makes
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for k, (a, b) in enumerate(data["merges"]):
            a, b = inner(a), inner(b)
            pair, made = (self.ids[a], self.ids[b]), self.ids[a + b]
            self.rank[pair] = k
            self.parts[made] = (*pair, k)
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if i in self.parts or len(token.removesuffix(END)) == 1:
                self.automaton.add_word(token, (len(token) - token.endswith(END), i))
        self.automaton.make_automaton()
        self.letters = byte_alphabet()
        self.marked = data["marked"]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.marked, key=len, reverse=True))) + ")") if self.marked else None
        self.pieces = regex.compile(data["pattern"])
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.most_words = WORDS
        self.memory: dict[str, Remembered] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the border between two tokens."""
        bound = len(self.rank) + 1
        while True:
            if self.rank.get((left, right), bound) < bound:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[2] > b[2]):
                left, bound = a[1], a[2]
            else:
                # merges of equal rank go from left to right: the one at the border would come first
                right, bound = b[0], b[2] + 1

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one piece, which is written in the byte alphabet."""
        n = len(word)
        last, width = [-1] * (n + 1), [0] * (n + 1)
        pairs = self.pairs
        for at, (size, token) in self.automaton.iter(word + END):
            stop = at + 1
            if stop >= n:
                if stop == n:  # without the end mark, which the last symbol bears
                    continue
                stop = n
            if last[stop] >= 0:
                continue
            if stop > size:
                before = last[stop - size]
                if before < 0:
                    continue
                fits = pairs.get(before << 32 | token)
                if fits is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    fits = pairs[before << 32 | token] = self.compatible(before, token)
                if not fits:
                    continue
            last[stop], width[stop] = token, size
        out = []
        stop = n
        while stop:
            if last[stop] < 0:
                raise ValueError("the vocabulary can't spell this piece")
            out.append(last[stop])
            stop -= width[stop]
        return tuple(out[::-1])

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a stretch of text without white space and marked tokens."""
        if not chunk.isascii():
            # lower case letter by letter, without the rule for a sigma at the end of a word
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        lower = chunk.lower()
        head = lower.rstrip(_SIGNS)
        if head.isalpha():  # the usual case: a word, and signs after it
            pieces = (head, lower[len(head) :]) if len(head) < len(lower) else (head,)
        else:
            pieces = self.pieces.findall(lower)
        found = self.words
        ids: tuple[int, ...] = ()
        for piece in pieces:
            known = found.get(piece)
            if known is None:
                if len(found) >= self.most_words:
                    found.clear()
                spelled = piece if piece.isascii() and piece.isalnum() else "".join([self.letters[b] for b in piece.encode()])
                known = found[piece] = self.encode_word(spelled)
            ids = ids + known if ids else known
        return ids

    def chunks(self, text: str) -> list[str]:
        """The stretches between white space, and the marked tokens, in order."""
        if self.cut is None or "<|" not in text and not any(m in text for m in self.marked):
            return _SPACE.split(text) if _NOT_SPACE.search(text) else text.split()
        found: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            found += [part] if k % 2 else _SPACE.split(part)
        return [c for c in found if c]

    def encode_stretch(self, chunk: str) -> tuple[int, ...]:
        """Ids of one of ``chunks``."""
        return (self.marked[chunk],) if chunk in self.marked else self.encode_chunk(chunk)

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.chunks(text) for i in self.encode_stretch(chunk)]

    def known(self, kind: str, make, most: int = STRETCHES) -> Remembered:
        """What this process remembers of chunks, one table for each kind of value."""
        if kind not in self.memory:
            self.memory[kind] = Remembered(make, most)
        return self.memory[kind]

    def decode(self, ids) -> str:
        """Vocabulary strings of the ids, joined by one space; ids outside the vocabulary are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


_built: dict[str, Codec] = {}


def worker_codec(data: dict) -> Codec:
    """The codec of a vocabulary, built once per worker process; its tables outlive a task."""
    if data["digest"] not in _built:
        _built.clear()
        _built[data["digest"]] = Codec(data)
    return _built[data["digest"]]


def forget() -> None:
    """Drops the codec of this worker process."""
    _built.clear()


class Remembered(dict):
    """Values of chunks, made on demand; starts anew when it is full."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, chunk: str):
        if len(self) >= self.most:
            self.clear()
        value = self[chunk] = self.make(chunk)
        return value


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ids array<int> of every whole ``text``."""
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    kept = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(source.value)
        known = codec.known("ids", codec.encode_stretch)
        for batch in batches:
            ids = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                ids.append([i for c in codec.chunks(text or "") for i in known[c]])
            columns = [batch.column(k) for k in range(batch.num_columns - 1)] + [pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "ids"])

    schema = kept.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(*keep, F.col("text").alias(free_names(docs, "_text")[0])).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the decoded text of every ``ids``; null ids give a null text."""
    source = rows.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(source.value)
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)] + [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "text"])

    schema = rows.select(*keep).schema.add("text", T.StringType())
    return rows.select(*keep, F.col("ids").alias(free_names(rows, "_ids")[0])).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text, per row.

    One pass: the ids and the decoded strings of a chunk are remembered together, so that neither
    is carried through the cluster.
    """
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(source.value)

        def made(chunk: str) -> tuple[int, str, str]:
            ids = codec.encode_stretch(chunk)
            return len(ids), " ".join(map(str, ids)), codec.decode(ids)

        known = codec.known("strings", made)
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in batch.column(1).to_pylist():
                found = [known[c] for c in codec.chunks(text or "")]
                found = [f for f in found if f[0]]
                counts.append(sum([f[0] for f in found]))
                ids.append(hashlib.sha256(" ".join([f[1] for f in found]).encode()).hexdigest())
                texts.append(hashlib.sha256(" ".join([f[2] for f in found]).encode()).hexdigest())
            yield arrow_rows(schema, {"doc_id": batch.column(0), "n_tokens": counts, "ids_sha256": ids, "decoded_sha256": texts})

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, out)


def default_path() -> str:
    """The word BPE of the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_path())


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns but the text, with the token ids in its place, as ``ids`` and ``n_tokens``.

    Columns of the documents that have one of these two names are replaced by the stage's, so that its result
    always has them; all others, whatever their names, stay. A null or empty text has no ids; repeated rows and rows without an id give
    a row each; an empty table stays empty.
    """
    rest = tuple(c for c in docs.columns if c.lower() not in ("text", "ids", "n_tokens"))
    return encode(docs, default_path(), rest).withColumn("n_tokens", F.size("ids").cast("long"))
