"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text is its words (runs of letters, of digits, and of other signs) and their shapes: how a word
is written, and whether it repeats the word before. N-grams of the words and of the shapes are
hashed to a fixed number of slots. The value of a slot is the square root of its count, and the
vector has length one, so a long text weighs no more than a short one.

Training: a bounded sample of labelled rows, the ones with the smallest hash of their id, is dealt
into shards. Each shard runs FTRL-proximal over its rows, row by row, and the weights of the shards
are averaged. The model has at most as many weights as there are slots, whatever the corpus, so it
is broadcast. Scoring is a sparse dot product where a document is read; nothing is shuffled.

Defined cases: a null or empty text has no n-grams, its score is that of the bias alone; labels that
are null, or whose doc_id is null, teach nothing; of several labels of one doc_id all count; without
any label the score is 0.5; repeated rows give repeated rows; extra columns are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import arrow_rows, fold_of, keep_only, table

#: Slots are 2 ** SLOT_BITS; n-grams of words and of shapes up to these lengths.
SLOT_BITS, WORD_N, SHAPE_N = 18, 2, 3
#: Most labelled rows that are learned from, rows of a shard, and updates that a shard makes at least.
SAMPLE, SHARD_ROWS, UPDATES = 24_000, 4_000, 8_000
#: FTRL-proximal: learning rate, smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.1
#: Scores from here on are label 1.
CUT = 0.3
#: Chunks that a worker remembers before it starts its table anew.
REMEMBERED = 300_000

_PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shape_of(part: str) -> int:
    """0 to 5 for words (lower, capital first, all capitals, mixed), digits and signs; signs also tell which and how many."""
    if part.isalpha():
        return 0 if part.islower() else 2 if part.isupper() and len(part) > 1 else 1 if part[:1].isupper() and (len(part) == 1 or part[1:].islower()) else 3
    if part.isdigit():
        return 4
    return 5 + xxhash.xxh32_intdigest(part[:1] + str(min(len(part), 3))) % 251


class _Chunks(dict):
    """The parts of a chunk between white space, as places in the tables of word hashes and shapes."""

    def __init__(self):
        super().__init__()
        self.words = np.zeros(REMEMBERED, np.uint64)
        self.shapes = np.zeros(REMEMBERED, np.uint64)
        self.parts: dict[str, int] = {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        found = _PARTS.findall(chunk)
        places = []
        for part in found:
            place = self.parts.get(part)
            if place is None:
                place = self.parts[part] = len(self.parts)
                if place >= len(self.words):
                    self.words, self.shapes = (np.r_[x, np.zeros(len(x), np.uint64)] for x in (self.words, self.shapes))
                self.words[place] = xxhash.xxh64_intdigest(part.lower())
                self.shapes[place] = shape_of(part)
            places.append(place)
        value = self[chunk] = tuple(places)
        return value

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes and shapes of a text."""
        if len(self) >= REMEMBERED or len(self.parts) >= REMEMBERED:
            self.clear()
            self.parts.clear()
        places = np.fromiter(chain.from_iterable(map(self.__getitem__, text.split())), np.int64)
        return self.words[places], self.shapes[places]


_chunks = _Chunks()


def chunk_table() -> _Chunks:
    """The table of this worker process."""
    return _chunks


def forget() -> None:
    """Empties the table of this worker process."""
    global _chunks
    _chunks = _Chunks()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text, a vector of length one."""
    words, shapes = chunk_table().of(text or "")
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0)
    again = np.r_[False, words[1:] == words[:-1]].astype(np.uint64)
    shapes = shapes + again * np.uint64(1024)
    slots = []
    for sequence, most, salt in ((words, WORD_N, 1), (shapes, SHAPE_N, 2)):
        gram = np.full(len(sequence), salt, dtype=np.uint64)
        for n in range(1, most + 1):
            if len(sequence) < n:
                break
            gram = (gram[: len(sequence) - n + 1] ^ sequence[n - 1 :]) * _MIX
            gram ^= gram >> np.uint64(29)
            slots.append(gram * _MIX >> np.uint64(64 - SLOT_BITS))
    used, counts = np.unique(np.concatenate(slots).astype(np.int64), return_counts=True)
    value = np.sqrt(counts)
    return used, value / np.sqrt(np.dot(value, value))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Leader:
    """FTRL-proximal for logistic loss; the last weight is the bias and bears no penalty."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.l1 = np.r_[np.full(size, L1), 0.0]

    def weights(self, at) -> np.ndarray:
        z, n, l1 = self.z[at], self.n[at], self.l1[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.r_[slots, len(self.z) - 1], np.r_[values, 1.0]
        w = self.weights(at)
        g = (sigmoid(w @ x) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(labelled: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights, the bias last, from rows of doc_id, text and label (0 or 1)."""
    labelled = labelled.filter("doc_id is not null and label is not null")
    ids = labelled.select("doc_id", F.xxhash64("doc_id").alias("h"))
    n = ids.count()
    if n > sample:
        # ids below a bound of their hash: as good as a random sample, and at most a little over ``sample``
        bound = int(-(2**63) + 2**64 * (sample / n))
        labelled = labelled.filter(F.xxhash64("doc_id") < F.lit(bound))
    shards = -(-max(min(n, sample), 1) // SHARD_ROWS)
    dealt = labelled.select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).alias("shard"), "doc_id", "text", F.col("label").cast("int").alias("label"))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(text=rows["text"].fillna("")).sort_values(["doc_id", "label", "text"])
        leader = Leader(1 << SLOT_BITS)
        vectors = [features(t) for t in rows["text"]]
        for turn in range(-(-UPDATES // len(vectors))):
            for k in np.random.default_rng(turn).permutation(len(vectors)):
                leader.learn(*vectors[k], rows["label"].iloc[k])
        w = leader.weights(np.arange((1 << SLOT_BITS) + 1))
        used = np.flatnonzero(w)
        return pd.DataFrame({"slot": used, "w": w[used]})

    parts = dealt.groupBy("shard").applyInPandas(learn, "slot long, w double")
    mean = parts.groupBy("slot").agg((F.sum("w") / shards).alias("w")).toPandas()
    weights = np.zeros((1 << SLOT_BITS) + 1)
    weights[mean["slot"].to_numpy(dtype=np.int64)] = mean["w"].to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every row of ``docs`` (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            values = []
            for text in batch.column(1).to_pylist():
                slots, x = features(text)
                values.append(w[-1] + w[slots] @ x)
            yield arrow_rows(schema, {"doc_id": batch.column(0), "score": sigmoid(np.array(values, dtype=float))})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and label of the rows that may be learned from: those outside fold 0."""
    marks = labels.filter("quality is not null").select("doc_id", F.col("quality").alias("label"))
    return docs.select("doc_id", "text").filter(fold_of(F.col("doc_id")) != 0).join(marks, "doc_id")


def learned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> np.ndarray:
    return train(labelled_rows(docs, table(spark, sf_dir, "labels")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learned(spark, docs, sf_dir))
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects, row by row and without a shuffle of texts.

    A null or empty text has the score of the bias alone; repeated rows and rows without an id are decided
    like any other; the columns, whatever their names, stay as they are; an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(learned(spark, docs, sf_dir))

    @F.pandas_udf("double")
    def score_of(texts: pd.Series) -> pd.Series:
        keep_only("quality")
        w = model.value
        found = [features(t) for t in texts]
        return pd.Series(sigmoid(np.array([w[-1] + w[s] @ x for s, x in found], dtype=float)))

    return docs.filter(score_of("text") >= CUT)
