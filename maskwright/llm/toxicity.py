"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values.

Words get the log ratio of their share in toxic to their share in clean labelled texts, under an
informative Dirichlet prior: each class starts with PRIOR words dealt out as in both classes
together. The ratio is moved towards zero by CAUTION standard errors, so that rare words say nothing,
and what a word doesn't say is zero. What is counted are the different neighbourhoods (word before,
word, word after) in which a word occurs in a class: copies and near copies of a text add nothing,
however many there are.

A word scores its log ratio less GAP, the price of a word inside a passage. All maximal-scoring
segments of a text are found by one scan over its scored words (after Ruzzo and Tompa): candidates lie
on a stack with their sums before and after, and a new one joins those that it can raise. Each
candidate remembers the last one that started lower, so the scan is linear.

How far a segment is beyond chance is an extreme-value question. Chance segments above a level are
taken as a Poisson number in proportion to the length with exponential excess, which makes the best one
of a text Gumbel distributed. Rate and decay come from clean labelled texts; each of PARTS parts of the
sample is scored by the words of the others. A segment is a significant passage if at most ALPHA such segments are expected in a
text of its length. The evidence of a text combines its best segments by the probability of their sum,
and a logistic curve over the evidence, fitted out of fold, gives the score.

The sample is at most about SAMPLE labelled rows, chosen by a hash of id and text. Only words with a score
are kept, at most a fifth of the words of the sample, so the model is bounded and broadcast. Counts and
fits are over whole texts of the sample; every document is scored where it lies, without a shuffle.

Defined cases: a null or empty text, or one without words, has no passage and the score of no evidence;
labels that are null or whose doc_id is null teach nothing; of several labels of one doc_id all count;
without any label the score is 0.5; repeated rows give repeated rows; ties and word order within equal
scores don't matter; texts and words may be of any length; an empty table gives no rows; extra columns are not used.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import arrow_rows, fold_of, materialize, table

#: Most labelled rows that are learned from, about.
SAMPLE = 16_000
#: Parts of the sample, each scored by the words of the others; share of the highest chance segments that the decay leaves out.
PARTS, TRIMMED = 4, 0.02
#: Words of the prior in each class, standard errors that a ratio is moved towards zero, price of a word in a passage, fewest neighbourhoods of a scored word.
PRIOR, CAUTION, GAP, LEAST = 10_000.0, 2.0, 0.5, 5
#: Chance segments that may be expected beside a significant one, best segments that evidence combines, the highest evidence told apart.
ALPHA, BEST, CEILING = 0.05, 8, 40.0
#: Labels are learned where crc32(doc_id) modulo FOLDS isn't HELD_OUT; scores from CUT on are label 1.
FOLDS, HELD_OUT, CUT = 4, 2, 0.3
#: Words that a worker remembers before it starts its table anew.
REMEMBERED = 300_000

_WORD = re.compile(r"\w+")


class _Hashes(dict):
    """Hashes of lower-cased words, in a table of bounded size."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def neighbourhoods(text: str | None, hashes: dict) -> tuple[list[str], np.ndarray]:
    """The lower-cased words of a text and, for each, a hash of it with the word before and the word after."""
    found = [w.lower() for w in _WORD.findall(text or "")]
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return found, h
    before, after = np.r_[np.uint64(1), h[:-1]], np.r_[h[1:], np.uint64(2)]
    mix = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (before * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(7))
    mix = (mix ^ (mix >> np.uint64(31))) * np.uint64(0x165667B19E3779F9) + after * np.uint64(0xD6E8FEB86659FD93)
    return found, mix ^ (mix >> np.uint64(29))


def counted(sample: DataFrame) -> DataFrame:
    """word, part, label and n, the different neighbourhoods of a word, of rows of part, label and text."""
    schema = pa.schema([("part", pa.int8()), ("label", pa.int8()), ("word", pa.string()), ("near", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for part, label, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found, near = neighbourhoods(text, hashes)
                if found:
                    near, first = np.unique(near, return_index=True)
                    n = len(first)
                    yield arrow_rows(schema, {
                        "part": pa.array(np.full(n, part, np.int8)), "label": pa.array(np.full(n, label, np.int8)),
                        "word": [found[k] for k in first.tolist()], "near": pa.array(near.view(np.int64)),
                    })

    rows = sample.select("part", "label", "text").mapInArrow(run, "part byte, label byte, word string, near long")
    return rows.distinct().groupBy("word", "part", "label").agg(F.count("*").alias("n"))


def word_scores(counts: DataFrame) -> dict[str, list[float]]:
    """For each word that says something: its log ratio without each part of the sample, and last by all of it."""
    cell = lambda p, y: F.sum(F.when((F.col("part") == p) & (F.col("label") == y), F.col("n")).otherwise(0)).alias(f"n{p}{y}")
    words = materialize(counts.groupBy("word").agg(*[cell(p, y) for p in range(PARTS) for y in (0, 1)]), "words")
    total = words.agg(*[F.sum(f"n{p}{y}").alias(f"n{p}{y}") for p in range(PARTS) for y in (0, 1)]).first().asDict()

    def ratio(parts: list[int]) -> Column:
        clean, toxic = (sum((F.col(f"n{p}{y}") for p in parts), F.lit(0)).cast("double") for y in (0, 1))
        n_clean, n_toxic = (float(sum(total[f"n{p}{y}"] or 0 for p in parts)) for y in (0, 1))
        prior = F.greatest((clean + toxic) * (PRIOR / max(n_clean + n_toxic, 1.0)), F.lit(1e-9))
        d = F.log((toxic + prior) / (n_toxic + PRIOR - toxic)) - F.log((clean + prior) / (n_clean + PRIOR - clean))
        error = F.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
        sure = F.signum(d) * F.greatest(F.abs(d) - CAUTION * error, F.lit(0.0))
        return F.when(clean + toxic >= LEAST, sure).otherwise(0.0)

    among = [[p for p in range(PARTS) if p != without] for without in range(PARTS)] + [list(range(PARTS))]
    rows = words.select("word", F.array(*[ratio(parts) for parts in among]).alias("s")).filter(F.exists("s", lambda x: x != 0)).toArrow()
    return dict(zip(rows.column("word").to_pylist(), rows.column("s").to_pylist()))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as start, end (exclusive) and score, in order of their place."""
    places = np.flatnonzero(scores > 0)
    if not len(places):
        return []
    sums = np.concatenate([np.zeros(1), np.cumsum(scores)])
    # start, end, sum before, sum after, place in the stack of the last candidate that starts lower
    stack: list[tuple[int, int, float, float, int]] = []
    for at, low, high in zip(places.tolist(), sums[places].tolist(), sums[places + 1].tolist()):
        start = at
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((start, at + 1, low, high, j))
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, high - low) for a, b, low, high, _ in stack]


class Lexicon(dict):
    """Score of a word as written; the table of words seen is bounded."""

    def __init__(self, ratios: dict[str, float]):
        super().__init__()
        self.ratios = {w: r - GAP for w, r in ratios.items() if r}

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = self.ratios.get(word.lower(), -GAP)
        return value

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words and the maximal-scoring segments, by word."""
        found = _WORD.findall(text or "")
        return len(found), segments(np.fromiter(map(self.__getitem__, found), float, len(found)))


@dataclass
class Tail:
    """Chance segments: how many start per word, and how fast their scores decay."""

    rate: float = 1e-3
    decay: float = 1.0

    def expected(self, score: float, words: int) -> float:
        """Chance segments of at least this score in a text of this length."""
        return self.rate * words * math.exp(-self.decay * score)

    def evidence(self, scores: Iterable[float], words: int) -> float:
        """Minus the log of the probability that chance gives the best segments, at their best number."""
        best, total = 0.0, 0.0
        for r, score in enumerate(sorted(scores, reverse=True)[:BEST], 1):
            total += self.decay * score - math.log(self.rate * words)
            if total > r:
                surprise = total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - math.log(r)
                best = max(best, surprise)
        return min(best, CEILING)


def fit_tail(clean: Iterable[tuple[int, list[float]]]) -> Tail:
    """Tail from the number of words and the segment scores of clean texts.

    The decay is one over the mean without the highest scores, so some texts with a wrong label
    don't move it. One segment of the decay that exact log ratios have, one, is added.
    """
    words, scores = 0, [1.0]
    for n, found in clean:
        words += n
        scores += found
    kept = sorted(scores)[: len(scores) - int(len(scores) * TRIMMED)]
    return Tail(len(scores) / (words + 1000.0), 1 / max(float(np.mean(kept)), 0.1))


def fit_curve(evidence: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Bias and slope of the logistic curve, by Newton steps; one row of each label without evidence is added."""
    if not len(labels):
        return 0.0, 0.0
    x = np.c_[np.ones(len(labels) + 2), np.r_[evidence, 0.0, 0.0]]
    y = np.r_[labels, 0.0, 1.0]
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + 1e-3 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    # more evidence never makes a text less toxic
    return (float(w[0]), float(w[1])) if w[1] > 0 else (math.log((y.sum()) / (len(y) - y.sum())), 0.0)


@dataclass
class Model:
    ratios: dict[str, float] = field(default_factory=dict)
    tail: Tail = field(default_factory=Tail)
    bias: float = 0.0
    slope: float = 0.0

    def score(self, scores: Iterable[float], words: int) -> float:
        x = self.bias + (self.slope * self.tail.evidence(scores, words) if words else 0.0)
        return 1 / (1 + math.exp(-max(min(x, 35.0), -35.0)))


def sampled(docs: DataFrame, marks: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """part, label and text of the labelled rows that are learned from; ``docs`` has doc_id and text, ``marks`` doc_id and label."""
    marks = marks.filter("doc_id is not null and label is not null")
    n = docs.select("doc_id").join(marks, "doc_id").count()
    chosen = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))
    if n > sample:
        chosen = chosen.filter(F.col("h") < F.lit(int(-(2**63) + 2**64 * (sample / n))))
    rows = chosen.join(marks, "doc_id")
    part = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(PARTS)).cast("byte")
    return rows.select(part.alias("part"), F.col("label").cast("byte").alias("label"), "text", F.xxhash64("text").alias("h"))


def train(docs: DataFrame, marks: DataFrame, sample: int = SAMPLE) -> Model:
    rows = materialize(sampled(docs, marks, sample), "labelled")
    ratios = word_scores(counted(rows))
    known = docs.sparkSession.sparkContext.broadcast(ratios)
    schema = pa.schema([("h", pa.int64()), ("label", pa.int8()), ("words", pa.int64()), ("scores", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [Lexicon({w: r[p] for w, r in known.value.items()}) for p in range(PARTS)]
        for batch in batches:
            part, label, text, h = (batch.column(k).to_pylist() for k in range(4))
            found = [lexicons[k].scan(t) for k, t in zip(part, text)]
            best = [sorted((s for _, _, s in f), reverse=True)[:BEST] for _, f in found]
            yield arrow_rows(schema, {"h": h, "label": label, "words": [n for n, _ in found], "scores": best})

    # different texts only; no more rows than the sample has
    scanned = rows.mapInArrow(run, "h long, label byte, words long, scores array<double>").dropDuplicates(["h", "label"]).toArrow()
    label, words, scores = (scanned.column(k).to_pylist() for k in (1, 2, 3))
    tail = fit_tail((n, s) for y, n, s in zip(label, words, scores) if y == 0)
    evidence = np.array([tail.evidence(s, n) if n else 0.0 for n, s in zip(words, scores)], dtype=float)
    known.unpersist()
    bias, slope = fit_curve(evidence, np.array(label, dtype=float))
    return Model({w: r[-1] for w, r in ratios.items() if r[-1]}, tail, bias, slope)


PASSAGES = "array<struct<start: int, end: int, score: double, expected: double>>"


def toxic_passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_words and passages (offsets in characters, score, chance segments expected) of every row of ``docs`` (doc_id, text)."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_words", pa.int64()), ("passages", pa.list_(passage))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = known.value
        lexicon = Lexicon(made.ratios)
        for batch in batches:
            scores, words, passages = [], [], []
            for text in batch.column(1).to_pylist():
                n, found = lexicon.scan(text)
                scores.append(made.score((s for _, _, s in found), n))
                words.append(n)
                told = [(a, b, s, made.tail.expected(s, n)) for a, b, s in found]
                told = [p for p in told if p[3] <= ALPHA]
                if told:
                    spans = [m.span() for m in _WORD.finditer(text)]
                    told = [{"start": spans[a][0], "end": spans[b - 1][1], "score": s, "expected": e} for a, b, s, e in told]
                passages.append(told)
            yield arrow_rows(schema, {"doc_id": batch.column(0), "score": scores, "n_words": words, "passages": passages})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, score double, n_words long, passages {PASSAGES}")


def learned(spark: SparkSession, docs: DataFrame, sf_dir: str, sample: int = SAMPLE) -> Model:
    """The model from the labels outside the held-out fold."""
    marks = table(spark, sf_dir, "labels").filter("toxic is not null").select("doc_id", F.col("toxic").alias("label"))
    return train(docs.select("doc_id", "text").filter(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT), marks, sample)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxic_passages(docs, learned(spark, docs, sf_dir))
    return found.select(
        "doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"),
    )
