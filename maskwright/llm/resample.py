"""Importance resampling towards a target distribution, with hashed runs of words.

A text is its lower-cased words; its features are all runs of one to ``runs`` words. A feature's
bucket is the CRC-32 of its bytes modulo the number of buckets. The gain of a bucket is the smoothed
log ratio of its share in the target to its share in the corpus, a document's weight is the floored
mean of its features' gains, and documents are drawn without replacement by weight plus Gumbel noise
that a hash of the id fixes.

The vocabulary has a head and a tail. The head is every word, and every pair of words where runs are
longer than one, with at least 1/HEAD of all occurrences; by that share there can't be more than a
third above HEAD of them, whatever the corpus. They are found by a frequent-items summary per task,
whose size is fixed, and sums of the summaries. Of the head the exact CRC states are broadcast; a CRC
state is carried on by the next word, so a longer run starts from the state of its beginning. What is
not in the head takes its CRC directly. Both ways give the same number, so the totals of the buckets
are exact, whichever words are in the head. Each task adds up its buckets before they are dealt.

Texts are read where they lie: once for the head, once for the totals, once for the weights. Ranks
come from a range partition of narrow rows (score, doc_id): places within the parts and sums of the
parts before. There is no group of all rows anywhere.

Defined cases: a null or empty text has no words, weight 0 and is never drawn; a null doc_id has the
noise of an empty id and comes last among ties; repeated rows count, are scored and are ranked one by
one; ties of score go to the smaller doc_id, then to fewer features; an empty corpus gives no rows; an
empty target has T = 0 and t = 0; texts and words may be of any length (a word of more than
LONGEST_HEAD bytes is never in the head); extra columns are not used.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import arrow_rows, materialize, table

#: Longest run, buckets, seed of the noise, fewest words of a document that can be drawn, percent that is drawn.
RUNS, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: A head word has 1/HEAD of all occurrences or more; longest head word in bytes.
HEAD, LONGEST_HEAD = 30_000, 128

#: Lowers A-Z and makes a space of every ASCII sign that is neither a letter nor a digit.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a text in UTF-8."""
    return text.translate(_FOLD).split() if text else []


class Words(dict):
    """CRC of a word: known for the head, computed for the tail."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


class Pairs(dict):
    """CRC of a pair of words: known for the head, carried on from the first word's state for the tail."""

    def __init__(self, known: dict, words: Words):
        super().__init__(known)
        self.words = words

    def __missing__(self, pair: tuple[bytes, bytes]) -> int:
        return zlib.crc32(b" " + pair[1], self.words[pair[0]])


class Vocabulary:
    """CRC states of all runs of a text."""

    def __init__(self, head: list[bytes], head_pairs: list[tuple[bytes, bytes]], runs: int):
        self.runs = runs
        self.words = Words((w, zlib.crc32(w)) for w in head)
        self.pairs = Pairs({p: zlib.crc32(b" ".join(p)) for p in head_pairs}, self.words)

    def states(self, found: list[bytes]) -> list[int]:
        """One CRC per feature, shorter runs first."""
        last = list(map(self.words.__getitem__, found))
        out = last
        for n in range(2, min(self.runs, len(found)) + 1):
            if n == 2:
                last = list(map(self.pairs.__getitem__, zip(found, found[1:])))
            else:
                last = [zlib.crc32(b" " + w, s) for s, w in zip(last, found[n - 1 :])]
            out = out + last
        return out


class Frequent:
    """The frequent items of a stream in fixed memory: counts fall short by at most 1/``size`` of the stream."""

    def __init__(self, size: int):
        self.size, self.counts, self.total = size, Counter(), 0

    def add(self, items: list) -> None:
        self.counts.update(items)
        self.total += len(items)
        if len(self.counts) > 8 * self.size:
            least = int(np.partition(np.fromiter(self.counts.values(), np.int64), -self.size - 1)[-self.size - 1])
            self.counts = Counter({w: n - least for w, n in self.counts.items() if n > least})


def frequent(texts: DataFrame, run: int, head: int = HEAD) -> list:
    """Words (run 1) or pairs of words (run 2) of ``texts`` (text) with at least 1/head of all occurrences."""
    schema = pa.schema([("words", pa.list_(pa.binary())), ("n", pa.int64()), ("total", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Frequent(4 * head)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = words(text)
                summary.add(found if run == 1 else list(zip(found, found[1:])))
        if summary.total:
            # what is below this bound here and everywhere is no head word
            kept = [(w, n) for w, n in summary.counts.items() if n * 4 * head >= summary.total]
            kept = [((w,) if run == 1 else w, n) for w, n in kept]
            kept = [(list(w), n) for w, n in kept if max(map(len, w)) <= LONGEST_HEAD]
            yield arrow_rows(schema, {"words": [None, *[w for w, _ in kept]], "n": [0, *[n for _, n in kept]], "total": [summary.total, *[0] * len(kept)]})

    seen = texts.select(F.col("text").cast("binary")).mapInArrow(count, "words array<binary>, n long, total long")
    seen = materialize(seen.groupBy("words").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "frequent")
    total = seen.agg(F.sum("total")).first()[0] or 0
    # sums fall short by a quarter of the bound from the summaries and a quarter from what tasks left out
    rows = seen.filter(F.col("words").isNotNull() & (F.col("n") * (2 * head) >= total)).select("words").toArrow()
    found = [tuple(w) for w in rows.column("words").to_pylist()]
    return [w[0] for w in found] if run == 1 else found


def vocabulary(texts: DataFrame, runs: int = RUNS, head: int = HEAD) -> Vocabulary:
    return Vocabulary(frequent(texts, 1, head), frequent(texts, 2, head) if runs > 1 else [], runs)


def bucket_totals(texts: DataFrame, known, buckets: int = BUCKETS) -> np.ndarray:
    """Exact number of features per bucket over ``texts`` (text); ``known`` is the broadcast vocabulary."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                states = np.array(known.value.states(words(text)), dtype=np.int64)
                if len(states):
                    sums += np.bincount(states % buckets, minlength=buckets)
        used = np.flatnonzero(sums)
        yield arrow_rows(schema, {"bucket": pa.array(used.astype(np.int64)), "n": pa.array(sums[used])})

    rows = texts.select(F.col("text").cast("binary")).mapInArrow(count, "bucket long, n long")
    rows = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains_of(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of every bucket, each count raised by one."""
    t_all, s_all, n = float(target.sum()), float(corpus.sum()), float(len(corpus))
    pairs = zip(target.tolist(), corpus.tolist())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for t, s in pairs], dtype=np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Floored thousandfold Gumbel noise that the id fixes."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


class Resampler:
    """Vocabulary and gains for one corpus and one target; scores documents where they lie."""

    def __init__(self, docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED, head: int = HEAD):
        self.seed = seed
        context = docs.sparkSession.sparkContext
        self.known = context.broadcast(vocabulary(docs, runs, head))
        self.corpus_totals = bucket_totals(docs, self.known, buckets)
        self.target_totals = bucket_totals(target, self.known, buckets)
        self.gains = context.broadcast(gains_of(self.target_totals, self.corpus_totals))

    def scorer(self) -> Callable[[int | None, bytes | None], tuple[int, int, int, int]]:
        """From id and text to words, features, weight and score; to be called in a task."""
        known, gains, seed = self.known, self.gains, self.seed

        def of(doc_id: int | None, text: bytes | None) -> tuple[int, int, int, int]:
            found = words(text)
            states = np.array(known.value.states(found), dtype=np.int64)
            value = gains.value
            weight = int(value[states % len(value)].sum()) // len(states) if len(states) else 0
            return len(found), len(states), weight, weight + noise(doc_id, seed)

        return of

    def scored(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_words, n_features, weight and score of every row."""
        names = ("n_words", "n_features", "weight", "score")
        schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in names]])
        of = self.scorer()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [of(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                yield arrow_rows(schema, {"doc_id": batch.column(0), **{c: [r[k] for r in rows] for k, c in enumerate(names)}})

        made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
        return made.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``place`` (from 1) in a total order: places within the parts of a range partition after the sizes of the parts before."""
    marked = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = marked.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    dealt = materialize(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33).alias("__part")
    sizes = {r[0]: r[1] for r in dealt.groupBy(part).agg(F.count("*")).collect()}  # one row per part
    parts = sorted(sizes)
    before = dict(zip(parts, accumulate([0, *[sizes[p] for p in parts]])))
    spark = rows.sparkSession
    starts = spark.createDataFrame([(p, before[p]) for p in parts], "__part long, __before long")
    placed = dealt.withColumn("__part", part).join(F.broadcast(starts), "__part")
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.select(*rows.columns, place.alias("place"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED, head: int = HEAD,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where not drawn) of every row of ``docs`` (doc_id, text)."""
    scored = materialize(Resampler(docs, target, runs, buckets, seed, head).scored(docs), "scored")
    return with_ranks(scored, percent, least_words)


def with_ranks(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    able = F.col("n_words") >= least_words
    drawn = scored.filter(able).count() * percent // 100
    placed = ranked(scored.filter(able), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")])
    placed = placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    return placed.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED, head: int = HEAD,
) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns and without a shuffle of texts.

    The last one drawn has a score and a doc_id; who comes before or with it is drawn. Rows that
    repeat its doc_id and score come as well.
    """
    made = Resampler(docs, target, runs, buckets, seed, head)
    ranks = with_ranks(materialize(made.scored(docs), "scored"), percent, least_words)
    last = ranks.filter("rank is not null").agg(F.max_by(F.struct("score", "doc_id"), "rank").alias("last")).first()["last"]
    if last is None:
        return docs.limit(0)
    border = (-last.score, last.doc_id is None, last.doc_id or 0)
    of = made.scorer()

    @F.pandas_udf("boolean")
    def is_drawn(ids: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for i, text in zip(ids, texts):
            doc_id = None if pd.isna(i) else int(i)
            n, _, _, score = of(doc_id, text)
            out.append(n >= least_words and (-score, doc_id is None, doc_id or 0) <= border)
        return pd.Series(out, dtype=bool)

    # as text, since a column of longs with a null would come as floating point
    return docs.filter(is_drawn(F.col("doc_id").cast("string"), F.col("text").cast("binary")))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11_SQL = rf"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
doc_rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
doc_words AS (
  SELECT r, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM doc_rows
),
item_words AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
),
buckets AS (
  SELECT w, xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(octet_length(encode(w)) AS BIGINT)),
        lambda i: CAST(CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER) AS BIGINT))),
      lambda c, b: xor(t[CAST((xor(c, b) & 255) + 1 AS INTEGER)], c >> 8)), 4294967295) % {BUCKETS} AS b
  FROM (SELECT w FROM doc_words UNION SELECT w FROM item_words), crc_table
),
corpus AS (SELECT b, count(*) AS s FROM doc_words JOIN buckets USING (w) GROUP BY b),
target AS (SELECT b, count(*) AS t FROM item_words JOIN buckets USING (w) GROUP BY b),
gains AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM doc_words) + {BUCKETS}.0::DOUBLE)
    / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM item_words) + {BUCKETS}.0::DOUBLE)))) AS BIGINT) AS g
  FROM corpus LEFT JOIN target USING (b)
),
weights AS (SELECT r, count(*) AS n, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM doc_words JOIN buckets USING (w) JOIN gains USING (b) GROUP BY r),
scored AS (
  SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE)
      + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM doc_rows LEFT JOIN weights USING (r)
),
places AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score,
  CASE WHEN place <= {PERCENT} * (SELECT count(*) FROM places) // 100 THEN place END AS rank
FROM scored LEFT JOIN places USING (r)
"""
