"""Language identification by interpolated Kneser-Ney character models.

A text is its words, runs of letters in lower case; a word is read with a border on both sides, so
its probability does not depend on the words around it and can be remembered. Each language has one
model of character n-grams up to ORDER: absolute discounting with one discount per order, and
continuation counts below the highest order, down to an even distribution over the letters seen and
one unseen. A model is, per order, a sorted array of n-gram hashes with the discounted shares, and a
sorted array of context hashes with the weight that is left for the shorter context.

A text gets the language with the lowest cross-entropy per character, whatever its length. The
rejection is calibrated on the texts that were learned from: a text is rejected when its
cross-entropy in the best language is well beyond what almost all texts of that language, of about
the same length, have in it; a short text says little, so its bound is wider. The score is the share of the best language in a softmax over the
cross-entropies, with at most SURE characters of evidence, and it is halved for rejected texts.

Learning: word counts by language over a bounded sample of rows per language, chosen by the hash of
the id; n-gram counts come from the counts of different words. The models are bounded by the sample,
so they are broadcast. Scoring reads every text where it lies; nothing is shuffled.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without any learned
language all texts are ``und``; ties go to the language that sorts first; rows with null lang or
null id teach nothing; repeated rows give repeated rows; extra columns are not used.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import arrow_rows, fold_of, keep_only, materialize, table

#: Longest n-gram, most rows learned from per language, characters of evidence in the score.
ORDER, SAMPLE, SURE = 4, 3_000, 60
#: Share of a language's own texts that the rejection leaves, the slack beyond that bound, and more slack for
#: short texts: by so many characters over their length.
KEPT, SLACK, SHORT = 0.999, 1.4, 10
#: Words that a worker remembers before it starts its table anew.
REMEMBERED = 400_000
#: Longest stretch of letters that is one word; a longer one is read in pieces of this length.
LONGEST = 200
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)
_LETTERS = regex.compile(r"\p{L}+")
_START, _STOP = "\x02", "\x03"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    if not text:
        return []
    words = _WORD.findall(text.lower())
    if text.isascii():
        return words
    # numerals that are no decimal digits are no letters either
    return [p for w in words for p in ((w,) if w.isalpha() else _LETTERS.findall(w))]


def lines_of(words: list[str], order: int) -> np.ndarray:
    """Code points of all words, each with its borders."""
    before = _START * (order - 1)
    joined = "".join([f"{before}{w}{_STOP}" for w in words])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def hashes(codes: np.ndarray, at: np.ndarray, back: int, stop: int) -> np.ndarray:
    """Hashes of the stretches codes[at - back : at + stop]."""
    found = np.full(len(at), 1, dtype=np.uint64)
    for k in range(-back, stop):
        found = (found ^ codes[at + k]) * _MIX
        found ^= found >> np.uint64(31)
    return found


def gram_shares(top: dict[str, int], order: int) -> dict[int, tuple[dict[str, float], dict[str, float]]]:
    """Kneser-Ney from counts of the longest n-grams: by order, the discounted share of each n-gram
    and the weight that each context leaves to the shorter one."""
    counts = {order: Counter(top)}
    for n in range(order - 1, 0, -1):
        # below the highest order: how many different characters come before the n-gram
        counts[n] = Counter(gram[1:] for gram in counts[n + 1])
    out = {}
    for n, found in counts.items():
        once, twice = sum(c == 1 for c in found.values()), sum(c == 2 for c in found.values())
        discount = once / (once + 2 * twice) if once and twice else 0.5
        total: Counter = Counter()
        for gram, c in found.items():
            total[gram[:-1]] += c
        kinds = Counter(gram[:-1] for gram in found)
        out[n] = ({g: max(c - discount, 0) / total[g[:-1]] for g, c in found.items()}, {g: discount * kinds[g] / total[g] for g in total})
    return out


def _table(by_lang: list[dict[str, float]], default: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the strings of all languages, and their values, a column for each language."""
    strings = sorted(set().union(*by_lang))
    width = len(strings[0]) if strings else 0
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    keys = hashes(codes, np.arange(len(strings)) * width, 0, width)
    values = np.array([[d.get(g, default) for d in by_lang] for g in strings])
    order = np.argsort(keys)
    return keys[order], values[order]


def _look(known: np.ndarray, values: np.ndarray, keys: np.ndarray, default: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where((known[at] == keys)[:, None], values[at], default)


class Identifier:
    """The models of all languages, and the bounds of their rejection."""

    def __init__(self, grams: dict[str, dict[str, int]], order: int = ORDER):
        """grams: by language, the counts of the n-grams of ``order`` characters."""
        self.order, self.langs = order, sorted(grams)
        models = [gram_shares(grams[lang], order) for lang in self.langs]
        self.grams = {n: _table([m[n][0] for m in models], 0.0) for n in range(1, order + 1)} if models else {}
        self.contexts = {n: _table([m[n][1] for m in models], 1.0) for n in range(1, order + 1)} if models else {}
        self.floor = np.array([1.0 / (len(m[1][0]) + 1) for m in models])
        #: per language, by the power of two of the length: highest cross-entropy that is not rejected
        self.bounds: dict[str, dict[int, float]] = {}
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.langs)))

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "rows": np.zeros((0, len(self.langs)))}

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of the probability of each word and its end, a column for each language."""
        codes = lines_of(words, self.order)
        at = np.flatnonzero(codes != ord(_START))
        p = np.broadcast_to(self.floor, (len(at), len(self.langs)))
        for n in range(1, self.order + 1):
            share = _look(*self.grams[n], hashes(codes, at, n - 1, 1), 0.0)
            p = share + _look(*self.contexts[n], hashes(codes, at, n - 1, 0), 1.0) * p
        first = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
        return np.add.reduceat(np.log(p), first, axis=0)

    def remember(self, words: set[str]) -> None:
        """Adds the words to the table of this worker."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            start = len(self.known)
            if start + len(part) > len(self.rows):
                self.rows = np.r_[self.rows, np.zeros((len(self.rows) + len(part), len(self.langs)))]
            self.rows[start : start + len(part)] = self.log_probabilities(part)
            self.known |= zip(part, range(start, start + len(part)))

    def entropies(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, int]]:
        """For each text, the cross-entropy per character in each language, and the characters with the ends of words."""
        for start in range(0, len(texts), 100):
            lists = [words_of(t) for t in texts[start : start + 100]]
            if self.langs:
                self.remember(set().union(*lists))
            for words in lists:
                if not words or not self.langs:
                    yield np.zeros(0), 0
                    continue
                size = sum(map(len, words)) + len(words)
                yield -self.rows[[self.known[w] for w in words]].sum(axis=0) / size, size

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, bool, float | None]]:
        """For each text, language, score, whether it is rejected, and the cross-entropy in that language."""
        for entropy, size in self.entropies(texts):
            if not size:
                yield UNKNOWN, 0.0, True, None
                continue
            best = int(np.argmin(entropy))
            share = np.exp((entropy[best] - entropy) * min(size, SURE))
            rejected = bool(entropy[best] > self._bound(self.langs[best], size))
            yield self.langs[best], float(1 / share.sum()) * (0.5 if rejected else 1.0), rejected, float(entropy[best])

    def _bound(self, lang: str, size: int) -> float:
        """Of the lengths that were calibrated, the nearest that is no longer than the text, or else the shortest."""
        bounds = self.bounds.get(lang)
        if not bounds:
            return np.inf
        shorter = [k for k in bounds if k <= size.bit_length()]
        return bounds[max(shorter) if shorter else min(bounds)] * (SLACK + SHORT / size)


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n over rows of lang and text; counted within batches before the shuffle."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(words_of(text))
            for lang, found in words.items():
                grams: Counter = Counter()
                for word, n in found.items():
                    line = _START * (order - 1) + word + _STOP
                    for k in range(len(line) - order + 1):
                        grams[line[k : k + order]] += n
                if grams:
                    yield arrow_rows(schema, {"lang": [lang] * len(grams), "gram": list(grams), "n": list(grams.values())})

    return rows.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def sampled(rows: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Of each lang about ``most`` rows, those whose id has a hash below the language's bound."""
    rows = rows.filter("doc_id is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    limit = None
    for lang, n in sizes.items():
        if n > most:
            bound = F.when(F.col("lang") == lang, F.lit(int(-(2**63) + 2**64 * (most / n))))
            limit = bound if limit is None else F.coalesce(limit, bound)
    return rows if limit is None else rows.filter(F.xxhash64("doc_id") <= F.coalesce(limit, F.lit(2**63 - 1)))


def learn(rows: DataFrame, order: int = ORDER, most: int = SAMPLE) -> Identifier:
    """The identifier learned from rows of doc_id, lang and text."""
    rows = materialize(sampled(rows, most).select("lang", "text"), "languages")
    grams: dict[str, dict[str, int]] = {}
    for part in gram_counts(rows, order).collect():
        grams.setdefault(part["lang"], {})[part["gram"]] = part["n"]
    found = Identifier(grams, order)
    own = rows.sparkSession.sparkContext.broadcast(found)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = own.value
        for frame in frames:
            got = [
                (lang, size.bit_length(), float(entropy[model.langs.index(lang)]))
                for lang, (entropy, size) in zip(frame["lang"], model.entropies(frame["text"].tolist()))
                if size
            ]
            yield pd.DataFrame(got, columns=["lang", "length", "entropy"])

    spread = rows.mapInPandas(measure, "lang string, length int, entropy double").groupBy("lang", "length")
    for r in spread.agg(F.percentile_approx("entropy", KEPT, 10_000).alias("bound")).collect():
        found.bounds.setdefault(r["lang"], {})[r["length"]] = r["bound"]
    return found


def identify(docs: DataFrame, found: Identifier) -> DataFrame:
    """doc_id, lang_pred, score, rejected and entropy of every row of ``docs`` (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(found)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()), ("entropy", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(model.value.predict(batch.column(1).to_pylist()))
            columns = dict(zip(schema.names[1:], map(list, zip(*rows)))) if rows else {n: [] for n in schema.names[1:]}
            yield arrow_rows(schema, {"doc_id": batch.column(0)} | columns)

    out = "doc_id long, lang_pred string, score double, rejected boolean, entropy double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, out)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = learn(docs.filter(fold_of(F.col("doc_id")) != 0))
    return identify(docs, found).select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected", "entropy")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without a language: no letters, or rejected; texts are not shuffled.

    Null and empty texts go; repeated rows and rows without an id are decided like any other; the columns,
    whatever their names, stay as they are; an empty table stays empty.
    """
    model = spark.sparkContext.broadcast(learn(docs.filter(fold_of(F.col("doc_id")) != 0)))

    @F.pandas_udf("boolean")
    def has_language(texts: pd.Series) -> pd.Series:
        keep_only("language")
        return pd.Series([not r[2] for r in model.value.predict(texts.tolist())], dtype=bool)

    return docs.filter(has_language("text"))
