"""Detectors given by the user: term lists, patterns, filter sets, models."""

from __future__ import annotations

import heapq
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import fixed
from maskwright.operators.detectors import Detector, _keys, detect_with, pattern_detector
from maskwright.operators.resolve import SPANS_TYPE
from maskwright.session import materialize

# characters of terms in one automaton; longer lists are matched in several, one after the other
BLOCK_CHARS = 4_000_000


_SPAN_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
_SPAN_ROWS = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("text", T.StringType())]))


class UnsafePattern(ValueError):
    """A pattern that must not run."""


def _clean(terms: Sequence[str]) -> list[str]:
    kept = {t.strip() for t in terms if t and t.strip()}
    return sorted(kept, key=lambda t: (-len(t), t))


@lru_cache(maxsize=1)
def _fold_table() -> dict[int, int]:
    """One character for all that a scan without case takes for the same.

    Characters are the same when their simple lower cases have the same upper case;
    the mapping keeps the length of a text.
    """
    groups: dict[str, list[int]] = {}
    for code in range(0x110000):
        char = chr(code)
        if char.lower() != char or char.upper() != char:
            simple = char.lower() if len(char.lower()) == 1 else char.lower()[0]
            groups.setdefault(simple.upper(), []).append(code)
    return {c: min(g) for g in groups.values() if len(g) > 1 for c in g if c != min(g)}


_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")


def _folded(text: str) -> str:
    """``text`` by the fold table, in which ASCII letters are their upper case."""
    upper = text.encode("utf-8", "surrogatepass").upper().decode("utf-8", "surrogatepass")
    return upper if text.isascii() else _BEYOND_ASCII.sub(lambda m: m.group().translate(_fold_table()), upper)


def _automaton(terms: Sequence[str], case_sensitive: bool) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in terms:
        key = term if case_sensitive else _folded(term)
        found.add_word(key, len(key))
    found.make_automaton()
    return found


_automata: dict[str, object] = {}


def _span_lists(texts: list[str | None], found: list[list[tuple[int, int]] | None]) -> pa.Array:
    """Spans of every text as an Arrow array, null where there is no text."""
    ends = [0]
    for spans in found:
        ends.append(ends[-1] + len(spans or ()))
    flat = [(a, b, text[a:b]) for text, spans in zip(texts, found) for a, b in spans or ()]
    starts, stops, words = zip(*flat) if flat else ((), (), ())
    value = _SPAN_ARROW.value_type
    places = pa.StructArray.from_arrays(
        [pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(words, pa.string())], fields=list(value))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places, mask=pa.array([x is None for x in found], pa.bool_()))


def _taken(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What a scan from the left takes, the longest at each place."""
    out, at = [], 0
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out.append((a, b))
            at = b
    return out


def _matches_of(source, case_sensitive: bool, settled: bool):
    """All places of terms that are not inside words, as an Arrow function; if ``settled``, those that a scan takes."""
    name = uuid.uuid4().hex

    def run(texts: pa.Array) -> pa.Array:
        if name not in _automata:
            _automata.clear()
            _automata[name] = _automaton(source.value, case_sensitive)
        automaton = _automata[name]
        values, found = texts.to_pylist(), []
        for text in values:
            if text is None:
                found.append(None)
                continue
            folded = text if case_sensitive else _folded(text)
            spans, size = [], len(text)
            # most places are inside words, so what is in a word is told without a call
            for last, n in automaton.iter(folded):
                a, b = last - n + 1, last + 1
                if a and ((c := text[a - 1]).isalnum() or c == "_") or b < size and ((c := text[b]).isalnum() or c == "_"):
                    continue
                spans.append((a, b))
            found.append(_taken(spans) if settled else spans)
        return _span_lists(values, found)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _SPAN_ROWS)


def _settle():
    """What a scan takes of the places that several blocks of terms have found, as an Arrow function."""

    def run(texts: pa.Array, places: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        found = [None if row is None else _taken([(s["start"], s["end"]) for s in row]) for row in places.to_pylist()]
        return _span_lists(values, found)

    run.__annotations__ = {"texts": pa.Array, "places": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _SPAN_ROWS)


def _blocks(terms: Sequence[str]) -> list[list[str]]:
    out: list[list[str]] = []
    room = 0
    for term in terms:
        if not out or len(term) > room:
            out.append([])
            room = BLOCK_CHARS
        out[-1].append(term)
        room -= len(term)
    return out


def dictionary_detector(
    terms: Sequence[str], entity_type: str = "CUSTOMER_TERM", name: str = "customer_dictionary",
    case_sensitive: bool = False,
) -> Detector:
    """Exact terms, leftmost and longest first, not inside words; for lists of any size.

    One automaton per block of terms finds all places where a text lies, and a scan from
    the left takes the longest term at each place, in the same pass where there is one block.
    """
    blocks = _blocks(_clean(terms))
    if not blocks:
        return Detector(name, (entity_type,), (lambda text, _: {"spans": f"cast(null as {SPANS_TYPE})"},), False, "custom")
    column = "__terms_" + re.sub(r"\W", "_", name)

    def prepare(df: DataFrame, text: str) -> DataFrame:
        context = df.sparkSession.sparkContext
        parts = [_matches_of(context.broadcast(block), case_sensitive, len(blocks) == 1)(F.col(text)) for block in blocks]
        return df.withColumn(column, _settle()(F.col(text), F.concat(*parts)) if len(parts) > 1 else parts[0])

    def stage(_text: str, _cols: dict[str, str]) -> dict[str, str]:
        return {"spans": (
            f"transform({column}, m -> named_struct('start', m.start, 'end', m.end, 'entity_type', "
            f"'{entity_type}', 'text', m.text, 'score', cast({fixed.CERTAIN} as double), 'detector', '{name}'))")}

    return Detector(name, (entity_type,), (stage,), False, "custom", prepare)


def check_pattern(pattern: str) -> bool:
    """Refuses unsafe patterns; returns whether it surely never matches nothing."""
    if len(pattern) > fixed.MAX_PATTERN_LENGTH:
        raise UnsafePattern(f"a pattern has at most {fixed.MAX_PATTERN_LENGTH} characters")
    if re.search(fixed.NESTED_QUANTIFIER, pattern):
        raise UnsafePattern("a repeated group must not hold an unbounded repetition")
    try:
        compiled = re.compile(pattern)
    except re.error as error:
        raise UnsafePattern("not a regular expression") from error
    # without constructs that match between characters, what can match nothing does so in an empty text
    return compiled.match("") is None and not re.search(r"\(\?[=!<]|[\^$]|\\[bBAZ]", pattern)


def _runs_on_jvm(pattern: str) -> bool:
    """Whether the pattern means the same to the JVM.

    It has to match at least one character, and to use no construct that the two
    dialects spell or read differently.
    """
    never_empty = check_pattern(pattern)
    differs = r"\\[wWbBsSdDZ]|\(\?[Paiulmsx(]|\\[0-9N]|\$|\[\^?\]|&&|\[[^\]]*\["
    return never_empty and not re.search(differs, pattern) and "'" not in pattern


def _python_matches(pattern: str, flags: int):
    def run(texts: pa.Array) -> pa.Array:
        compiled = re.compile(pattern, flags)
        return pa.array(
            [None if t is None else
             [{"start": m.start(), "end": m.end(), "text": m.group()} for m in compiled.finditer(t) if m.group()]
             for t in texts.to_pylist()], _SPAN_ARROW)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _SPAN_ROWS)


def regex_detector(
    pattern: str, entity_type: str, name: str | None = None, case_sensitive: bool = True
) -> Detector:
    """Matches of a user's pattern; zero-width matches are no spans.

    Patterns that mean the same to the JVM run there. Others keep the dialect
    they were written in and run in Arrow batches.
    """
    entity_type = entity_type.upper()
    name = name or f"custom_regex:{entity_type}"
    if _runs_on_jvm(pattern):
        java = pattern if case_sensitive else f"(?iu){pattern}"
        return pattern_detector(name, entity_type, java, fixed.HIGH, folded=False, kind="custom")
    column = "__re_" + re.sub(r"\W", "_", name)
    matches = _python_matches(pattern, 0 if case_sensitive else re.IGNORECASE)

    def prepare(df: DataFrame, text: str) -> DataFrame:
        return df.withColumn(column, matches(F.col(text)))

    def stage(_text: str, _cols: dict[str, str]) -> dict[str, str]:
        return {"spans": (
            f"transform({column}, m -> named_struct('start', m.start, 'end', m.end, 'entity_type', "
            f"'{entity_type}', 'text', m.text, 'score', cast({fixed.HIGH} as double), 'detector', '{name}'))")}

    return Detector(name, (entity_type,), (stage,), False, "custom", prepare)


def detect_dictionary(msgs: DataFrame, terms: Sequence[str], **options) -> DataFrame:
    """Span table of a term list of any size."""
    return detect_with(msgs, [dictionary_detector(terms, **options)])


_WORD = re.compile(r"\w+")
_WORD_OR_SIGN = re.compile(r"\w+|\W")
_WORD_OR_GAP = re.compile(r"\w+|\W+")
_NO_WORD = re.compile(r"\W")
# words, and signs between words, that a task holds as Python objects at a time
_HELD = 16_384
# texts and terms are matched in groups of about so many bytes of texts, and in as many as there are so many characters of terms
GROUP_BYTES = 32_000_000
GROUP_CHARS = 4_000_000


def _tokens(batch: pa.Array, token: re.Pattern[str], fold: bool) -> Iterator[tuple[list[str], np.ndarray]]:
    """The tokens of all texts in bounded parts, each with its runs: the number of a text, how many tokens and characters of it came before, how many tokens are here.

    Parts end before a sign, so no word is cut.
    """
    held: list[str] = []
    runs: list[tuple[int, int, int, int]] = []
    for n, value in enumerate(batch):
        text = value.as_py()
        if not text:
            continue
        text = _folded(text) if fold else text
        before = start = 0
        while start < len(text):
            m = _NO_WORD.search(text, start + _HELD - 1)
            end = m.start() if m else len(text)
            part = token.findall(text, start, end)
            if held and len(held) + len(part) > _HELD:
                yield held, np.array(runs).T
                held, runs = [], []
            held += part
            runs.append((n, before, start, len(part)))
            before, start = before + len(part), end
    if held:
        yield held, np.array(runs).T


def _term_table(terms: DataFrame, case_sensitive: bool) -> DataFrame:
    """``(term, words, signs)`` of different terms, folded, with their different words; terms of signs alone have ``signs``, and their signs as words."""
    out = T.StructType([T.StructField("term", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("signs", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for term in batch.column(0).to_pylist():
                term = (term or "").strip()
                if term:
                    folded = term if case_sensitive else _folded(term)
                    words = _WORD.findall(folded)
                    rows.append((folded, list(dict.fromkeys(words or folded)), not words))
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, r)) for r in rows], schema=pa.schema([
                ("term", pa.string()), ("words", pa.list_(pa.string())), ("signs", pa.bool_())]))

    return terms.select(F.col("term").cast("string")).mapInArrow(run, out).dropDuplicates(["term"])


def _word_stream(msgs: DataFrame, keys: Sequence[str], case_sensitive: bool, signs: bool) -> DataFrame:
    """``keys``, a word of the folded text or, with ``signs``, a sign between words, and where it comes among these in the text.

    A task holds a bounded number of words at a time, so a word of a long text may have several rows.
    """
    kept = msgs.select(*keys).schema
    out = T.StructType([*kept.fields, T.StructField("word", T.StringType()), T.StructField("occ", T.ArrayType(T.IntegerType()))])
    token = _WORD_OR_SIGN if signs else _WORD

    def batch_of(batch: pa.RecordBatch, found: list[str], runs: np.ndarray) -> pa.RecordBatch:
        text, before, _, counts = runs
        coded = pa.array(found, pa.string()).dictionary_encode()
        codes = coded.indices.to_numpy()
        at = np.repeat(text, counts)
        nth = np.arange(len(found)) - np.repeat(np.cumsum(counts) - counts - before, counts)
        # places of one word of one text side by side
        key = at * len(coded.dictionary) + codes
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.diff(key[order], prepend=-1))
        first = order[heads]
        rows = pa.array(at[first])
        kept_columns = [batch.column(k).take(rows) for k in range(batch.num_columns - 1)]
        places = pa.ListArray.from_arrays(pa.array(np.append(heads, len(found)), pa.int32()), pa.array(nth[order], pa.int32()))
        return pa.RecordBatch.from_arrays([*kept_columns, coded.dictionary.take(pa.array(codes[first])), places], names=out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, runs in _tokens(batch.column(batch.num_columns - 1), token, not case_sensitive):
                yield batch_of(batch, found, runs)

    return msgs.select(*keys, F.col("text").alias("__text")).mapInArrow(run, out)


class _Terms:
    """Folded terms, looked up by one word or sign of each, their anchor."""

    def __init__(self) -> None:
        self.terms: set[str] = set()
        # of an anchor, how far into its terms it lies and how long they are
        self.shapes: dict[str, set[tuple[int, int]]] = {}
        self.reach = 0
        self.token = _WORD
        self.only_words = True

    def add(self, term: str, anchor: str) -> None:
        if _WORD.match(anchor):
            at = next(m.start() for m in _WORD.finditer(term) if m.group() == anchor)
        else:
            at, self.token = term.index(anchor), _WORD_OR_SIGN
        self.terms.add(term)
        self.shapes.setdefault(anchor, set()).add((at, len(term)))
        self.reach = max(self.reach, at)
        self.only_words &= term == anchor and self.token is _WORD

    def spans(self, text: str, folded: str) -> Iterator[tuple[int, int]]:
        """What a scan of the text from the left takes, the longest at each place, none inside words."""
        terms, shapes, reach, size = self.terms, self.shapes, self.reach, len(text)
        waiting: list[tuple[int, int]] = []
        done = 0
        for m in self.token.finditer(folded):
            shapes_here = shapes.get(m.group())
            if not shapes_here:
                continue
            at = m.start()
            # what starts so far back can't be met any more by a longer or an earlier one
            while waiting and waiting[0][0] < at - reach:
                a, b = heapq.heappop(waiting)
                if a >= done:
                    done = -b
                    yield a, done
            for back, length in shapes_here:
                a = at - back
                b = a + length
                if a < 0 or b > size or folded[a:b] not in terms:
                    continue
                if a and ((c := text[a - 1]).isalnum() or c == "_") or b < size and ((c := text[b]).isalnum() or c == "_"):
                    continue
                heapq.heappush(waiting, (a, -b))
        while waiting:
            a, b = heapq.heappop(waiting)
            if a >= done:
                done = -b
                yield a, done


@lru_cache(maxsize=1)
def _cut_by_fold() -> str:
    """A pattern of the characters of words that fold to one that is in no word: the iotas, since one is a mark. They cut a folded word."""
    return "[" + "".join(chr(c) for c, to in _fold_table().items() if _WORD.match(chr(c)) and not _WORD.match(chr(to))) + "]"


def _matched(dealt: DataFrame, keys: Sequence[str], fields: Sequence[T.StructField], case_sensitive: bool) -> DataFrame:
    """``keys``, start, end and text of the spans of every text, by the terms that precede it in its partition."""
    out = T.StructType([*fields, T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("__found", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms()
        for batch in batches:
            *kept, texts, terms, anchors = batch.columns
            if texts.null_count:
                for term, anchor in zip(terms.to_pylist(), anchors.to_pylist()):
                    if term is not None:
                        known.add(term, anchor)

            def batch_of(at, starts, ends, words) -> pa.RecordBatch:
                at = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [*(k.take(at) for k in kept), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(words, pa.string())], names=out.names)

            # words as they are cut in the folded text are the words of the text, and they don't overlap
            if known.only_words and (case_sensitive or not pc.any(pc.match_substring_regex(texts, _cut_by_fold())).as_py()):
                for tokens, (text, _, before, counts) in _tokens(texts, _WORD_OR_GAP, not case_sensitive):
                    hit = np.fromiter(map(known.terms.__contains__, tokens), np.bool_, len(tokens))
                    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
                    ends = np.cumsum(sizes)
                    # a run begins where the texts before it ended
                    first = np.cumsum(counts) - counts
                    ends -= np.repeat(ends[first] - sizes[first] - before, counts)
                    at, starts, ends = np.repeat(text, counts)[hit], (ends - sizes)[hit], ends[hit]
                    written = {n: texts[n].as_py() for n in set(text.tolist())}
                    yield batch_of(at, starts, ends, [written[n][a:b] for n, a, b in zip(at.tolist(), starts.tolist(), ends.tolist())])
                continue
            found: list[tuple[int, int, int, str]] = []
            for n, value in enumerate(texts):
                text = value.as_py()
                if text is None:
                    continue
                for a, b in known.spans(text, text if case_sensitive else _folded(text)):
                    found.append((n, a, b, text[a:b]))
                    if len(found) == _HELD:
                        yield batch_of(*zip(*found))
                        found = []
            if found:
                yield batch_of(*zip(*found))

    return dealt.select(*keys, "__text", "__term", "__anchor").mapInArrow(run, out)


def detect_dictionary_table(
    msgs: DataFrame, terms: DataFrame, entity_type: str = "CUSTOMER_TERM", name: str = "customer_dictionary", case_sensitive: bool = False,
) -> DataFrame:
    """Span table of a term table ``(term)`` of any size: exact terms, leftmost and longest first, not inside words.

    Texts are dealt once, to groups by a hash. The different words of every group are joined with the words of the terms, and a
    group gets the terms whose rarest word in all texts occurs in it; terms with a word that is nowhere go to none. A task reads the
    terms of its group before the texts and takes the spans of one text after the other, so that neither words of the texts nor matches are
    dealt or stored. Terms of signs alone are dealt by their rarest sign. Nothing of the terms goes through the driver; the
    planner broadcasts them where they are small. ``msgs`` is read three times,
    and is stored before if it has ids by chance or by place.
    Null and empty terms and texts have no spans. Words are what ``\\w`` takes for it.
    """
    keys = _keys(msgs)
    spark = msgs.sparkSession
    known = materialize(_term_table(terms, case_sensitive), "terms")
    any_signs, n_chars = known.agg(F.bool_or("signs"), F.sum(F.length("term"))).first()
    texts = msgs.where("text <> ''")
    # a text has to be in the same group whenever it is read
    if not texts._jdf.queryExecution().analyzed().deterministic():
        texts = materialize(texts, "texts")
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    n_groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (n_bytes or 0) // GROUP_BYTES + 1, (n_chars or 0) // GROUP_CHARS + 1)
    hashed = [f.name for f in msgs.select(*keys).schema if isinstance(f.dataType, (T.NumericType, T.StringType))]
    grouped = texts.withColumn("__group", F.pmod(F.xxhash64(*hashed, "text"), F.lit(n_groups)).cast("int"))

    used = known.select(F.explode("words").alias("word")).distinct()
    stream = _word_stream(grouped, ["__group"], case_sensitive, bool(any_signs))
    words = materialize(stream.groupBy("__group", "word").agg(F.sum(F.size("occ")).alias("n")).join(used, "word", "left_semi"), "words")
    counts = words.groupBy("word").agg(F.sum("n").alias("n"))
    # the rarest word of each term; a term with a word that is nowhere has no match
    rated = known.select("term", F.size("words").alias("k"), F.explode("words").alias("word")).join(counts, "word")
    anchors = rated.groupBy("term", "k").agg(F.min(F.struct("n", "word"))["word"].alias("word"), F.count(F.lit(1)).alias("seen")).where("seen = k")
    looked = anchors.join(words, "word").select("__group", F.col("term").alias("__term"), F.col("word").alias("__anchor"))

    dealt = grouped.select(*keys, F.col("text").alias("__text"), "__group").unionByName(looked, allowMissingColumns=True)
    dealt = dealt.repartitionById(n_groups, "__group").sortWithinPartitions(F.col("__text").isNotNull())
    spans = _matched(dealt, keys, msgs.select(*keys).schema.fields, case_sensitive)
    return spans.select(*keys, "start", "end", F.lit(entity_type).alias("entity_type"), F.col("__found").alias("text"),
                        F.lit(fixed.CERTAIN).cast("double").alias("score"), F.lit(name).alias("detector"))


def detect_custom_regex(msgs: DataFrame, pattern: str, entity_type: str, **options) -> DataFrame:
    """Span table of a user's pattern."""
    return detect_with(msgs, [regex_detector(pattern, entity_type, **options)])


def filter_detectors(filters: Sequence[dict]) -> list[Detector]:
    """Detectors of the enabled filters of a validated filter set."""
    built = []
    for item in filters:
        if not item.get("enabled", True):
            continue
        match, name = item["match"], f"filter:{item['name']}"
        if match["type"] == "regex":
            built.append(regex_detector(
                match["pattern"], item["entity_type"], name, match.get("case_sensitive", True)))
        else:
            built.append(dictionary_detector(
                match["terms"], item["entity_type"], name, match.get("case_sensitive", False)))
    return built


def detect_filters(msgs: DataFrame, filters: Sequence[dict]) -> DataFrame:
    """Span table of a filter set."""
    return detect_with(msgs, filter_detectors(filters))


Entities = Callable[[str], list[tuple[int, int, str, float]]]


def model_detector(loader: Callable[[], Entities], min_score: float = fixed.LOW) -> Detector:
    """Entities of a user's model, which ``loader`` loads once per task.

    The model returns ``(start, end, label, score)`` rows for a text. Unknown
    labels, low scores and offsets outside the text are dropped. A text the model
    fails on is marked in ``model_failed`` and so refused, never passed unscanned.
    """
    labels = dict(fixed.MODEL_LABELS)

    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for texts in batches:
            rows = []
            for text in texts:
                try:
                    raw_rows = model(text)
                except Exception:  # noqa: BLE001 - the text is refused, its content never reported
                    rows.append(None)
                    continue
                rows.append([
                    {"start": s, "end": e, "entity_type": labels[label.upper()], "text": text[s:e],
                     "score": float(score), "detector": "ner"}
                    for s, e, label, score in raw_rows
                    if label.upper() in labels and score >= min_score and 0 <= s < e <= len(text)
                ])
            yield pd.Series(rows)

    spans.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(spans, SPANS_TYPE)

    def prepare(df: DataFrame, text: str) -> DataFrame:
        return df.withColumn("__model", udf(F.col(text))).withColumn("model_failed", F.col("__model").isNull())

    entity_types = tuple(sorted(set(labels.values())))
    return Detector("ner", entity_types, (lambda _t, _c: {"spans": "__model"},), False, "model", prepare)


def detect_with_model(msgs: DataFrame, loader: Callable[[], Entities], min_score: float = fixed.LOW) -> DataFrame:
    """Span table of a user's model."""
    return detect_with(msgs, [model_detector(loader, min_score)])
