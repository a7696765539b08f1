"""Screening of texts for encodings that exist to deceive a reader."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import fixed


def bidi_count(text: Column) -> Column:
    """Bidirectional controls."""
    return F.regexp_count(text, F.lit(fixed.BIDI_CLASS))


def invisible_count(text: Column) -> Column:
    """Format and control characters other than tab, line feed and return."""
    return F.regexp_count(text, F.lit(fixed.INVISIBLE_CLASS))


def invisible_ratio(text: Column) -> Column:
    """``struct(n, blocks)``: the count, and whether its share of the text blocks."""
    n = invisible_count(text)
    length = F.length(text)
    blocks = (length >= fixed.INVISIBLE_MIN_LENGTH) & (n / length > fixed.INVISIBLE_SHARE)
    return F.struct(n.alias("n"), blocks.alias("blocks"))


def confusable_count(text: Column) -> Column:
    """Characters that imitate an ASCII character."""
    return F.regexp_count(text, F.lit(fixed.CONFUSABLE_CLASS))


def _script(ch: str) -> str | None:
    """Script by the character's Unicode name, or None for neutral characters."""
    name = unicodedata.name(ch, "") if ch.isalpha() else ""
    for prefix in fixed.SCRIPT_PREFIXES:
        if name.startswith(prefix):
            return prefix
    return name.split(" ", 1)[0] or None


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def _mixed_flags(words: pa.Array) -> pa.Array:
    known: dict[str, str | None] = {}

    def mixed(word: str) -> bool:
        scripts = set()
        for ch in word:
            if ch not in known:
                known[ch] = _script(ch)
            if known[ch] is not None:
                scripts.add(known[ch])
        return len(scripts) > 1

    return pa.array(
        [None if row is None else [mixed(w) for w in row] for row in words.to_pylist()],
        pa.list_(pa.bool_()),
    )


def mixed_script_words(text: Column) -> Column:
    """Words with letters of more than one script.

    Words of one common script are dropped by a regular expression; only the
    others reach Python to have their scripts named.
    """
    word = rf"(?<![\p{{L}}\p{{N}}])(?=[\p{{L}}\p{{N}}]*{fixed.NOT_LATIN_LETTER})[\p{{L}}\p{{N}}]+"
    candidates = F.when(
        text.rlike(fixed.NOT_LATIN_LETTER),
        F.filter(F.regexp_extract_all(text, F.lit(word), F.lit(0)), lambda w: ~w.rlike(fixed.ONE_SCRIPT_WORD)),
    )
    flags = _mixed_flags(F.when(F.size(candidates) > 0, candidates))
    return F.coalesce(F.size(F.filter(flags, lambda b: b)), F.lit(0))


def screen_table(msgs: DataFrame, block_mixed: bool = False, text: str = "text") -> DataFrame:
    """Adds ``screening``: blocking code, its count and the map of signals.

    A bidirectional control stops the screening at once; invisible characters
    stop it when their share blocks; look-alikes and mixed scripts are signals.
    """
    t = F.col(text)
    # every count is a pass over the text, and all are zero for plain ASCII
    plain = ~t.rlike(r"[^\t\n\r -~]")
    counted = msgs.withColumn(
        "__c",
        F.when(plain, F.struct(F.lit(0).alias("bidi"), F.lit(0).alias("hidden"), F.lit(0).alias("fold")))
        .otherwise(F.struct(
            bidi_count(t).alias("bidi"), invisible_count(t).alias("hidden"), confusable_count(t).alias("fold"))),
    ).withColumn("__mixed", mixed_script_words(t))
    bidi, hidden, fold, mixed = F.col("__c.bidi"), F.col("__c.hidden"), F.col("__c.fold"), F.col("__mixed")
    length = F.length(t)
    hidden_blocks = (length >= fixed.INVISIBLE_MIN_LENGTH) & (hidden / length > fixed.INVISIBLE_SHARE)

    def signals(*pairs: tuple[str, Column]) -> Column:
        entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("bigint").alias("value")) for k, v in pairs])
        return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))

    full = signals((fixed.INVISIBLE, hidden), (fixed.CONFUSABLE, fold), (fixed.MIXED_SCRIPT, mixed))

    def outcome(code: Column, n: Column, found: Column) -> Column:
        return F.struct(
            code.cast("string").alias("blocking"), n.cast("int").alias("n"), found.alias("signals")
        )

    screening = (
        F.when(bidi > 0, outcome(F.lit(fixed.BIDI), bidi, signals((fixed.BIDI, bidi))))
        .when(hidden_blocks, outcome(F.lit(fixed.INVISIBLE), hidden, signals((fixed.INVISIBLE, hidden))))
        .when(F.lit(block_mixed) & (mixed > 0), outcome(F.lit(fixed.MIXED_SCRIPT), mixed, full))
        .otherwise(outcome(F.lit(None), F.lit(0), full))
    )
    return counted.withColumn("screening", screening).drop("__c", "__mixed")


def signal_rollup(screened: DataFrame, key: str = "request_id") -> DataFrame:
    """Signals summed over the messages of a request: ``(request_id, code, n)``."""
    return (
        screened.select(key, F.explode("screening.signals").alias("code", "n"))
        .groupBy(key, "code")
        .agg(F.sum("n").alias("n"))
    )
