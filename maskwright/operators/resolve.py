"""Conflict resolution and counting of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.arrays import exclusive_scan, let

SPAN_TYPE = "struct<start:int,end:int,entity_type:string,text:string,score:double,detector:string>"
SPANS_TYPE = f"array<{SPAN_TYPE}>"
_DIRECT = 64


def _greedy(spans: str) -> str:
    """Best rank first, keep what overlaps nothing kept, in order of start."""
    rank = (
        f"sort_array(transform({spans}, s -> struct(-s.score, s.start - s.end, s.start, "
        "s.entity_type, s.detector, s as span)))"
    )
    return (
        f"sort_array(aggregate(transform({rank}, r -> r.span), cast(array() as {SPANS_TYPE}), "
        "(kept, s) -> if(exists(kept, k -> k.start < s.end and s.start < k.end), kept, concat(kept, array(s)))))"
    )


def _by_component(spans: str) -> str:
    """As ``_greedy``, within each run of spans that overlap one another.

    Spans of different runs cannot compete, so a text with very many spans costs
    one sort and small comparisons instead of a comparison of all with all.
    """
    reach = exclusive_scan("transform(ordered, s -> s.end)", "-1", lambda a, v: f"greatest({a}, {v})")
    heads = (
        f"filter(transform(zip_with(ordered, {reach}, (s, r) -> s.start >= r), (fresh, i) -> if(fresh, i, null)), "
        "i -> i is not null)"
    )
    runs = (
        "transform(heads, (h, i) -> slice(ordered, h + 1, coalesce(get(heads, i + 1), size(ordered)) - h))"
    )
    return let("ordered", f"sort_array({spans})", let("heads", heads,
               f"flatten(transform({runs}, run -> if(size(run) = 1, run, {_greedy('run')})))"))


def resolve_spans(spans: str) -> str:
    """The non-overlapping spans to keep, ordered by start, as a SQL expression.

    Rank: score, then length, both descending, then start, type, detector.
    """
    return (
        f"case when size({spans}) <= 1 then {spans} when size({spans}) <= {_DIRECT} then {_greedy(spans)} "
        f"else {_by_component(spans)} end"
    )


def resolve_table(spans: DataFrame, *keys: str) -> DataFrame:
    """``resolve_spans`` for a table of spans, per message given by ``keys``.

    The group collected is one message's spans, so it is bounded by its text.
    """
    row = F.struct("start", "end", "entity_type", "text", "score", "detector").cast(SPAN_TYPE)
    grouped = spans.groupBy(*keys).agg(F.collect_list(row).alias("__all"))
    return (
        grouped.withColumn("__kept", F.expr(resolve_spans("__all")))
        .select(*keys, F.inline("__kept"))
    )


def entity_counts(spans: DataFrame, key: str = "request_id") -> DataFrame:
    """``(request_id, entity_type, n)``."""
    return spans.groupBy(key, "entity_type").agg(F.count(F.lit(1)).alias("n"))


def entity_presence(inspected: DataFrame, key: str = "request_id") -> DataFrame:
    """Per request the sorted distinct types and whether anything was found.

    Reads the ``spans`` array of messages; requests without spans are kept.
    """
    types = inspected.selectExpr(
        key, "explode_outer(array_distinct(transform(spans, s -> s.entity_type))) as t")
    return types.groupBy(key).agg(
        F.sort_array(F.collect_set("t")).alias("types"),
        (F.count("t") > 0).alias("any_detection"),
    )
