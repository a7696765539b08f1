"""Inspection of messages: screen, view, detect, resolve, map back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.operators.detectors import BUILTIN, Detector, detect_all
from maskwright.operators.screening import screen_table
from maskwright.operators.view import VIEW_COLUMNS, map_spans


def inspect(
    msgs: DataFrame, detectors: Sequence[Detector] = BUILTIN, block_mixed: bool = False
) -> DataFrame:
    """Adds ``spans``, ``signals`` and ``refusal`` to messages, all without a shuffle.

    ``refusal`` is the blocking screening code, or ``inspection_failed`` when a
    span does not map back, or NULL; refused messages carry no spans.
    """
    screened = screen_table(msgs, block_mixed)
    mapped = map_spans(detect_all(screened, detectors)).drop(*VIEW_COLUMNS)
    refusal = F.coalesce(
        F.col("screening.blocking"),
        F.when(F.col("unmapped") > 0, F.lit("inspection_failed")),
        *([F.when(F.col("model_failed"), F.lit("inspection_failed"))] if "model_failed" in mapped.columns else []),
    )
    checked = mapped.withColumns({"refusal": refusal, "signals": F.col("screening.signals")})
    return checked.withColumn("spans", F.expr("if(refusal is null, spans, slice(spans, 1, 0))")).drop(
        "screening", "unmapped", "model_failed"
    )


def quarantine(inspected: DataFrame) -> DataFrame:
    """Requests refused by inspection, with the code of the first refused message."""
    return (
        inspected.where("refusal is not null")
        .groupBy("request_id")
        .agg(F.min_by("refusal", "idx").alias("reason"), F.count(F.lit(1)).alias("n_messages"))
    )


def spans_table(inspected: DataFrame) -> DataFrame:
    """One row per span of accepted messages, with the scope columns."""
    keys = [c for c in inspected.columns if c not in ("text", "role", "spans", "signals", "refusal")]
    return inspected.select(*keys, F.inline("spans"))
