"""Detection view: what detectors read, and the way back to the original text."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import fixed
from maskwright.functions.text import fold_confusables, is_identity

VIEW_TYPE = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
    ]
)


def _rebuild(text: str) -> dict:
    """Leave out ignorables and normalise each base character with its marks.

    An ignorable character belongs to the next kept one, trailing ones to the
    last; ``starts``/``ends`` give the original range of every view character.
    """
    kept = [i for i, ch in enumerate(text) if not fixed.ignorable(ch)]
    heads = [
        n for n, i in enumerate(kept) if n == 0 or unicodedata.combining(text[i]) == 0
    ]
    pieces, starts, ends = [], [], []
    for head, following in zip(heads, heads[1:] + [len(kept)]):
        begin = kept[head - 1] + 1 if head else 0
        end = kept[following - 1] + 1 if following < len(kept) else len(text)
        out = unicodedata.normalize("NFKC", "".join(text[i] for i in kept[head:following]))
        pieces.append(out)
        starts.extend([begin] * len(out))
        ends.extend([end] * len(out))
    return {"text": "".join(pieces), "starts": starts, "ends": ends}


_VIEW_ARROW = pa.struct(
    [("text", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]
)


@F.arrow_udf(VIEW_TYPE)
def _rebuilt_views(texts: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else _rebuild(t) for t in texts.to_pylist()], type=_VIEW_ARROW
    )


VIEW_COLUMNS = ("view_text", "view_folded", "view_starts", "view_ends")


def detection_view(msgs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``view_text``, ``view_folded`` and the origin arrays ``view_starts``/``view_ends``.

    The arrays are NULL where the view is the text. Only texts holding a character
    whose view differs are sent to Python. The columns are flat on purpose: fields
    of a struct would be put back into every expression that reads them.
    """
    rebuilt = msgs.withColumn(
        "__rebuilt", _rebuilt_views(F.when(~is_identity(F.col(text)), F.col(text)))
    )
    return (
        rebuilt.withColumns({
            "view_text": F.coalesce(F.col("__rebuilt.text"), F.col(text)),
            "view_starts": F.col("__rebuilt.starts"),
            "view_ends": F.col("__rebuilt.ends"),
        })
        .withColumn("view_folded", fold_confusables(F.col("view_text")))
        .drop("__rebuilt")
    )


def _mapped(spans: str, text: str) -> str:
    """Spans of a rebuilt view in offsets of the text, as a SQL expression.

    Kept are spans inside the view that begin and end with whole clusters. That
    is the round-trip test: viewing the mapped slice again gives the view of its
    clusters, which differs from the match exactly when a cluster was cut.
    """
    inside = "s.start >= 0 and s.start < s.end and s.end <= size(view_starts)"
    starts = "view_starts"
    whole = (
        f"(s.start = 0 or get({starts}, s.start - 1) <> get({starts}, s.start)) and "
        f"(s.end = size({starts}) or get({starts}, s.end) <> get({starts}, s.end - 1))"
    )
    begin = f"get({starts}, s.start)"
    end = "array_max(slice(view_ends, s.start + 1, s.end - s.start))"
    return (
        f"transform(transform(filter({spans}, s -> {inside} and {whole}), s -> named_struct("
        f"'begin', {begin}, 'end', {end}, 's', s)), m -> named_struct('start', m.begin, 'end', m.end, "
        f"'entity_type', m.s.entity_type, 'text', substr({text}, m.begin + 1, m.end - m.begin), "
        "'score', m.s.score, 'detector', m.s.detector))"
    )


def map_spans(df: DataFrame, spans: str = "spans", text: str = "text") -> DataFrame:
    """Spans of the view as spans of the text; adds ``unmapped``, the number that failed.

    Spans that are out of range or fail the round trip are left out of the
    result and counted: the caller refuses such records. What is left cannot
    overlap if the view spans did not, because clusters do not overlap.
    """
    # look-alikes keep their places, so only the text of their spans is taken from the original
    refilled = (
        f"transform({spans}, s -> named_struct('start', s.start, 'end', s.end, 'entity_type', s.entity_type, "
        f"'text', substr({text}, s.start + 1, s.end - s.start), 'score', s.score, 'detector', s.detector))"
    )
    mapped = (
        f"case when size({spans}) = 0 then {spans} when view_starts is not null then {_mapped(spans, text)} "
        f"when view_folded = {text} then {spans} else {refilled} end"
    )
    others = [f"`{c}`" for c in df.columns if c != spans]
    return (
        df.selectExpr(*others, f"{spans} as __view_spans", f"{mapped} as {spans}")
        .withColumn("unmapped", F.size("__view_spans") - F.size(spans))
        .drop("__view_spans")
    )


def verify_round_trip(df: DataFrame, spans: str = "spans", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows whose spans all map back, and the refused rest."""
    mapped = map_spans(df, spans, text)
    return (
        mapped.where("unmapped = 0").drop("unmapped"),
        mapped.where("unmapped > 0").withColumn("reason", F.lit("inspection_failed")),
    )


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string()
    )


def nfkc_where_needed(text: Column) -> Column:
    """Compatibility form; texts that are their own view are left alone."""
    return F.coalesce(_nfkc(F.when(~is_identity(text), text)), text)
