"""Text columns: folding, canonical form, length prefixes, keyed tags."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import fixed


def is_identity(text: Column) -> Column:
    """True when the detection view of ``text`` is ``text`` itself."""
    return ~text.rlike(fixed.NOT_IDENTITY)


def fold_confusables(text: Column) -> Column:
    """Look-alike characters as the ASCII character they imitate; length is kept."""
    return F.when(
        text.rlike(fixed.CONFUSABLE_CLASS),
        F.translate(text, fixed.CONFUSABLE_FROM, fixed.CONFUSABLE_TO),
    ).otherwise(text)


def _canonical(value: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", value).split()).casefold()


@F.arrow_udf(T.ArrayType(T.StringType()))
def _canonical_lists(values: pa.Array) -> pa.Array:
    return pa.array(
        [None if row is None else [_canonical(v) for v in row] for row in values.to_pylist()],
        pa.list_(pa.string()),
    )


def _canonical_plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, f"{fixed.SPACE}+", " ")))


def canonicalize_array(values: Column) -> Column:
    """Canonical form of every string of an array.

    Only arrays holding a character that needs compatibility normalisation or
    full case folding are sent to Python; for the others the value sent is NULL.
    """
    hard = F.exists(values, lambda v: v.rlike(fixed.NOT_PLAIN_CASE))
    return F.coalesce(
        _canonical_lists(F.when(hard, values)), F.transform(values, _canonical_plain)
    )


def canonicalize(text: Column) -> Column:
    """Compatibility form, single spaces, case folded."""
    return F.when(text.isNotNull(), F.get(canonicalize_array(F.array(text)), 0))


def length_prefix(*parts: Column) -> Column:
    """Each part as ``<bytes>:<utf8>``, joined by NUL, as binary."""
    coded = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.encode(F.concat_ws("\u0000", *coded), "UTF-8")


def hmac_sha256(message: Column, inner_pad: Column, outer_pad: Column) -> Column:
    """HMAC-SHA256 as hex, from the two key pads of the key table."""
    inner = F.unhex(F.sha2(F.concat(inner_pad, message), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)
