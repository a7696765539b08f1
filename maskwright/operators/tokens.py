"""Tokenisation: keyed, conversation-scoped tokens in place of values."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import fixed
from maskwright.functions.text import canonicalize, canonicalize_array, hmac_sha256, length_prefix

# First part of every keyed message. Change it, and every token changes: pass the
# value of an existing deployment to keep its tokens.
TAG_DOMAIN = "maskwright/token"
SESSION_GRAMMAR = "^[A-Za-z0-9_-]{1,128}$"


def derive_key(root: bytes, info: bytes, length: int = 32) -> bytes:
    """HKDF-SHA256 (RFC 5869) without salt: unrelated keys for unrelated purposes."""
    if not isinstance(root, bytes) or len(root) < 32:
        raise ValueError("a root secret has at least 32 bytes")
    seed = hmac.new(bytes(32), root, hashlib.sha256).digest()
    out, block, counter = b"", b"", 1
    while len(out) < length:
        block = hmac.new(seed, block + info + bytes([counter]), hashlib.sha256).digest()
        out, counter = out + block, counter + 1
    return out[:length]


def token_key_table(spark: SparkSession, key: bytes) -> DataFrame:
    """One row with the two HMAC pads of the token key.

    The key is data of a table, never a literal of a query: literals show up in
    plans and event logs.
    """
    if not isinstance(key, bytes) or len(key) < 32:
        raise ValueError("a token key has at least 32 bytes")
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pads = (bytearray(b ^ 0x36 for b in block), bytearray(b ^ 0x5C for b in block))
    return spark.createDataFrame([pads], "inner_pad binary, outer_pad binary")


def with_token_key(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds ``token_key``, read once as a scalar subquery of the one-row key table."""
    return df.withColumn("token_key", keys.select(F.struct("inner_pad", "outer_pad")).scalar())


def _tag(tenant: Column, conversation: Column, entity_type: Column, canonical: Column, key: Column, domain: str) -> Column:
    message = length_prefix(
        F.lit(domain), F.lit(fixed.TOKEN_VERSION), tenant, conversation, entity_type, canonical)
    return F.substring(hmac_sha256(message, key["inner_pad"], key["outer_pad"]), 1, 32)


def token_tag(spans: DataFrame, keys: DataFrame, domain: str = TAG_DOMAIN) -> DataFrame:
    """Adds ``canonical`` and ``tag`` to a span table with tenant and conversation."""
    with_canonical = with_token_key(spans.withColumn("canonical", canonicalize(F.col("text"))), keys)
    return with_canonical.withColumn(
        "tag",
        _tag(F.col("tenant_id"), F.col("conversation_id"), F.upper("entity_type"),
             F.col("canonical"), F.col("token_key"), domain),
    ).drop("token_key")


def with_tokens(inspected: DataFrame, keys: DataFrame, domain: str = TAG_DOMAIN) -> DataFrame:
    """Adds ``minted`` to messages: ``array<struct<start,end,entity_type,text,canonical,token>>``.

    Tokens are computed beside the text, so nothing is exploded and joined back.
    """
    texts = F.transform("spans", lambda s: s["text"])
    keyed = with_token_key(
        inspected.withColumn("__canonical", canonicalize_array(F.when(F.size("spans") > 0, texts))), keys)
    upper = F.transform(
        F.arrays_zip(F.col("spans").alias("s"), F.col("__canonical").alias("c")),
        lambda z: F.struct(
            z["s"]["start"].alias("start"), z["s"]["end"].alias("end"),
            F.upper(z["s"]["entity_type"]).alias("entity_type"), z["s"]["text"].alias("text"),
            z["c"].alias("canonical")),
    )
    minted = F.transform(
        upper,
        lambda s: s.withField("token", F.concat(
            F.lit("<"), s["entity_type"], F.lit(f":{fixed.TOKEN_VERSION}:"),
            _tag(F.col("tenant_id"), F.col("conversation_id"), s["entity_type"], s["canonical"],
                 F.col("token_key"), domain),
            F.lit(">"))),
    )
    return keyed.withColumn("minted", F.when(F.size("spans") > 0, minted)).drop("__canonical", "token_key")


def mint_tokens(tokenized: DataFrame) -> DataFrame:
    """Provenance: one row per request and token.

    The spelling kept is the one of the first message, and in it the rightmost.
    """
    scope = ("request_id", "tenant_id", "conversation_id")
    rows = tokenized.where("minted is not null").select(*scope, "idx", F.inline("minted"))
    return (
        rows.groupBy(*scope, "token", "entity_type", "canonical")
        .agg(F.max_by("text", F.struct(-F.col("idx"), F.col("start"))).alias("original"))
        .withColumn("token_version", F.lit(fixed.TOKEN_VERSION))
    )


def token_collisions(prov: DataFrame) -> DataFrame:
    """Tokens standing for more than one value in a conversation; must be empty."""
    return (
        prov.groupBy("tenant_id", "conversation_id", "token")
        .agg(F.min("canonical").alias("a"), F.max("canonical").alias("b"))
        .where("a <> b").drop("a", "b")
    )


def spliced(text: str, pieces: str, value: str) -> str:
    """SQL text: ``text`` with ``value`` of each piece ``p`` in place of its range.

    ``pieces`` are ordered and do not overlap.
    """
    return (
        f"concat(array_join(transform({pieces}, (p, i) -> concat(substr({text}, "
        f"coalesce(get({pieces}, i - 1).end, 0) + 1, p.start - coalesce(get({pieces}, i - 1).end, 0)), {value})), ''), "
        f"substr({text}, get({pieces}, size({pieces}) - 1).end + 1))"
    )


def replace_spans(tokenized: DataFrame) -> DataFrame:
    """Text with tokens in place of the spans; the rest stays byte for byte."""
    return tokenized.withColumn(
        "text", F.expr(f"case when size(minted) > 0 then {spliced('text', 'minted', 'p.token')} else text end"))


def verify_tokens(df: DataFrame, keys: DataFrame, domain: str = TAG_DOMAIN) -> DataFrame:
    """Adds ``ok``: whether ``token`` is the token of ``canonical`` in its scope."""
    parts = {n: F.regexp_extract("token", fixed.TOKEN_PARTS, i) for i, n in ((1, "type"), (3, "tag"))}
    expected = _tag(F.col("tenant_id"), F.col("conversation_id"), parts["type"], F.col("canonical"),
                    F.col("token_key"), domain)
    return with_token_key(df, keys).withColumn(
        "ok", (parts["tag"] != "") & (parts["tag"] == expected)).drop("token_key")


def spelling_conflicts(spans: DataFrame) -> DataFrame:
    """Values written in more than one way within a request."""
    return (
        spans.withColumn("canonical", canonicalize(F.col("text")))
        .groupBy("request_id", F.upper("entity_type").alias("entity_type"), "canonical")
        .agg(F.min("text").alias("a"), F.max("text").alias("b"), F.count(F.lit(1)).alias("n"))
        .where("a <> b").drop("a", "b")
    )


def session_scope(df: DataFrame) -> DataFrame:
    """Adds ``session_scope`` and ``scope_error``.

    Reads ``tenant_id, api_key_id, session_ids ARRAY<STRING>, agent_id``. The ids
    presented have to agree and to follow the grammar; with none, the row has to
    be given one first, because a random id would not be repeatable.
    """
    given = F.filter("session_ids", lambda s: s.isNotNull())
    bad = F.exists(given, lambda s: ~s.rlike(SESSION_GRAMMAR)) | (
        F.col("agent_id").isNotNull() & ~F.coalesce(F.col("agent_id").rlike(SESSION_GRAMMAR), F.lit(False)))
    error = (
        F.when(bad, "invalid_identifier")
        .when(F.size(F.array_distinct(given)) > 1, "conflicting_session")
        .when(F.size(given) == 0, "missing_session")
    )
    base = length_prefix(F.lit("agent-session-v1"), F.col("tenant_id"), F.col("api_key_id"), F.get(given, F.lit(0)))
    nested = length_prefix(F.lit("agent-subagent-v1"), F.lower(F.hex(base)), F.col("agent_id"))
    digest = F.when(F.col("agent_id").isNull(), F.sha2(base, 256)).otherwise(F.sha2(nested, 256))
    return df.withColumn("scope_error", error).withColumn(
        "session_scope", F.when(F.col("scope_error").isNull(), F.concat(F.lit("agent_"), digest)))


def scoped_cache_key(df: DataFrame) -> DataFrame:
    """Adds ``cache_key``, stable per scope and free of client identifiers."""
    parts = ("tenant_id", "api_key_id", "conversation_id", "protocol", "model", "destination",
             "policy_version", "identity")
    return df.withColumn("cache_key", F.concat(
        F.lit("cache_"), F.sha2(length_prefix(F.lit("agent-cache-v1"), *[F.col(p) for p in parts]), 256)))
