"""Restoration: values back into replies, only where the request minted the token."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import fixed
from maskwright.functions.arrays import spans_of
from maskwright.functions.text import canonicalize
from maskwright.operators.tokens import spliced
from maskwright.operators.vault import AAD_DOMAIN, vault_get
from maskwright.operators.view import nfkc_where_needed

REPLY_KEYS = ("request_id", "field")


class OutputTooLarge(ValueError):
    """Restored replies exceed their budget."""


def scan_tokens(replies: DataFrame, keys: Sequence[str] = REPLY_KEYS) -> DataFrame:
    """Every well-formed token of a reply with its offsets; the text stays behind."""
    with_token = replies.where(F.contains(F.col("text"), F.lit(f":{fixed.TOKEN_VERSION}:")))
    return with_token.select(*keys, F.inline(F.expr(spans_of("text", fixed.TOKEN)))).withColumnRenamed(
        "text", "token")


def minted_here(tokens: DataFrame, prov: DataFrame) -> DataFrame:
    """Adds ``minted``, the scope, ``canonical`` and ``original`` from the provenance of
    the same request."""
    own = prov.select("request_id", "token", "tenant_id", "conversation_id", "token_version", "canonical",
                      "original", F.lit(True).alias("minted"))
    return tokens.join(own, ["request_id", "token"], "left").fillna(False, "minted")


def classify_tokens(
    tokens: DataFrame, prov: DataFrame, vault: DataFrame, keys: DataFrame, as_of, domain: str = AAD_DOMAIN
) -> DataFrame:
    """Adds ``outcome``: restored, not_minted, vault_miss, cross_tenant or key_unavailable.

    Each distinct token of a request is looked up once, however often a reply
    repeats it; the lookups shuffle tokens, never texts.
    """
    own = minted_here(tokens.select("request_id", "token").distinct(), prov).where("minted")
    looked = vault_get(own, vault, keys, as_of, domain)
    outcome = (
        F.when(F.col("status") == "cross_tenant", "cross_tenant")
        .when(F.col("status") == "key_unavailable", "key_unavailable")
        .when((F.col("status") == "found") & (canonicalize(F.col("value")) == F.col("canonical")), "restored")
        .otherwise("vault_miss")
    )
    known = looked.select("request_id", "token", outcome.alias("outcome"), "original")
    return tokens.join(known, ["request_id", "token"], "left").withColumn(
        "outcome", F.coalesce("outcome", F.lit("not_minted")))


def restore_text(replies: DataFrame, outcomes: DataFrame, keys: Sequence[str] = REPLY_KEYS) -> DataFrame:
    """Replies with restored tokens replaced by the spelling their request minted.

    Refused tokens stay as they are. The tokens of one reply are grouped, which
    its text bounds; replies without tokens only pass through the outer join.
    """
    keys = list(keys)
    pieces = outcomes.where("outcome = 'restored'").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "original"))).alias("__pieces"))
    joined = replies.join(pieces, keys, "left")
    text = f"case when __pieces is null then text else {spliced('text', '__pieces', 'p.original')} end"
    return joined.withColumn("text", F.expr(text)).drop("__pieces")


def output_budget(
    restored: DataFrame, cap: int = fixed.MAX_RESTORED_BYTES, key: str = "request_id"
) -> tuple[DataFrame, DataFrame]:
    """Replies within the byte budget of their request, and the refused requests."""
    sizes = restored.groupBy(key).agg(F.sum(F.octet_length("text")).alias("bytes"))
    over = sizes.where(F.col("bytes") > cap).withColumn("reason", F.lit("restoration_refused"))
    return restored.join(over.select(key), key, "left_anti"), over


def restore_counts(outcomes: DataFrame, key: str = "request_id") -> DataFrame:
    """Per request: restored, refused, and the refusals by reason as a map."""
    per_reason = outcomes.groupBy(key, "outcome").agg(F.count(F.lit(1)).alias("n"))
    reasons = F.map_from_entries(F.sort_array(F.collect_list(
        F.when(F.col("outcome") != "restored", F.struct("outcome", "n")))))
    return per_reason.groupBy(key).agg(
        F.sum(F.when(F.col("outcome") == "restored", F.col("n")).otherwise(0)).alias("tokens_restored"),
        F.sum(F.when(F.col("outcome") != "restored", F.col("n")).otherwise(0)).alias("tokens_refused"),
        reasons.alias("tokens_refused_by_reason"),
    )


def restorable_fields(leaves: DataFrame, allow: Sequence[str]) -> DataFrame:
    """Adds ``restorable``: only listed reply fields may be written."""
    return leaves.withColumn("restorable", F.col("field").isin(*allow))


def has_lookalike(text: Column) -> Column:
    """A malformed or disguised placeholder once well-formed tokens are removed.

    Judged on the compatibility form, so full-width disguises are seen too.
    """
    rest = F.regexp_replace(text, fixed.TOKEN, "")
    return nfkc_where_needed(rest).rlike(fixed.PLACEHOLDER_LOOKALIKE)


def placeholder_lookalikes(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows holding a placeholder that is not a well-formed token."""
    return df.where(has_lookalike(F.col(text)))


def restore_atomic(leaves: DataFrame, outcomes: DataFrame, key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """Leaves of records in which every token restores, and the refused records.

    ``leaves``: ``(record_id, leaf, request_id, text, structural)``. A token in a
    structural leaf, a refused token, a look-alike, or a token that is still there
    after restoring refuses the whole record.
    """
    token_keys = [key, "leaf"]
    restored = restore_text(leaves, outcomes, token_keys)
    left = F.col("text").rlike(fixed.TOKEN) | has_lookalike(F.col("text"))
    bad_leaf = leaves.where(has_lookalike(F.col("text")) | F.col("reason").isNotNull()).select(key)
    bad_token = outcomes.where("outcome <> 'restored'").select(key)
    in_structure = leaves.where("structural").join(outcomes.select(*token_keys).distinct(), token_keys, "left_semi").select(key)
    remaining = restored.where(left).select(key)
    refused = (
        bad_leaf.unionByName(bad_token).unionByName(in_structure).unionByName(remaining)
        .distinct().withColumn("reason", F.lit("tool_restoration_refused"))
    )
    return restored.join(refused.select(key), key, "left_anti"), refused
