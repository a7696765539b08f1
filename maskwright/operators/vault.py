"""Vault rows: encrypted, expiring values of tokens, as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import fixed
from maskwright.functions.text import canonicalize, length_prefix

AAD_DOMAIN = "maskwright/vault"
SCOPE = ("tenant_id", "conversation_id", "token")
#: Bits of the filter by which a lookup reads the vault; its table has at most a 64th of that many rows.
FILTER_BITS = 1 << 24


def vault_key_table(spark: SparkSession, keys: dict[int, bytes]) -> DataFrame:
    """``(key_version, key)``; keys are 32 bytes."""
    for version, key in keys.items():
        if not 0 <= version <= 0xFFFF or len(key) != 32:
            raise ValueError("a vault key is 32 bytes under a version from 0 to 65535")
    if not keys:
        raise ValueError("a key ring has at least one key")
    return spark.createDataFrame(
        [(v, bytearray(k)) for v, k in sorted(keys.items())], "key_version int, key binary")


def _header(fmt: Column, key_version: Column) -> Column:
    """Format byte and two-byte big-endian key version."""
    return F.unhex(F.concat(F.lpad(F.hex(fmt), 2, "0"), F.lpad(F.hex(key_version), 4, "0")))


def _aad(fmt: Column, key_version: Column, domain: str) -> Column:
    """What a record is bound to: a record moved elsewhere cannot be decrypted."""
    scope = length_prefix(
        F.lit(domain), F.col("tenant_id"), F.col("conversation_id"), F.col("token"), F.col("token_version"))
    return F.concat(scope, _header(fmt, key_version))


def vault_put(
    prov: DataFrame, keys: DataFrame, as_of, ttl_seconds: int, active_version: int, domain: str = AAD_DOMAIN
) -> DataFrame:
    """Vault rows of minted tokens: header, nonce, ciphertext and tag in ``record``.

    The nonce is random for every row, so the result is to be written once and
    read from there. Of several requests with the same token the one with the
    greatest id is kept; expiry is counted from ``as_of``.
    """
    expires = F.lit(as_of).cast("timestamp") + F.make_dt_interval(secs=F.lit(ttl_seconds))
    version = F.lit(active_version)
    rows = prov.groupBy(*SCOPE, "token_version").agg(F.max_by("original", "request_id").alias("value"))
    rows = rows.withColumns({"key_version": version, "expires_at": expires})
    payload = F.to_json(F.struct(
        *SCOPE, "token_version", "value", F.unix_micros("expires_at").alias("expires_at")))
    keyed = rows.withColumn("__key", keys.where(F.col("key_version") == version).select("key").scalar())
    fmt = F.lit(fixed.RECORD_FORMAT)
    sealed = F.aes_encrypt(
        F.encode(payload, "UTF-8"), F.col("__key"), F.lit("GCM"), F.lit("DEFAULT"),
        F.lit("").cast("binary"), _aad(fmt, F.col("key_version"), domain))
    return keyed.withColumn("record", F.concat(_header(fmt, F.col("key_version")), sealed)).select(
        *SCOPE, "token_version", "key_version", "record", "expires_at")


def _number(record: Column, position: int, length: int) -> Column:
    return F.conv(F.hex(F.substring(record, position, length)), 16, 10).cast("int")


def key_ring_join(vault: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds ``key`` of the version named in the record header, NULL if the ring
    lacks it. The ring is a handful of rows."""
    headed = vault.withColumns({
        "record_format": _number(F.col("record"), 1, 1),
        "record_key_version": _number(F.col("record"), 2, 2),
    })
    ring = F.broadcast(keys.select(F.col("key_version").alias("record_key_version"), "key"))
    return headed.join(ring, "record_key_version", "left")


def wanted_rows(vault: DataFrame, tokens: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``vault`` that ``tokens`` may ask for, by scope; none of theirs is left out.

    A bitmap of the hashes of the wanted scopes, 64 of its bits a row, so at most ``bits`` / 64 rows however
    many tokens there are. That bound allows it to be broadcast, and the vault is filtered where it is read, before
    any exchange. Rows whose hash meets another's pass as well, and the lookup's join drops them.
    """
    if bits % 64 or bits <= 0:
        raise ValueError("the filter has whole words of 64 bits")
    at = f"pmod(xxhash64({', '.join(SCOPE)}), {bits}L)"
    word, bit = F.expr(f"{at} div 64").alias("__word"), F.expr(f"shiftleft(1L, cast({at} % 64 as int))")
    bitmap = tokens.select(word, bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    marked = vault.select("*", word).join(F.broadcast(bitmap), "__word")
    return marked.where(F.col("__bits").bitwiseAND(bit) != 0).select(*vault.columns)


def vault_get(
    tokens: DataFrame, vault: DataFrame, keys: DataFrame, as_of, domain: str = AAD_DOMAIN
) -> DataFrame:
    """Adds ``value`` and ``status`` to token rows with their scope.

    ``status``: found, absent, expired, unknown_format, key_unavailable,
    unauthentic or cross_tenant. Joined on the whole scope with the token, so a
    busy tenant or conversation does not end up in one task.
    """
    stored = vault.select(*SCOPE, "record", F.col("expires_at").alias("stored_expiry"))
    return open_records(tokens.join(stored, list(SCOPE), "left"), keys, as_of, domain)


def open_records(found: DataFrame, keys: DataFrame, as_of, domain: str = AAD_DOMAIN) -> DataFrame:
    """``value`` and ``status`` of token rows that have ``record`` and ``stored_expiry`` beside them, NULL where
    there is no row in the vault. Statuses as ``vault_get`` gives them; no shuffle."""
    now = F.lit(as_of).cast("timestamp")
    joined = key_ring_join(found, keys)
    short = F.octet_length("record") < fixed.RECORD_HEADER_BYTES + fixed.RECORD_NONCE_BYTES
    usable = (
        F.col("key").isNotNull() & ~short & (F.col("record_format") == fixed.RECORD_FORMAT)
    )
    body = F.substring(F.col("record"), fixed.RECORD_HEADER_BYTES + 1, 1 << 30)
    opened = F.when(usable, F.try_aes_decrypt(
        body, F.col("key"), F.lit("GCM"), F.lit("DEFAULT"),
        _aad(F.col("record_format"), F.col("record_key_version"), domain)))
    entry = F.from_json(
        F.decode(opened, "UTF-8"), "tenant_id string, conversation_id string, value string, expires_at bigint")
    status = (
        F.when(F.col("record").isNull() | short, "absent")
        .when(F.col("stored_expiry") <= now, "expired")
        .when(F.col("record_format") != fixed.RECORD_FORMAT, "unknown_format")
        .when(F.col("key").isNull(), "key_unavailable")
        .when(F.col("__e").isNull(), "unauthentic")
        .when((F.col("__e.tenant_id") != F.col("tenant_id"))
              | (F.col("__e.conversation_id") != F.col("conversation_id")), "cross_tenant")
        .when(F.col("__e.expires_at") <= F.unix_micros(now), "expired")
        .otherwise("found")
    )
    return (
        joined.withColumn("__e", entry).withColumn("status", status)
        .withColumn("value", F.when(F.col("status") == "found", F.col("__e.value")))
        .drop("__e", "record", "record_format", "record_key_version", "key", "stored_expiry")
    )


def vault_collisions(prov: DataFrame, vault: DataFrame, keys: DataFrame, as_of, domain: str = AAD_DOMAIN) -> DataFrame:
    """Tokens of new provenance that stand for another value in the vault; must be empty.

    Only records of the batch's own tokens are opened; the vault has nothing that tells
    values apart but the records. Records that can't be opened or have expired clash with nothing.
    """
    own = prov.select(*SCOPE, "token_version", "canonical").distinct()
    looked = vault_get(own, vault, keys, as_of, domain)
    return looked.where((F.col("status") == "found") & (canonicalize(F.col("value")) != F.col("canonical"))).select(*SCOPE).distinct()


def purge_expired(vault: DataFrame, as_of) -> DataFrame:
    """Rows still alive at ``as_of``."""
    return vault.where(F.col("expires_at") > F.lit(as_of).cast("timestamp"))


def expired_count(vault: DataFrame, as_of) -> DataFrame:
    """``n``: rows a purge at ``as_of`` removes."""
    return vault.agg(F.count_if(F.col("expires_at") <= F.lit(as_of).cast("timestamp")).alias("n"))


def erase_conversations(vault: DataFrame, erase: DataFrame) -> DataFrame:
    """The vault without the conversations listed by ``(tenant_id, conversation_id)``."""
    return vault.join(erase.select("tenant_id", "conversation_id"), ["tenant_id", "conversation_id"], "left_anti")


def erased_counts(vault: DataFrame, erase: DataFrame) -> DataFrame:
    """Rows removed per listed conversation; 0 where there were none."""
    counts = vault.groupBy("tenant_id", "conversation_id").agg(F.count(F.lit(1)).alias("n"))
    listed = erase.select("tenant_id", "conversation_id").distinct()
    return listed.join(counts, ["tenant_id", "conversation_id"], "left").fillna(0, "n")


def erase_tokens(vault: DataFrame, erase: DataFrame) -> DataFrame:
    """The vault without the listed ``(tenant_id, conversation_id, token)``."""
    return vault.join(erase.select(*SCOPE), list(SCOPE), "left_anti")


def unknown_format_count(vault: DataFrame) -> DataFrame:
    """``(record_format, n)`` of records another version has written."""
    return (
        vault.select(_number(F.col("record"), 1, 1).alias("record_format"))
        .where(F.col("record_format") != fixed.RECORD_FORMAT)
        .groupBy("record_format").agg(F.count(F.lit(1)).alias("n"))
    )


def latest(vault: DataFrame) -> DataFrame:
    """One row per scope: the one put last, that is with the latest expiry.

    A struct maximum combines before the shuffle, unlike a row number.
    """
    others = [c for c in vault.columns if c not in SCOPE]
    newest = vault.groupBy(*SCOPE).agg(F.max_by(F.struct(*others), F.struct("expires_at", "record")).alias("__r"))
    return newest.select(*SCOPE, *[F.col(f"__r.{c}").alias(c) for c in others])
