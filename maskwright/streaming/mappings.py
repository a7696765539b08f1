"""Mappings of tokens in keyed state with a time to live, for lookups that meet what the stream itself has put."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_SCOPE = ("tenant_id", "conversation_id", "token")
#: Keys of the state. A key has the mappings of all scopes of its hash, so that what a key costs is shared by many of them;
#: changing it needs a new checkpoint.
BUCKETS = 1 << 14
_TOKEN = T.StructType([T.StructField(name, T.StringType()) for name in _SCOPE])
_MAPPING = T.StructType([T.StructField("expires", T.LongType()), T.StructField("record", T.BinaryType())])
ANSWERED = T.StructType([
    *[T.StructField(name, T.StringType()) for name in (*_SCOPE, "ask_id", "token_version")],
    T.StructField("record", T.BinaryType()), T.StructField("expires", T.LongType())])
_OUT = Row(*ANSWERED.names)


class Mappings(StatefulProcessor):
    """Keeps the vault row of a token for a fixed time from when it was put, and answers lookups with it.

    Of several rows that with the latest expiry is kept; one that is no later changes nothing, so a batch that is
    repeated doesn't renew, and lookups only read. What is put in a batch is there for the lookups of that batch. State holds
    the encrypted record, never the value. Every call of the state is a round trip, so a key is a bucket of scopes: whether it
    has anything is asked once, and only then its mappings are asked for singly. Of a bucket the latest row of each scope and the
    ids of one batch's lookups are held.
    """

    def __init__(self, ttl_seconds: int):
        self.ttl_ms = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mappings = handle.getMapState("mappings", _TOKEN, _MAPPING, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        asked: dict[tuple, list[tuple]] = {}
        newest: dict[tuple, tuple | None] = {}
        for r in rows:
            scope = (r.tenant_id, r.conversation_id, r.token)
            before = newest.setdefault(scope, None)
            if r.record is None:
                asked.setdefault(scope, []).append((r.ask_id, r.token_version))
            else:
                put = (r.expires, bytes(r.record))
                newest[scope] = put if before is None or put > before else before
        known = self.mappings.exists()
        for scope, put in newest.items():
            kept = self.mappings.getValue(scope) if known else None
            if kept is not None:
                kept = (kept[0], bytes(kept[1]))
            if put is not None and (kept is None or put > kept):
                self.mappings.updateValue(scope, put)
                kept = put
            for ask_id, version in asked.get(scope, ()):
                yield _OUT(*scope, ask_id, version, kept[1] if kept else None, kept[0] if kept else None)

    def close(self) -> None:
        pass


def answered(puts: DataFrame, asks: DataFrame, ttl_seconds: int) -> DataFrame:
    """Lookups ``asks`` (a scope, ``token_version`` and ``ask_id``) with ``record`` and ``stored_expiry`` of what
    the stream ``puts`` of vault rows has put for them and the time to live hasn't taken away; NULL if nothing.

    Rows with a NULL in their expiry or record put nothing.
    """
    # the driver's Python for states doesn't see packages that were sent to the workers, so the class goes by value
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    given = puts.where("record is not null and expires_at is not null").select(
        *_SCOPE, F.lit(None).cast("string").alias("ask_id"), "token_version", "record", F.unix_micros("expires_at").alias("expires"))
    wanted = asks.select(
        *_SCOPE, "ask_id", "token_version", F.lit(None).cast("binary").alias("record"), F.lit(None).cast("bigint").alias("expires"))
    bucket = F.expr(f"pmod(xxhash64({', '.join(_SCOPE)}), {BUCKETS}L)")
    found = given.unionByName(wanted).withColumn("bucket", bucket).groupBy("bucket").transformWithState(Mappings(ttl_seconds), ANSWERED, "append", "ProcessingTime")
    return found.withColumn("stored_expiry", F.timestamp_micros("expires")).drop("expires")
