"""The vault as one Parquet table, partitioned by batch and bucket.

A batch is written over its own partitions, so a batch that is repeated replaces itself. Sweeps and
erasures write the partitions in which rows go over again, by Spark's dynamic partition overwrite, and leave
all others alone; batches that arrive meanwhile are other partitions. A partition that loses all its rows is
left with one row without a token, which readers pass over. Erased values are gone from the files once
the write is committed. Rewrites of one vault must not run side by side, and a rewrite that
failed is run again: it finds the rows that are still there. A reader that had planned on replaced files fails and has to read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators.vault import SCOPE, erase_conversations, erase_tokens, latest, purge_expired, wanted_rows
from maskwright.session import materialize

#: Buckets of a new vault: the unit that lookups prune by. Choose it by the volume.
BUCKETS = 256
ROWS_SCHEMA = (
    "tenant_id string, conversation_id string, token string, token_version string, key_version int, "
    "record binary, expires_at timestamp"
)
PARTS = ("batch_id", "buckets", "bucket")
VAULT_SCHEMA = ROWS_SCHEMA + ", batch_id string, buckets int, bucket int"


def _bucket(buckets):
    return F.pmod(F.xxhash64(*SCOPE), buckets).cast("int")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """All partitions, with the rows that only keep a partition."""
    try:
        return spark.read.schema(VAULT_SCHEMA).parquet(f"{path.rstrip('/')}/data")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VAULT_SCHEMA)  # nothing was put yet


def _write(rows: DataFrame, path: str) -> None:
    # rebalanced by Spark: large buckets are split over tasks, small ones put together
    rows.select(*[f.split()[0] for f in VAULT_SCHEMA.split(", ")]).hint("rebalance", "bucket").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy(
        *PARTS).parquet(f"{path.rstrip('/')}/data")


def _buckets_of(rows: DataFrame) -> int | None:
    found = rows.select("buckets").first()
    return found[0] if found else None


def upsert_vault(vault: DataFrame, path: str, batch_id: str, buckets: int = BUCKETS) -> None:
    """Adds rows as one batch, or replaces the batch by itself.

    Rows are clustered by bucket, a hash of the conversation and the token, so that one busy
    conversation is not one file. The number of buckets is that of the first batch.
    """
    known = _buckets_of(_rows(vault.sparkSession, path)) or buckets
    _write(vault.withColumns({"batch_id": F.lit(str(batch_id)), "buckets": F.lit(known), "bucket": _bucket(F.lit(known))}), path)


def read_vault(spark: SparkSession, path: str, tokens: DataFrame | None = None) -> DataFrame:
    """The latest row of every token; with ``tokens`` (their scope), only of rows that these may ask for.

    Buckets that hold none of them aren't read, and what is read of the others passes a filter of the wanted
    scopes before it is exchanged. ``tokens`` is read twice here, so it should be a written table.
    """
    rows = _rows(spark, path)
    buckets = _buckets_of(rows) if tokens is not None else None
    if buckets:
        # as many numbers as there are buckets, at most
        wanted = [r[0] for r in tokens.select(_bucket(F.lit(buckets))).distinct().collect()]
        rows = wanted_rows(rows.where(F.col("bucket").isin(wanted)), tokens) if wanted else rows.limit(0)
    return latest(rows.where("token is not null").drop(*PARTS))


def rewrite_vault(spark: SparkSession, path: str, keep: Callable[[DataFrame], DataFrame]) -> int:
    """Drops the rows that ``keep(rows)`` leaves out; returns how many tokens went away.

    ``keep`` only leaves rows out. What is kept is written to the scratch folder first, so nothing changes
    where that fails, and what arrives meanwhile stays.
    """
    rows = _rows(spark, path).where("token is not null")
    before = materialize(rows.groupBy(*PARTS).agg(F.count(F.lit(1)).alias("n")), "vault-before")
    tokens_before = latest(rows.drop(*PARTS)).count()
    kept = materialize(keep(rows).select(*rows.columns), "vault-kept")
    after = kept.groupBy(*PARTS).agg(F.count(F.lit(1)).alias("m"))
    changed = materialize(before.join(after, list(PARTS), "left").where("n <> coalesce(m, 0)").select(*PARTS), "vault-changed")
    if not changed.head(1):
        return 0
    names = [f.split()[0] for f in ROWS_SCHEMA.split(", ")]
    holders = changed.select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names], *PARTS)
    _write(kept.join(changed, list(PARTS), "left_semi").unionByName(holders), path)
    return tokens_before - latest(kept.drop(*PARTS)).count()


def sweep(spark: SparkSession, path: str, as_of) -> int:
    """Periodic job: drops expired rows, returns the number of tokens that went away."""
    return rewrite_vault(spark, path, lambda v: purge_expired(v, as_of))


def erase(spark: SparkSession, path: str, conversations: DataFrame | None = None, tokens: DataFrame | None = None) -> int:
    """Erases conversations or single tokens, returns the number of tokens removed."""

    def keep(vault: DataFrame) -> DataFrame:
        if conversations is not None:
            vault = erase_conversations(vault, conversations)
        return erase_tokens(vault, tokens) if tokens is not None else vault

    return rewrite_vault(spark, path, keep)
