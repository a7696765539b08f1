"""Streaming jobs: pseudonymise an unbounded source, restore reply chunks, sweep."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskwright.functions import fixed
from maskwright.operators.vault import open_records
from maskwright.plans.jobs import pseudonymize, restore, restore_arguments
from maskwright.session import materialize
from maskwright.sources.vault_store import read_vault, sweep, upsert_vault
from maskwright.streaming.chunks import align_stream
from maskwright.streaming.mappings import answered

Clock = Callable[[], datetime]


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    """Writes one batch; a batch that is repeated replaces itself."""
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def _start(stream: DataFrame, handle, checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(**trigger).start()
    )


def spread(batch: DataFrame) -> DataFrame:
    """The rows of a batch dealt in turn to all cores: a few files, or row groups of them, would keep as few tasks busy."""
    return batch.repartition(max(2 * batch.sparkSession.sparkContext.defaultParallelism, batch.rdd.getNumPartitions()))


def pseudonymize_stream(
    msgs: DataFrame, rules: DataFrame, token_keys: DataFrame, vault_keys: DataFrame, out: str, checkpoint: str,
    clock: Clock = utc_now, trigger: dict | None = None, **options,
) -> StreamingQuery:
    """Request side over a stream of whole requests (all messages of a request in
    one micro-batch, as the request record gives them).

    Writes ``text``, ``prov``, ``vault`` and ``audit`` below ``out``, each by batch. A batch with a token that
    stands for another value in the vault stops the stream before anything is written.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        # what an earlier run of this batch put is its own, and equal
        result = pseudonymize(
            spread(batch), rules, token_keys, vault_keys, clock(), earlier=lambda prov: read_vault(batch.sparkSession, f"{out}/vault", prov), **options)
        for name in ("prov", "audit", "refused"):
            _write(result[name], f"{out}/{name}", batch_id)
        upsert_vault(result["vault"], f"{out}/vault", str(batch_id))
        _write(result["text"], f"{out}/text", batch_id)

    return _start(msgs, handle, checkpoint, trigger or {"availableNow": True})


def _table(source: DataFrame | str, spark: SparkSession) -> DataFrame:
    """A frame as it is, or what lies at a path now."""
    return source if isinstance(source, DataFrame) else spark.read.parquet(source)


def restore_stream(
    chunks: DataFrame, prov: DataFrame | str, vault: DataFrame | str, vault_keys: DataFrame, out: str, checkpoint: str,
    clock: Clock = utc_now, trigger: dict | None = None, cap: int = fixed.MAX_RESTORED_BYTES, **limits,
) -> StreamingQuery:
    """Reply side over a stream of chunks.

    State holds only what may become a token; the lookups in provenance and vault
    are joins of a micro-batch, so a busy reply does not carry its map in state.
    ``prov`` and ``vault`` are paths, read anew for every batch (the vault by the
    buckets that the batch needs), or frames that do not change. A mapping expires
    when its row says so, however often it is read. Arguments of tool calls are
    restored whole or the call is refused, and the output budget of a request runs
    over all its batches, in the order of the parts. What requests have spent is carried from batch to
    batch; by processing time a request is forgotten once its deadline is long past.
    """
    trigger = trigger or {"availableNow": True}
    limits.setdefault("deadlines", None if "availableNow" in trigger else "processing")
    forget_s = 2 * limits.get("total_s", fixed.TOTAL_SECONDS) if limits["deadlines"] == "processing" else None

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        columns = ["request_id", "block", "part", "kind", "text"]
        keys = ("request_id", "block", "part")
        told = rows.where("refusal is null").select(*columns)
        known, now = _table(prov, spark), clock()
        result = restore(told.where("kind <> 'tool'"), known, vault, vault_keys, now, 1 << 62, keys)
        tools = restore_arguments(told.where("kind = 'tool'"), known, vault, vault_keys, now, keys)
        done = result["text"].select(*columns, F.lit(None).cast("string").alias("refusal")).unionByName(tools["text"].select(*columns, "refusal"))
        before = read_spent(spark, f"{out}/spent", batch_id)
        done = materialize(within_budget(done, before, cap), "budget")
        write_spent(done, before, f"{out}/spent", batch_id, now, forget_s)
        refused = rows.where("refusal is not null").select(*columns, "refusal")
        _write(done.drop("bytes").unionByName(refused), f"{out}/text", batch_id)
        _write(result["outcomes"].unionByName(tools["outcomes"], allowMissingColumns=True), f"{out}/outcomes", batch_id)
        rows.unpersist()

    return _start(align_stream(chunks, **limits), handle, checkpoint, trigger)


SPENT = "request_id string, bytes bigint, seen timestamp, of_batch bigint, slot int"


def read_spent(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """``(request_id, bytes, seen)`` as the batch before ``batch_id`` left it; no rows at the first one."""
    try:
        rows = spark.read.schema(SPENT).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SPENT)  # the first batch
    return rows.where((F.col("slot") == (batch_id + 1) % 2) & (F.col("of_batch") == batch_id - 1)).select("request_id", "bytes", "seen")


def write_spent(done: DataFrame, before: DataFrame, path: str, batch_id: int, as_of, forget_s: int | None = None) -> None:
    """Carries the spent bytes on: those of the batch before and those of the rows ``done``.

    Two slots take turns, so a batch reads one table, however many batches there were, and a batch that is
    repeated finds what it read the first time. Batches are numbered without gaps, as Spark does; a batch that
    leaves nothing to carry is told by its number. Requests not seen for ``forget_s`` seconds are left out.
    """
    now = F.lit(as_of).cast("timestamp")
    own = done.groupBy("request_id").agg(F.sum("bytes").alias("bytes")).withColumn("seen", now)
    total = before.unionByName(own).groupBy("request_id").agg(F.sum("bytes").alias("bytes"), F.max("seen").alias("seen"))
    if forget_s is not None:
        total = total.where(F.col("seen") >= now - F.make_dt_interval(secs=F.lit(forget_s)))
    total.withColumns({"of_batch": F.lit(batch_id).cast("bigint"), "slot": F.lit(batch_id % 2)}).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(path)


def within_budget(rows: DataFrame, before: DataFrame, cap: int) -> DataFrame:
    """Rows as they are up to the byte budget of their request; the first row beyond it and all later ones are refusals.

    ``before`` has the bytes that requests have been given by the batches before.
    """
    given = before.select("request_id", F.col("bytes").alias("__given"))
    so_far = Window.partitionBy("request_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    judged = rows.join(given, "request_id", "left").withColumn(
        "__sum", F.coalesce("__given", F.lit(0)) + F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(so_far))
    over = F.col("__sum") > cap
    return judged.withColumns({
        # the bytes of a refused row count on, so that nothing later passes
        "refusal": F.when(over, "restoration_refused").otherwise(F.col("refusal")),
        "kind": F.when(over, "refused").otherwise(F.col("kind")),
        "text": F.when(~over, F.col("text")),
    }).withColumn("bytes", F.when(over, F.lit(cap) + 1).otherwise(F.octet_length("text"))).drop("__given", "__sum")


def lookup_stream(
    puts: DataFrame, asks: DataFrame, vault_keys: DataFrame, out: str, checkpoint: str, ttl_seconds: int,
    clock: Clock = utc_now, trigger: dict | None = None,
) -> StreamingQuery:
    """Lookups over a stream of vault rows, from state alone; ``value`` and ``status`` below ``out``, by batch.

    A mapping leaves the state ``ttl_seconds`` after it was put, however often it is read, and reads as absent from
    then on; until then its own expiry is judged by ``clock``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        _write(open_records(batch, vault_keys, clock()).drop("record", "stored_expiry"), out, batch_id)

    spark, trigger = puts.sparkSession, trigger or {"availableNow": True}
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    if "availableNow" in trigger:
        # a time to live asks for batches without data for ever; expired state isn't read without them either
        spark.conf.set(empty, "false")
    try:
        return _start(answered(puts, asks, ttl_seconds), handle, checkpoint, trigger)
    finally:
        spark.conf.set(empty, before)


def sweep_stream(ticks: DataFrame, vault_path: str, checkpoint: str, clock: Clock = utc_now, trigger: dict | None = None) -> StreamingQuery:
    """Sweeps the vault once per micro-batch of ``ticks``, such as a rate source."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        sweep(batch.sparkSession, vault_path, clock())

    return _start(ticks, handle, checkpoint, trigger or {"processingTime": "5 minutes"})
