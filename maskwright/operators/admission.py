"""Admission analysis over a request log."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import fixed
from maskwright.session import materialize

SLICE_SECONDS = 3600


def authenticate_log(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds the key's id, tenant and application, or ``reason`` for unknown keys.

    ``keys``: ``(key_hash, api_key_id, tenant_id, application)``. The planner
    broadcasts the key table when its size allows.
    """
    known = keys.select("key_hash", "api_key_id", "tenant_id", "application")
    joined = log.withColumn("key_hash", F.sha2(F.col("presented"), 256)).join(known, "key_hash", "left")
    return joined.drop("presented", "key_hash").withColumn(
        "reason", F.when(F.col("api_key_id").isNull(), F.lit("invalid_api_key")))


def retry_after(wait: Column) -> Column:
    """Whole seconds, rounded up, at least 1."""
    return F.when(wait.isNotNull(), F.greatest(F.lit(1), F.ceil(wait))).cast("int")


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def token_bucket(
    log: DataFrame, per_minute: int = fixed.REQUESTS_PER_MINUTE, key: str = "key_id",
    order: str = "event_id", slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Adds ``admitted`` and ``wait_s`` for a bucket per key, refilled continuously.

    First every request is taken as charged. The charge then outstanding is a
    running total over its running minimum, which window functions give over time
    slices of a key, so that a busy key is spread over tasks. Where it never goes
    beyond the capacity since the bucket was last full, all requests are admitted.
    Only the stretches that exceed the capacity are stepped through one by one,
    each as an ordered stream of batches.
    """
    if per_minute <= 0:
        return log.withColumns({"admitted": F.lit(True), "wait_s": F.lit(None).cast("double")})
    rate, capacity = per_minute / 60.0, float(per_minute)
    timed = log.withColumn("__t", _seconds(F.col("ts")))
    sliced = timed.withColumn("__slice", F.floor(F.col("__t") / slice_seconds))
    in_slice = Window.partitionBy(key, "__slice").orderBy("__t", order)
    so_far = in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # walk before request i: i - rate * t; outstanding charge = walk - its minimum so far
    local = sliced.withColumn("__n", F.row_number().over(in_slice) - 1).withColumn(
        "__w", F.col("__n") - F.col("__t") * rate)
    local = local.withColumn("__min", F.min("__w").over(so_far))
    per_slice = local.groupBy(key, "__slice").agg(F.count(F.lit(1)).alias("__count"), F.min("__w").alias("__low"))
    earlier = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.withColumn("__base", F.coalesce(F.sum("__count").over(earlier), F.lit(0)))
    offsets = offsets.withColumn("__prior", F.min(F.col("__low") + F.col("__base")).over(earlier)).select(
        key, "__slice", "__base", "__prior")
    walked = local.join(offsets, [key, "__slice"]).withColumns({
        "__w": F.col("__w") + F.col("__base"),
        "__min": F.least(F.col("__min") + F.col("__base"), F.coalesce("__prior", F.lit(float("inf")))),
    })
    # the bucket is full again whenever the walk makes a new low: a stretch starts
    marked = walked.withColumn("__debt", F.col("__w") - F.col("__min")).withColumn(
        "__stretch", F.col("__min"))
    tight = marked.groupBy(key, "__stretch").agg(F.max("__debt").alias("__peak")).where(
        F.col("__peak") > capacity - 1.0 - 1e-3)
    columns = log.columns
    easy = marked.join(tight.select(key, "__stretch"), [key, "__stretch"], "left_anti").select(
        *columns, F.lit(True).alias("admitted"), F.lit(None).cast("double").alias("wait_s"))
    hard = marked.join(tight.select(key, "__stretch"), [key, "__stretch"], "left_semi").select(
        *columns, "__t", "__stretch")

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretch, tokens, updated = None, capacity, 0.0
        for rows in batches:
            admitted, waits = [], []
            for who, which, now in zip(rows[key], rows["__stretch"], rows["__t"]):
                if (who, which) != stretch:
                    stretch, tokens, updated = (who, which), capacity, now
                tokens = min(capacity, tokens + max(0.0, now - updated) * rate)
                updated = max(updated, now)
                ok = tokens >= 1.0
                admitted.append(ok)
                waits.append(None if ok else (1.0 - tokens) / rate)
                tokens -= 1.0 if ok else 0.0
            out = rows.drop(columns=["__t", "__stretch"])
            out["admitted"], out["wait_s"] = admitted, pd.array(waits, dtype="Float64")
            yield out

    ordered = hard.repartition(key, "__stretch").sortWithinPartitions(key, "__stretch", "__t", order)
    stepped = ordered.mapInPandas(step, easy.schema)
    return easy.unionByName(stepped)


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` up to each row in ``order``, the row included.

    A prefix sum over equal shares: rows are dealt by range and summed up inside
    each part, the sums of the parts are one row each, and their running sum is
    added. ``order`` has to be total; rows that it can't tell apart stand in any order.
    """
    tie = F.monotonically_increasing_id()
    dealt = df.withColumn("__tie", tie).repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = 0
        for batch in batches:
            if batch.num_rows:
                values = np.nan_to_num(batch.column(value).to_numpy(zero_copy_only=False)).astype(np.int64)
                sums = np.cumsum(values) + so_far
                so_far = int(sums[-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], names=[*batch.schema.names, name])

    local = dealt.withColumn("__part", F.spark_partition_id())
    local = local.mapInArrow(add_up, T.StructType([*local.schema.fields, T.StructField(name, T.LongType())]))
    local = materialize(local, "running")
    # one row per part
    sums = sorted(local.groupBy("__part").agg(F.sum(value)).collect())
    before = accumulate([0, *[r[1] or 0 for r in sums]])
    starts = df.sparkSession.createDataFrame([(r[0], b) for r, b in zip(sums, before)], "__part int, __before long")
    return local.join(F.broadcast(starts), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def in_flight(log: DataFrame, cap: int = fixed.MAX_IN_FLIGHT, order: str = "event_id") -> DataFrame:
    """Adds ``active``, the requests active when each one arrives, itself included,
    and ``over``, whether that is beyond the cap, all requests taken as served.

    A sweep over starts and ends in equal shares, however the requests lie in time.
    An end counts before a start of the same moment, but the end of a request that
    takes no time comes after its own start and before the next one. A null duration is none.
    """
    lasts = F.greatest(F.coalesce("duration_s", F.lit(0.0)), F.lit(0.0))
    timed = log.select(F.struct(*log.columns).alias("__row"), F.col(order).alias("__order"), _seconds(F.col("ts")).alias("__t"), lasts.alias("__lasts"))
    ends_at = F.col("__t") + F.col("__lasts")
    points = timed.select("__order", F.explode(F.array(
        F.struct(F.col("__t").alias("at"), F.lit(1).alias("phase"), F.lit(1).alias("d"), F.col("__row").alias("row")),
        F.struct(ends_at.alias("at"), F.when(ends_at > F.col("__t"), 0).otherwise(1).alias("phase"), F.lit(-1).alias("d"),
                 F.lit(None).cast(timed.schema["__row"].dataType).alias("row")))).alias("p")).select("__order", "p.*")
    swept = running_total(points, [F.col("at"), F.col("phase"), F.col("__order"), F.desc("d")], "d", "active")
    return swept.where("d = 1").select("row.*", "active").withColumn("over", F.col("active") > cap)


class Admission:
    """One request after the other: a charge to the key's bucket, then a slot; without a slot the charge is given back."""

    def __init__(self, per_minute: int, cap: int, buckets: dict, ends: list[float]):
        self.rate, self.capacity, self.cap = per_minute / 60.0, float(per_minute), cap
        self.buckets, self.ends = buckets, list(ends)
        heapq.heapify(self.ends)

    def step(self, key, now: float, lasts: float) -> tuple[bool, str | None, float | None]:
        """Admitted, or the reason, and for the rate limit the seconds to wait."""
        if self.rate:
            tokens, updated = self.buckets.get(key, (self.capacity, now))
            tokens, updated = min(self.capacity, tokens + max(0.0, now - updated) * self.rate), max(updated, now)
            if tokens < 1.0:
                self.buckets[key] = (tokens, updated)
                return False, "rate_limit_exceeded", (1.0 - tokens) / self.rate
            tokens -= 1.0
        while self.ends and self.ends[0] <= now:
            heapq.heappop(self.ends)
        served = len(self.ends) < self.cap
        if served:
            heapq.heappush(self.ends, now + lasts)
        if self.rate:
            self.buckets[key] = (tokens if served else min(self.capacity, tokens + 1.0), updated)
        return served, None if served else "capacity_exceeded", None


def admit(
    log: DataFrame, per_minute: int = fixed.REQUESTS_PER_MINUTE, cap: int = fixed.MAX_IN_FLIGHT, key: str = "key_id",
    order: str = "event_id", slice_rows: int = 200_000,
) -> DataFrame:
    """Adds ``admitted``, ``reason``, ``wait_s`` and ``refund``: rate limit per key and slots of all keys in one run.

    A refused request holds no slot, and a request that gets no slot gets its
    charge back, so every decision depends on those before it. The log is cut by
    time into slices of about ``slice_rows``, and all slices are stepped through side by side, each
    from a guess of what it starts with: buckets and ends of running requests. What
    a slice ends with is the start of the next one; where that differs from the
    guess, the slice is stepped through again. Buckets that fill up and slots that
    free up forget what they started with, so few rounds settle most slices; each
    round settles at least the first open one, so the result is exact. No task holds more than a slice.

    ``per_minute`` of 0 is no rate limit. A null duration is none. Requests of the same moment come by ``order``.
    """
    spark, columns = log.sparkSession, log.columns
    timed = log.withColumns({"__t": _seconds(F.col("ts")), "__lasts": F.greatest(F.coalesce(F.col("duration_s").cast("double"), F.lit(0.0)), F.lit(0.0))})
    n = max(-(-timed.count() // slice_rows), 1)
    dealt = timed.repartitionByRange(n, "__t", order).withColumn("__slice", F.spark_partition_id())
    dealt = materialize(dealt, "slices")
    narrow = dealt.select("__slice", F.col(key).cast("string").alias("__key"), "__t", "__lasts", F.col(order).alias("__order"))
    state = "__slice int, buckets array<struct<key: string, tokens: double, updated: double>>, ends array<double>"
    slices = sorted(r[0] for r in dealt.select("__slice").distinct().collect())  # one row per slice
    steps = spark.createDataFrame(list(zip(slices[1:], slices)), "__slice int, __previous int")

    def machine(entry: pd.DataFrame) -> Admission:
        known = entry.iloc[0] if len(entry) else None
        buckets = {b["key"]: (b["tokens"], b["updated"]) for b in known["buckets"]} if known is not None else {}
        return Admission(per_minute, cap, buckets, known["ends"] if known is not None else [])

    def leave(group, rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__t", "__order"], kind="stable")
        made = machine(entry)
        for k, t, d in zip(rows["__key"], rows["__t"], rows["__lasts"]):
            made.step(k, t, d)
        touched = set(rows["__key"]) if per_minute else ()
        buckets = [{"key": k, "tokens": made.buckets[k][0], "updated": made.buckets[k][1]} for k in touched]
        return pd.DataFrame({"__slice": [group[0]], "buckets": [buckets], "ends": [sorted(made.ends)]})

    def stepped(rows: DataFrame, entries: DataFrame, run, schema) -> DataFrame:
        return rows.groupBy("__slice").cogroup(entries.groupBy("__slice")).applyInPandas(run, schema)

    entries = spark.createDataFrame([], state)
    exits = materialize(stepped(narrow, entries, leave, state), "exits")
    while True:
        # a key starts with what the last slice that had it left; a slice has its keys once
        each = exits.select("__slice", F.inline("buckets"))
        last = F.lag(F.struct("key", "tokens", "updated")).over(Window.partitionBy("key").orderBy("__slice"))
        buckets = each.withColumn("b", last).where("b is not null").groupBy("__slice").agg(F.sort_array(F.collect_list("b")).alias("buckets"))
        ends = steps.join(exits.select(F.col("__slice").alias("__previous"), "ends"), "__previous").select("__slice", "ends")
        found = ends.join(buckets, "__slice", "left").select("__slice", F.coalesce("buckets", F.array().cast("array<struct<key: string, tokens: double, updated: double>>")).alias("buckets"), "ends")
        found = materialize(found, "entries")
        changed = found.join(entries.withColumnsRenamed({"buckets": "b", "ends": "e"}), "__slice", "left").where(
            "b is null or buckets <> b or ends <> e").select("__slice")
        changed = materialize(changed, "changed")
        entries = found
        if not changed.head(1):
            break
        again = stepped(narrow.join(changed, "__slice", "left_semi"), entries.join(changed, "__slice", "left_semi"), leave, state)
        exits = materialize(exits.join(changed, "__slice", "left_anti").unionByName(again), "exits")

    out = T.StructType([*log.schema.fields, *T.StructType().add("admitted", "boolean").add("reason", "string").add("wait_s", "double").fields])

    def decide(group, rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__t", order], kind="stable")
        made = machine(entry)
        told = [made.step(k, t, d) for k, t, d in zip(rows[key].astype(str), rows["__t"], rows["__lasts"])]
        result = rows[columns].copy()
        result["admitted"], result["reason"] = [a for a, _, _ in told], [r for _, r, _ in told]
        result["wait_s"] = pd.array([w for _, _, w in told], dtype="Float64")
        return result

    return stepped(dealt, entries, decide, out).withColumn("refund", F.col("reason").eqNullSafe("capacity_exceeded"))


def admit_in_flight(log: DataFrame, cap: int = fixed.MAX_IN_FLIGHT, order: str = "event_id", slice_rows: int = 200_000) -> DataFrame:
    """Adds ``admitted`` and ``refund`` when requests over the cap are refused, without a rate limit.

    A refused request holds no slot, so later ones may be admitted. ``refund`` says that the
    rate-limit charge is given back.
    """
    return admit(log.withColumn("__no_key", F.lit("")), 0, cap, "__no_key", order, slice_rows).drop("__no_key", "reason", "wait_s")
