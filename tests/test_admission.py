"""Joint admission and sweeps in equal shares, against plain loops."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators import admission

LOG = "event_id long, key_id string, t double, duration_s double"


def log_of(spark, rows):
    return spark.createDataFrame(rows, LOG).selectExpr("event_id", "key_id", "timestamp_micros(cast(t * 1000000 as bigint)) as ts", "duration_s", "'x' as reason_")


def traffic(seed, n=2500, keys=("hot", "hot", "cold", "rare"), steps=(0.0, 0.25, 0.5, 2.0), pause=200, longest=9):
    rng, now, rows = random.Random(seed), 1_700_000_000.0, []
    for i in range(n):
        now += 700.0 if pause and i % pause == pause - 1 else rng.choice(steps)
        rows.append((i, rng.choice(keys), now, float(rng.randrange(0, longest))))
    return rows


def plain(rows, per_minute, cap):
    """Event id to (admitted, reason, wait)."""
    rate, buckets, ends, out = per_minute / 60.0, {}, [], {}
    for i, key, t, d in sorted(rows, key=lambda r: (r[2], r[0])):
        if rate:
            level, last = buckets.get(key, (float(per_minute), t))
            level = min(float(per_minute), level + (t - last) * rate)
            if level < 1:
                buckets[key] = (level, t)
                out[i] = (False, "rate_limit_exceeded", (1 - level) / rate)
                continue
            buckets[key] = (level - 1, t)
        while ends and ends[0] <= t:
            heapq.heappop(ends)
        if len(ends) < cap:
            heapq.heappush(ends, t + max(d or 0.0, 0.0))
            out[i] = (True, None, None)
        else:
            if rate:
                buckets[key] = (min(float(per_minute), buckets[key][0] + 1), t)
            out[i] = (False, "capacity_exceeded", None)
    return out


def got(df):
    return {r.event_id: (r.admitted, r.reason, None if r.wait_s is None else float(r.wait_s)) for r in df.collect()}


@pytest.mark.parametrize("seed,per_minute,cap,slice_rows", [(1, 12, 4, 300), (2, 60, 3, 900), (3, 7, 40, 2500), (4, 0, 3, 400)])
def test_joint_admission_equals_a_plain_loop(spark, seed, per_minute, cap, slice_rows):
    rows = traffic(seed)
    want = plain(rows, per_minute, cap)
    judged = admission.admit(log_of(spark, rows).repartition(3), per_minute, cap, slice_rows=slice_rows)
    assert got(judged) == want
    assert {r for _, r, _ in want.values()} >= ({None, "capacity_exceeded", "rate_limit_exceeded"} if per_minute == 12 else {None})
    assert judged.filter("refund != (reason <=> 'capacity_exceeded')").count() == 0 and "reason_" in judged.columns


def test_a_refund_changes_later_rate_decisions(spark):
    rows = [(0, "a", 0.0, 50.0), (1, "b", 1.0, 1.0), (2, "b", 2.0, 1.0), (3, "b", 51.0, 1.0), (4, "b", 51.5, 0.0)]
    # b pays for nothing while the only slot is taken
    assert got(admission.admit(log_of(spark, rows), 1, 1, slice_rows=2)) == plain(rows, 1, 1)
    assert plain(rows, 1, 1)[3][0] and plain(rows, 1, 1)[1][1] == "capacity_exceeded"


def test_saturated_from_end_to_end(spark):
    # nothing fills up or frees up, so every slice depends on the one before it
    rows = [(i, "k", 1_700_000_000.0 + i * 0.7, 5.0) for i in range(600)]
    assert got(admission.admit(log_of(spark, rows), 20, 3, slice_rows=100)) == plain(rows, 20, 3)


def test_defined_cases(spark):
    rows = [(0, None, 1.0, None), (1, "", 1.0, -4.0), (2, "a", 1.0, 0.0), (3, "a", 1.0, 2.0), (4, "a", 1.0, 2.0)]
    assert got(admission.admit(log_of(spark, rows), 1, 1, slice_rows=2)) == plain(rows, 1, 1)
    empty = log_of(spark, rows).limit(0)
    assert admission.admit(empty).count() == 0 and admission.in_flight(empty).count() == 0
    assert admission.admit_in_flight(empty).columns == [*empty.columns, "admitted", "refund"]


def test_running_total_in_equal_shares(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(50), i, rng.randrange(-3, 9)) for i in range(5000)]
    frame = spark.createDataFrame(rows, "at int, id int, d int").repartition(5)
    summed = {r.id: r.total for r in admission.running_total(frame, [F.col("at"), F.col("id")], "d", "total").collect()}
    so_far, want = 0, {}
    for _, i, d in sorted(rows):
        so_far += d
        want[i] = so_far
    assert summed == want
    assert admission.running_total(frame.limit(0), [F.col("at")], "d", "total").count() == 0


def test_requests_of_one_hour_are_spread(spark):
    """No window by time: the share of a task doesn't depend on how the requests lie in time."""
    rows = [(i, "k", 1_700_000_000.0 + (i * 7919 % 3000) / 10, float(i % 5)) for i in range(4000)]
    judged = admission.in_flight(log_of(spark, rows), 3)
    plan = judged._sc._jvm.PythonSQLUtils.explainString(judged._jdf.queryExecution(), "formatted")
    assert "Window" not in plan
    want = {}
    events = sorted([(t, 1, i, 0) for i, _, t, d in rows] + [(t + d, 0 if d > 0 else 1, i, 1) for i, _, t, d in rows])
    active = 0
    for _, _, i, end in events:
        active += -1 if end else 1
        if not end:
            want[i] = active
    assert {r.event_id: r.active for r in judged.collect()} == want
