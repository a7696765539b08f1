"""Span-level evaluation of detection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions import fixed
from maskwright.session import materialize


def alias_labels(spans: DataFrame) -> DataFrame:
    """Labels of the same identifier under one name."""
    label = F.col("entity_type")
    for old, new in fixed.SAME_CODE_LABELS.items():
        label = F.when(F.col("entity_type") == old, new).otherwise(label)
    return spans.withColumn("entity_type", label)


def gold_spans(examples: DataFrame) -> DataFrame:
    """Gold spans of examples, one row each."""
    return examples.select("id", "lang", "kind", F.inline("spans"))


def match_spans(gold: DataFrame, pred: DataFrame, examples: DataFrame) -> DataFrame:
    """Outcome ``tp``, ``fn`` or ``fp`` of every distinct (id, start, end, type).

    Both sides go into one aggregation instead of a full outer join of two
    deduplicated inputs: one shuffle, combined before it.
    """
    key = ("id", "start", "end", "entity_type")
    both = gold.select(*key, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(
        pred.select(*key, F.lit(0).alias("g"), F.lit(1).alias("p")))
    merged = both.groupBy(*key).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    outcome = F.when((F.col("g") == 1) & (F.col("p") == 1), "tp").when(F.col("g") == 1, "fn").otherwise("fp")
    return merged.select(*key, outcome.alias("outcome")).join(examples.select("id", "lang", "kind"), "id")


def score_buckets(outcomes: DataFrame) -> DataFrame:
    """Counts by entity, language, entity and language, and kind."""
    view = "outcomes_to_score"
    grouped = outcomes.groupingSets(
        [["entity_type"], ["lang"], ["entity_type", "lang"], ["kind"]], "entity_type", "lang", "kind"
    ).agg(
        F.grouping_id().alias("gid"),
        F.count_if(F.col("outcome") == "tp").alias("tp"),
        F.count_if(F.col("outcome") == "fp").alias("fp"),
        F.count_if(F.col("outcome") == "fn").alias("fn"),
    )
    bucket = (
        F.when(F.col("gid") == 3, "entity").when(F.col("gid") == 5, "language")
        .when(F.col("gid") == 1, "entity_language").otherwise("kind"))
    key = (
        F.when(F.col("gid") == 3, F.col("entity_type")).when(F.col("gid") == 5, F.col("lang"))
        .when(F.col("gid") == 1, F.concat_ws("/", "entity_type", "lang")).otherwise(F.col("kind")))
    return grouped.select(bucket.alias("bucket"), key.alias("key"), "tp", "fp", "fn")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(1.0)).otherwise(part / F.nullif(whole, F.lit(0)))


def precision_recall_f1(counts: DataFrame) -> DataFrame:
    """Adds precision, recall (1.0 where nothing was due), f1 and support."""
    p = _share(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _share(F.col("tp"), F.col("tp") + F.col("fn"))
    scored = counts.withColumns({"precision": p, "recall": r, "support": F.col("tp") + F.col("fn")})
    return scored.withColumn("f1", F.when(
        F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
        2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))))


def rounded(scores: DataFrame) -> DataFrame:
    """The rates to 4 decimals, as reports show them."""
    return scores.withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1")})


def split_by_kind(outcomes: DataFrame, kinds: Sequence[str] = fixed.SCORED_KINDS) -> DataFrame:
    """Outcomes of the examples of one report."""
    return outcomes.where(F.col("kind").isin(*kinds))


def thresholds_frame(spark, thresholds: dict[str, tuple[float, float]] = fixed.THRESHOLDS) -> DataFrame:
    """Thresholds as a table."""
    return spark.createDataFrame(
        [(k, p, r) for k, (p, r) in sorted(thresholds.items())],
        "entity_type string, min_precision double, min_recall double")


def threshold_gate(
    scores: DataFrame, thresholds: DataFrame, default: tuple[float, float] = fixed.DEFAULT_THRESHOLD
) -> DataFrame:
    """Entity/language pairs below their thresholds; judged on unrounded rates."""
    pairs = scores.where("bucket = 'entity_language'").withColumn("entity_type", F.substring_index("key", "/", 1))
    joined = pairs.join(thresholds, "entity_type", "left").fillna(
        {"min_precision": default[0], "min_recall": default[1]})
    return joined.where("precision < min_precision or recall < min_recall")


def failure_list(outcomes: DataFrame) -> DataFrame:
    """All failures: where and why, without the text."""
    reason = F.when(F.col("outcome") == "fn", "missed").otherwise("spurious")
    return outcomes.where("outcome <> 'tp'").select(
        F.col("id").alias("example_id"), "kind", "lang", reason.alias("reason"), "entity_type", "start", "end")


def overall(counts: DataFrame) -> DataFrame:
    """Totals over entities."""
    return counts.where("bucket = 'entity'").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]], bins: int = 4096) -> DataFrame:
    """``keys``, ``n`` and per name the value of that rank, from 1, among the values of a group; exact.

    ``ranks`` gives each rank from the column of the number of values. Selection by digits: a
    histogram of equal steps between the lowest and the highest value is counted, by turns of the values and of
    their magnitudes, and only the bin that holds the rank is looked at again, between its own
    lowest and highest value, until that is one value, which takes few passes however the values lie. Every pass is a partial aggregation, so the values of a group never meet; a
    histogram has at most ``bins`` rows a group and rank. Null and NaN are no values; a group without values has no row.
    """
    most = 1.7976931348623157e308
    number = F.col(value).cast("double")
    base = df.where(number.isNotNull() & ~F.isnan(number)).select(*keys, F.greatest(F.least(number, F.lit(most)), F.lit(-most)).alias("__v"))
    sizes = base.groupBy(*keys).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("bigint").alias("k")) for name, rank in ranks.items()]))
    targets = materialize(sizes.select(*keys, "n", "lo", "hi", each.alias("t")).select(*keys, "n", "t.name", "t.k", "lo", "hi"), "ranks")

    def same(left: DataFrame, right: DataFrame, *more: str) -> Column:
        return reduce(and_, [left[c].eqNullSafe(right[c]) for c in (*keys, *more)])

    def size(x: Column) -> Column:
        # in the order of the numbers, and zero for zero alone; the logarithm of the least number is above -746
        return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.ln(F.abs(x)) + 746))

    by_size = False
    while targets.where("lo < hi").head(1):
        open_ = targets.where("lo < hi")
        ranges = open_.select(*keys, "lo", "hi").distinct().alias("r")
        inside = base.join(ranges, same(base, ranges) & F.col("__v").between(F.col("lo"), F.col("hi"))).select(*[base[k] for k in keys], "lo", "hi", "__v")
        # the distance of the largest numbers is taken in halves; that of others is never zero
        whole = F.col("hi") - F.col("lo")
        share = F.when(whole < float("inf"), (F.col("__v") - F.col("lo")) / whole).otherwise(
            (F.col("__v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2))
        if by_size:
            low, high = size(F.col("lo")), size(F.col("hi"))
            share = F.when(low < high, (size(F.col("__v")) - low) / F.when(low < high, high - low)).otherwise(share)
        by_size = not by_size
        bin_ = F.least(F.floor(share * bins), F.lit(bins - 1))
        counted = inside.groupBy(*keys, "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        counted = counted.withColumn("upto", upto)
        met = open_.join(counted, same(open_, counted, "lo", "hi")).where("upto - c < k and k <= upto")
        closer = met.select(*[open_[c] for c in (*keys, "n", "name")], F.expr("k - (upto - c)").alias("k"), F.col("low").alias("lo"), F.col("high").alias("hi"))
        targets = materialize(targets.where("lo = hi").unionByName(closer), "ranks")
    return targets.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("lo"))).alias(name) for name in ranks])


def stage_latency(timings: DataFrame, budget_ms: float = 150.0) -> DataFrame:
    """Per stage p50, p95, p99, max, mean, and whether p95 is within the budget.

    The median averages the two middle values; p95 and p99 are observed values of
    a rank. Exact, by ``order_statistics``: there are few stages, so none of them may gather in a task.
    """
    share = lambda fraction: lambda n: F.greatest(F.lit(1), F.floor(n * fraction))
    ranks = {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.floor(n / 2) + 1, "p95_ms": share(0.95), "p99_ms": share(0.99), "max_ms": lambda n: n}
    found = order_statistics(timings, ["stage"], "ms", ranks)
    means = timings.groupBy("stage").agg(F.avg("ms").alias("mean_ms"))
    joined = found.join(means, found["stage"].eqNullSafe(means["stage"])).drop(means["stage"])
    summary = joined.select("stage", F.col("n").alias("iterations"), ((F.col("low") + F.col("high")) / 2).alias("p50_ms"), "p95_ms", "p99_ms", "max_ms", "mean_ms")
    return summary.withColumns({c: F.round(c, 3) for c in ("p50_ms", "p95_ms", "p99_ms", "max_ms", "mean_ms")}).withColumn(
        "within_budget", F.col("p95_ms") <= budget_ms)


def baseline_regression(scores: DataFrame, baseline: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """``(entity_type, problem)``: below the stored baseline, gone, or a stale exception.

    ``baseline``: ``(entity_type, precision, recall)``; ``exceptions``: ``(key)`` of
    entity/language pairs allowed to fail.
    """
    by_entity = scores.where("bucket = 'entity'").select(
        F.col("key").alias("entity_type"), F.col("precision").alias("p"), F.col("recall").alias("r"))
    joined = baseline.join(by_entity, "entity_type", "left")
    problem = (
        F.when(F.col("p").isNull(), "missing").when(F.col("p") < F.col("precision"), "precision_regressed")
        .when(F.col("r") < F.col("recall"), "recall_regressed"))
    found = joined.withColumn("problem", problem).where("problem is not null").select("entity_type", "problem")
    if exceptions is None:
        return found
    failing = threshold_gate(scores, thresholds_frame(scores.sparkSession)).select("key")
    stale = exceptions.join(failing, "key", "left_anti").select(
        F.col("key").alias("entity_type"), F.lit("stale_exception").alias("problem"))
    return found.unionByName(stale)


def corpus_checks(examples: DataFrame) -> DataFrame:
    """``(id, problem)``: duplicate ids, unknown kinds, spans out of bounds or on
    whitespace, controls with gold."""
    twice = examples.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate_id").alias("problem"))
    cases = F.expr(
        "filter(array("
        f"if(kind not in ({', '.join(repr(k) for k in fixed.CORPUS_KINDS)}), 'unknown_kind', null), "
        "if(kind in ('negative', 'boundary') and size(spans) > 0, 'control_with_gold', null), "
        "if(exists(spans, s -> s.start < 0 or s.end <= s.start or s.end > length(text)), 'out_of_bounds', null), "
        "if(exists(spans, s -> s.start >= 0 and s.end > s.start and s.end <= length(text) and "
        "substr(text, s.start + 1, s.end - s.start) rlike r'^[\\s\\p{Z}]*$'), 'whitespace_gold', null)), "
        "p -> p is not null)"
    )
    return examples.select("id", F.explode(cases).alias("problem")).unionByName(twice)


def split_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(what, n)``: distinct texts, and texts with digits masked, that two splits share.

    Texts are compared by a 256-bit digest, so that texts are not shuffled.
    """
    def digests(df: DataFrame) -> DataFrame:
        shape = F.regexp_replace("text", r"\p{Nd}", "#")
        return df.select(F.inline(F.array(
            F.struct(F.lit("text").alias("what"), F.sha2(F.col("text"), 256).alias("d")),
            F.struct(F.lit("shape").alias("what"), F.sha2(shape, 256).alias("d")))))

    return digests(a).intersect(digests(b)).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


def coverage_gap(examples: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Entities with a threshold and no example."""
    seen = examples.select(F.explode("spans").alias("s")).select(F.col("s.entity_type").alias("entity_type")).distinct()
    return thresholds.select("entity_type").join(seen, "entity_type", "left_anti")


def compare_paths(runs: DataFrame, measures: Sequence[str], paths: tuple[str, str] = ("direct", "gateway")) -> DataFrame:
    """Per protocol, profile and size: medians and 95th percentiles of each measure on two paths, the
    difference of the medians, and the failure rates. Percentiles lie between the two nearest values.

    ``runs``: ``(protocol, profile, size, path, failed, <measures>)``.
    """
    keys = ["protocol", "profile", "size"]
    measured = runs.where("not failed").select(*keys, "path", F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])))
    shares = {"p50": 0.5, "p95": 0.95}
    ranks = {}
    for name, share in shares.items():
        ranks[f"{name}_low"] = lambda n, share=share: F.floor((n - 1) * share) + 1
        ranks[f"{name}_high"] = lambda n, share=share: F.ceil((n - 1) * share) + 1
    found = order_statistics(measured.where(F.col("path").isin(*paths)), [*keys, "path", "measure"], "value", ranks)
    between = {}
    for name, share in shares.items():
        at = (F.col("n") - 1) * share
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        between[name] = F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
    of = lambda p, m, name: F.max(F.when((F.col("path") == p) & (F.col("measure") == m), between[name])).alias(f"{p}_{m}_{name}")
    quantiles = found.groupBy(*keys).agg(*[of(p, m, name) for p in paths for m in measures for name in shares])
    rates = runs.groupBy(*keys).pivot("path", list(paths)).agg(F.avg(F.col("failed").cast("double")).alias("failure_rate"), F.count(F.lit(1)).alias("runs"))
    joined = rates.join(quantiles, reduce(and_, [rates[k].eqNullSafe(quantiles[k]) for k in keys]), "left")
    wide = joined.select(*[rates[k] for k in keys], *[c for c in quantiles.columns if c not in keys], *[c for c in rates.columns if c not in keys])
    first, second = paths
    return wide.withColumns({f"{m}_p50_change": F.col(f"{second}_{m}_p50") - F.col(f"{first}_{m}_p50") for m in measures})
