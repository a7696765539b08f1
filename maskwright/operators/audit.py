"""Audit events, reason codes, metrics, leak scan."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import fixed
from maskwright.operators.tokens import spliced
from maskwright.session import materialize

AUDIT_SCHEMA = (
    "schema_version int, request_id string, tenant_id string, conversation_id string, api_key_id string, "
    "application string, timestamp double, model_requested string, destination string, provider string, "
    "decision string, rule_name string, policy_version string, entity_counts map<string,bigint>, "
    "encoding_signals map<string,bigint>, entities_transformed bigint, restoration_performed boolean, "
    "tokens_restored bigint, tokens_refused bigint, tokens_refused_by_reason map<string,bigint>, "
    "raw_content_logged boolean, latency_ms double, error string"
)

#: The error of a request that a rule blocked; any other is a refusal before a rule decided.
BLOCKED = "blocked_by_policy"


def build_audit(
    requests: DataFrame, inspected: DataFrame, decisions: DataFrame, restores: DataFrame | None = None,
    as_of=None,
) -> DataFrame:
    """One event per request, counts and codes only.

    ``requests``: ids and whatever of model_requested, provider, timestamp,
    latency_ms, error and active_version (of the policy) is known. Counts of types and signals come from one
    aggregation, with the small map entries combined before the shuffle. A request
    that was refused before a rule decided counts as blocked by the refusal, and no
    provider has seen it or a blocked one.
    """
    pairs = inspected.select("request_id", F.inline(F.concat(
        F.transform("spans", lambda s: F.struct(F.lit("e").alias("what"), s["entity_type"].alias("code"), F.lit(1).cast("bigint").alias("n"))),
        F.transform(F.map_entries("signals"), lambda e: F.struct(F.lit("s").alias("what"), e["key"].alias("code"), e["value"].alias("n"))))))
    sums = pairs.groupBy("request_id", "what", "code").agg(F.sum("n").alias("n"))
    entry = F.struct("code", "n")

    def as_map(what: str) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("what") == what, entry))))

    maps = sums.groupBy("request_id").agg(as_map("e").alias("entity_counts"), as_map("s").alias("encoding_signals"))
    decided = decisions.select("request_id", F.col("action").alias("decision"), "destination", "rule_name", "policy_version")
    joined = requests.join(decided, "request_id", "left").join(maps, "request_id", "left")
    if restores is not None:
        joined = joined.join(restores, "request_id", "left")
    if "error" in joined.columns:
        refused_early = F.col("error").isNotNull() & (F.col("error") != BLOCKED)
        joined = joined.withColumns({
            "decision": F.when(refused_early, "block").otherwise(F.col("decision")),
            "destination": F.when(~refused_early, F.col("destination")),
            "rule_name": F.when(refused_early, fixed.REFUSED_RULE).otherwise(F.col("rule_name")),
        })
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    total = F.aggregate(F.map_values("entity_counts"), F.lit(0).cast("bigint"), lambda a, v: a + v)
    have = set(joined.columns)

    def field(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    restored, refused = field("tokens_restored", F.lit(0)), field("tokens_refused", F.lit(0))
    full = joined.withColumns({
        "entity_counts": F.coalesce("entity_counts", empty),
        "encoding_signals": F.coalesce("encoding_signals", empty),
    }).withColumns({
        "schema_version": F.lit(fixed.AUDIT_VERSION),
        "timestamp": field("timestamp", (F.unix_micros(F.lit(as_of).cast("timestamp")) / 1e6) if as_of else F.lit(None)),
        "model_requested": field("model_requested", F.lit("unknown")),
        "provider": F.when(F.col("decision") == "block", "none").otherwise(
            field("provider", F.coalesce("destination", F.lit("none")))),
        "destination": F.coalesce("destination", F.lit("none")),
        "decision": F.coalesce("decision", F.lit("none")),
        "rule_name": F.coalesce("rule_name", F.lit("none")),
        "policy_version": F.coalesce("policy_version", field("active_version", F.lit("none")), F.lit("none")),
        "entities_transformed": F.when(F.col("decision").isin("transform", "route_local"), total).otherwise(0),
        "tokens_restored": restored, "tokens_refused": refused,
        "restoration_performed": restored > 0,
        "tokens_refused_by_reason": field("tokens_refused_by_reason", empty),
        "raw_content_logged": F.lit(False),
        "latency_ms": field("latency_ms", F.lit(0.0)),
        "error": field("error", F.lit(None)),
    })
    fields = [f.split(" ", 1) for f in AUDIT_SCHEMA.split(", ")]
    return full.select(*[
        (F.col(n) if n in full.columns else F.lit("unknown")).cast(t).alias(n) for n, t in fields])


def contract_reason(code: Column) -> Column:
    """A contract code of the closed vocabulary; anything else is invalid_request."""
    return F.when(code.isin(*fixed.CONTRACT_CODES), code).otherwise("invalid_request")


def reason_codes(df: DataFrame, code: str = "code", source: str = "source") -> DataFrame:
    """Adds ``reason`` by the kind of failure given in ``source``.

    contract: the request contract; screening: deceptive encoding; inspection,
    timeout, routing, egress, provider, vault, cancelled; others are internal.
    """
    c, s = F.col(code), F.col(source)
    known = c.isin(*fixed.REASON_CODES)
    reason = (
        F.when(s == "contract", contract_reason(c))
        .when(s == "screening", F.when(known, c).otherwise("inspection_failed"))
        .when(s == "inspection", "inspection_failed")
        .when(s == "timeout", "detector_timeout")
        .when(s == "routing", "local_routing_violation")
        .when(s == "egress", "egress_blocked")
        .when(s == "provider", F.when(known, c).otherwise("provider_error"))
        .when(s == "vault", "vault_error")
        .when(s == "cancelled", "cancelled")
        .otherwise("internal_error")
    )
    return df.withColumn("reason", reason)


def one_event_per_request(requests: DataFrame, audit: DataFrame) -> DataFrame:
    """Requests with no event or more than one, and events of unknown requests."""
    both = requests.select("request_id", F.lit(1).alias("r"), F.lit(0).alias("e")).unionByName(
        audit.select("request_id", F.lit(0).alias("r"), F.lit(1).alias("e")))
    counted = both.groupBy("request_id").agg(F.max("r").alias("known"), F.sum("e").alias("events"))
    problem = (
        F.when(F.col("known") == 0, "unknown_request").when(F.col("events") == 0, "no_event")
        .when(F.col("events") > 1, "many_events"))
    return counted.withColumn("problem", problem).where("problem is not null").select("request_id", "events", "problem")


def status_class(status: Column) -> Column:
    """2xx to 5xx, none, other."""
    return (
        F.when(status.isNull(), "none")
        .when((status >= 200) & (status < 600), F.concat(F.floor(status / 100).cast("string"), F.lit("xx")))
        .otherwise("other"))


def _label(value: Column, allowed) -> Column:
    return F.when(value.isin(*allowed), value).otherwise("other")


def metric_counters(audit: DataFrame) -> DataFrame:
    """``(metric, labels, value)``; labels outside the closed sets become ``other``.

    Reads audit events with a ``status`` column. One pass: an event turns into
    its increments, which are summed by label before anything is shuffled.
    """
    route = F.lit(fixed.METRIC_ROUTES[0])
    ok = F.col("status").between(200, 299)

    def inc(metric: str, labels: Column, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), labels.alias("labels"), value.cast("bigint").alias("n"))

    requests = F.concat_ws(
        ",", route, _label(status_class(F.col("status")), fixed.METRIC_STATUS),
        _label(F.col("decision"), fixed.METRIC_DECISIONS), _label(F.col("destination"), fixed.METRIC_DESTINATIONS))
    events = F.array(
        inc("requests_total", requests, F.lit(1)),
        inc("request_refusals_total", F.concat_ws(",", route, _label(F.col("error"), fixed.REASON_CODES)),
            F.when(F.col("error").isNotNull(), 1).otherwise(0)),
        inc("tokens_restored_total", F.lit(""), F.when(ok, F.col("tokens_restored")).otherwise(0)),
    )
    refused = F.transform(F.map_entries("tokens_refused_by_reason"), lambda e: inc(
        "tokens_refused_total", _label(e["key"], fixed.REFUSAL_REASONS), F.when(ok, e["value"]).otherwise(0)))
    rows = audit.select(F.inline(F.concat(events, refused))).where("n > 0")
    return rows.groupBy("metric", "labels").agg(F.sum("n").alias("value"))


def leak_scan(originals: DataFrame, outputs: DataFrame, key: str = "request_id") -> DataFrame:
    """``(request_id, entity_type, n)``: original values found in outputs of their request.

    ``originals``: ``(request_id, entity_type, text)``. Reports types and counts,
    never the values. Each output meets the distinct values of its own request
    only; these travel as one array, bounded by the request's text.
    """
    values = originals.groupBy(key).agg(F.collect_set(F.struct("entity_type", "text")).alias("__values"))
    hits = outputs.join(values, key).select(key, F.explode(F.filter(
        "__values", lambda v: F.contains(F.col("text"), v["text"]))).alias("__v"))
    return hits.groupBy(key, F.col("__v.entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


def leak_scan_everywhere(originals: DataFrame, outputs: DataFrame, gram: int = 6) -> DataFrame:
    """``(kind, output_id, request_id, entity_type, n)``: original values of any request found in any output.

    ``originals``: ``(entity_type, text)`` of all requests; ``outputs``: ``(kind, output_id, request_id, text)``, such as
    what providers, callers, the audit and the metrics were given. Reports types and counts, never the values.
    ``request_id`` is the output's.

    Values are looked up by the rarest of their stretches of ``gram`` characters (all of a shorter value): the
    stretches of the outputs that occur in some value are kept, a value with a stretch that is nowhere is
    nowhere, and only outputs that hold a value's rarest stretch are compared with it. Null and empty values and outputs have no leak.
    """
    values = materialize(originals.select("entity_type", "text").where("length(text) > 0").distinct(), "values")
    short = [r[0] for r in values.where(F.length("text") < gram).select(F.length("text")).distinct().collect()]  # less than ``gram`` rows
    lengths = sorted({gram, *short})
    rows = materialize(outputs.select("kind", "output_id", "request_id", "text").withColumn("__id", F.monotonically_increasing_id()), "outputs")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = list({text[i : i + n] for n in lengths for i in range(len(text or "") - n + 1)}) if text else []
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(found), pa.int64()), pa.array(found, pa.string())], names=["__id", "gram"])

    size = F.least(F.lit(gram), F.length("text"))
    grams = values.select("text", size.alias("g")).distinct().select("text", F.explode(F.expr("transform(sequence(1, length(text) - g + 1), i -> substr(text, i, g))")).alias("gram")).distinct()
    grams = materialize(grams, "grams")
    seen = rows.select("__id", "text").mapInArrow(stretches, "__id long, gram string").join(grams.select("gram").distinct(), "gram", "left_semi")
    seen = materialize(seen, "seen")
    counts = seen.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rated = grams.join(counts, "gram", "left").groupBy("text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("a"))
    anchors = rated.where("a.n > 0").select(F.col("text").alias("value"), "a.gram")
    pairs = seen.join(anchors, "gram").select("__id", "value").distinct()
    hits = rows.join(pairs, "__id").where(F.contains(F.col("text"), F.col("value"))).select("kind", "output_id", "request_id", "value")
    typed = hits.join(values.withColumnRenamed("text", "value"), "value")
    return typed.groupBy("kind", "output_id", "request_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def preview_table(tokenized: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per text: detections without their values, both decisions, the projected output.

    ``decisions`` as of ``base_vs_effective``. A blocked text has no output.
    """
    found = F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"),
        s["score"].alias("score"), s["detector"].alias("detector")))
    joined = tokenized.join(decisions.select("request_id", "base", "effective"), "request_id")
    output = (
        "case when refusal is not null or effective.action = 'block' then null "
        "when effective.action in ('transform', 'route_local') and size(minted) > 0 then "
        f"{spliced('text', 'minted', 'p.token')} else text end"
    )
    return joined.select(
        "request_id", "idx", found.alias("detections"), "refusal", "signals", "base", "effective",
        F.expr(output).alias("output"), F.size("spans").alias("n_detections"))
