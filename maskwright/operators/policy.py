"""Policy decisions: requests against a rule table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import fixed

RULES_SCHEMA = (
    "name string, priority int, action string, destination string, entities array<string>, "
    "applications array<string>, min_score double, version string, default_destination string"
)
_TEXTS = pa.list_(pa.string())
_RULES_ARROW = [
    ("name", pa.string()), ("priority", pa.int32()), ("action", pa.string()), ("destination", pa.string()), ("entities", _TEXTS),
    ("applications", _TEXTS), ("min_score", pa.float64()), ("version", pa.string()), ("default_destination", pa.string()),
]
MODES = ("off", "detected", "all")


class PolicyError(ValueError):
    """A rule table that must not be used."""


def validate_rules(rules: DataFrame) -> DataFrame:
    """``(name, problem)`` rows; a usable rule table has none."""
    names = rules.groupBy("name").count()
    checks = {
        "missing_name": F.col("name").isNull() | (F.trim("name") == ""),
        "unknown_action": ~F.coalesce(F.col("action").isin(*fixed.ACTIONS), F.lit(False)),
        "bad_entities": F.col("entities").isNull()
        | F.exists("entities", lambda e: F.coalesce(F.trim(e) == "", F.lit(True))),
        "bad_applications": F.col("applications").isNull()
        | F.exists("applications", lambda e: F.coalesce(F.trim(e) == "", F.lit(True))),
        "bad_min_score": F.col("min_score").isNull()
        | F.isnan("min_score")
        | ~F.col("min_score").between(0.0, 1.0),
    }
    problems = F.filter(
        F.array(*[F.when(cond, F.lit(code)) for code, cond in checks.items()]), lambda p: p.isNotNull()
    )
    catch_all = F.count_if((F.size("entities") == 0) & (F.size("applications") == 0))
    return (
        rules.select("name", F.explode(problems).alias("problem"))
        .unionByName(names.where("count > 1").select("name", F.lit("duplicate_name").alias("problem")))
        .unionByName(
            rules.agg(catch_all.alias("n")).where("n = 0").select(
                F.lit(None).cast("string").alias("name"), F.lit("no_catch_all").alias("problem"))
        )
    )


def compose_rules(rules: DataFrame, more: DataFrame, suffix: str) -> DataFrame:
    """Policy rules and filter rules as one table; the version names both.

    ``more`` takes the policy's version and default destination.
    """
    policy = rules.agg(F.max("version").alias("version"), F.max("default_destination").alias("default_destination"))
    head = policy.first()
    version = f"{head['version']}+{suffix}"
    combined = rules.unionByName(
        more.withColumns({
            "version": F.lit(None).cast("string"),
            "default_destination": F.lit(None).cast("string"),
        })
    ).withColumns({"version": F.lit(version), "default_destination": F.lit(head["default_destination"])})
    clash = combined.groupBy("name").count().where("count > 1").limit(1).count()
    if clash:
        raise PolicyError("a filter rule has the name of a policy rule")
    return combined


def _local(spark: SparkSession, rows: list[dict], ranks: bool = False) -> DataFrame:
    """Rules as a table that the planner knows whole, so that reading it needs no job."""
    schema = pa.schema([("rank", pa.int32()), *_RULES_ARROW]) if ranks else pa.schema(_RULES_ARROW)
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def _order(rules: DataFrame) -> tuple[list[dict], DataFrame]:
    """Rules by priority, block first, name; the order is the tie rule. As rows and as a table with ``rank``.

    The rule table is configuration. It is read once, and what is joined is a table
    of known size, for which the planner chooses the join.
    """
    rows = [r.asDict(recursive=True) for r in rules.collect()]
    rows.sort(key=lambda r: (-(r["priority"] or 0), r["action"] != "block", r["name"] or ""))
    rows = [{"rank": k} | r for k, r in enumerate(rows)]
    return rows, _local(rules.sparkSession, rows, True)


def ranked(rules: DataFrame) -> DataFrame:
    """Adds ``rank``, the place of a rule in the order in which rules are tried."""
    return _order(rules)[1]


def request_facts(inspected: DataFrame) -> DataFrame:
    """One row per request and present (type, best score); NULL type if none.

    Messages keep only their distinct types before anything is shuffled.
    """
    keys = [c for c in ("request_id", "tenant_id", "conversation_id", "api_key_id", "application")
            if c in inspected.columns]
    present = F.expr(
        "transform(array_distinct(transform(spans, s -> s.entity_type)), t -> named_struct('entity_type', t, "
        "'score', array_max(transform(filter(spans, s -> s.entity_type = t), s -> s.score))))"
    )
    return inspected.select(*keys, F.explode_outer(present).alias("__p")).select(
        *keys, F.col("__p.entity_type").alias("entity_type"), F.col("__p.score").alias("score")
    )


def match_rules(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Every (request, rule) that matches, with the types that made it match.

    Rules with entities are an equi-join on the type; rules without any match
    every request and are attached to the request as a constant. Both rule sides
    are tables of known size, so the planner leaves the facts where they are.
    """
    rows, order = _order(rules)
    by_type = order.select("rank", "applications", "min_score", F.explode("entities").alias("entity_type"))
    app = F.col("application") if "application" in facts.columns else F.lit("unknown")
    facts = facts.withColumn("application", app)
    allowed = (F.size("applications") == 0) | F.array_contains("applications", F.col("application"))
    typed = (
        facts.join(by_type, "entity_type")
        .where(allowed & (F.col("score") >= F.col("min_score")))
        .groupBy("request_id", "rank")
        .agg(F.sort_array(F.collect_set("entity_type")).alias("matched_entities"))
    )
    always = [r for r in rows if not r["entities"]]
    if not always:
        return typed
    catch = F.array(*[
        F.struct(F.lit(r["rank"]).alias("rank"),
                 F.array(*[F.lit(a) for a in r["applications"]]).cast("array<string>").alias("apps"))
        for r in always])
    every = (
        facts.groupBy("request_id").agg(F.first("application").alias("application"))
        .select("request_id", "application", F.explode(catch).alias("r"))
        .where((F.size("r.apps") == 0) | F.array_contains("r.apps", F.col("application")))
        .select("request_id", F.col("r.rank").alias("rank"),
                F.array().cast("array<string>").alias("matched_entities"))
    )
    return typed.unionByName(every)


def _winners(facts: DataFrame, rows: list[dict], order: DataFrame) -> DataFrame:
    """Per request the best rank, its matched types and all types present.

    One aggregation over the facts: the best catch-all is known from the
    application alone, and typed rules arrive by an equi-join with a table of known size.
    """
    by_type = (
        order.select("rank", "applications", "min_score", F.explode("entities").alias("entity_type"))
        .groupBy("entity_type")
        .agg(F.collect_list(F.struct("rank", "applications", "min_score")).alias("__rules"))
    )
    if "application" not in facts.columns:
        facts = facts.withColumn("application", F.lit("unknown"))
    scopes = [c for c in ("tenant_id", "conversation_id", "api_key_id", "application") if c in facts.columns]
    hits = F.expr(
        "transform(filter(__rules, r -> score >= r.min_score and "
        "(size(r.applications) = 0 or array_contains(r.applications, application))), r -> r.rank)"
    )
    joined = facts.join(by_type, "entity_type", "left").withColumn("__rank", F.explode_outer(hits))
    # the sets hold (rule, type) pairs, so they are bounded by the policy, not by the data
    grouped = joined.groupBy("request_id").agg(
        *[F.first(c).alias(c) for c in scopes],
        F.min("__rank").alias("__typed"),
        F.collect_set(F.when(F.col("__rank").isNotNull(), F.struct("__rank", "entity_type"))).alias("__pairs"),
        F.sort_array(F.collect_set("entity_type")).alias("types"),
    )
    always = [r for r in rows if not r["entities"]]
    candidates = [
        F.lit(r["rank"]) if not r["applications"]
        else F.when(F.col("application").isin(*r["applications"]), F.lit(r["rank"]))
        for r in always
    ]
    best = F.array_min(F.array(F.col("__typed"), *candidates))
    return grouped.withColumn("rank", best).withColumn(
        "matched_entities",
        F.expr("array_sort(transform(filter(__pairs, p -> p.__rank = rank), p -> p.entity_type))"),
    ).drop("__typed", "__pairs")


def first_match(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """One decision per request; with no matching rule the request is blocked."""
    rows, order = _order(rules)
    winners = _winners(facts, rows, order)
    table = order.selectExpr(
        "rank", "name as rule_name", "action", "version as policy_version", "priority",
        "if(destination is null or destination = '', default_destination, destination) as destination")
    version = max((r["version"] for r in rows if r["version"] is not None), default=None)
    decided = winners.join(table, "rank", "left").withColumn(
        "reason",
        F.when(F.col("rule_name").isNull(), "no rule matched; failing closed").otherwise(
            F.format_string("matched rule '%s' (priority %d)", "rule_name", "priority")),
    )
    return decided.withColumns({
        "action": F.coalesce("action", F.lit("block")),
        "destination": F.coalesce("destination", F.lit("")),
        "rule_name": F.coalesce("rule_name", F.lit(fixed.IMPLICIT_DENY)),
        "policy_version": F.coalesce("policy_version", F.lit(version)),
        "any_detection": F.size("types") > 0,
    }).drop("rank", "priority")


def _check_mode(mode: str) -> str:
    mode = mode.strip().lower() or "off"
    if mode not in MODES:
        raise PolicyError(f"routing mode is one of {', '.join(MODES)}")
    return mode


def _needs_local(mode: str) -> Column:
    return F.lit(True) if mode == "all" else (F.col("any_detection") if mode == "detected" else F.lit(False))


def routing_floor(decisions: DataFrame, mode: str) -> DataFrame:
    """Moves decisions to the local destination where the mode wants it.

    Blocks and decisions that are local already stay as they are.
    """
    mode = _check_mode(mode)
    if mode == "off":
        return decisions
    moved = (F.col("action") != "block") & (F.col("destination") != fixed.LOCAL) & _needs_local(mode)
    why = F.format_string(
        "local routing %s replaced rule '%s' (%s, destination '%s')",
        F.lit(mode), "rule_name", "action", "destination")
    return decisions.withColumn("__moved", moved).withColumns({
        "reason": F.when(F.col("__moved"), why).otherwise(F.col("reason")),
        "matched_entities": F.when(F.col("__moved"), F.col("types")).otherwise(F.col("matched_entities")),
        "rule_name": F.when(F.col("__moved"), F.lit(f"local-routing:{mode}")).otherwise(F.col("rule_name")),
        "action": F.when(F.col("__moved"), F.lit("route_local")).otherwise(F.col("action")),
        "destination": F.when(F.col("__moved"), F.lit(fixed.LOCAL)).otherwise(F.col("destination")),
        "policy_version": F.concat("policy_version", F.lit(f"+local-routing:{mode}")),
    }).drop("__moved")


def routing_check(decisions: DataFrame, mode: str) -> DataFrame:
    """Decisions that should be local and are not; must be empty."""
    mode = _check_mode(mode)
    return decisions.where(
        _needs_local(mode) & (F.col("action") != "block") & (F.col("destination") != fixed.LOCAL)
    ).withColumn("code", F.lit("local_routing_violation"))


def base_vs_effective(facts: DataFrame, rules: DataFrame, mode: str) -> DataFrame:
    """The decision of the rules and the decision after the floor, side by side."""
    base = first_match(facts, rules)
    fields = ("action", "destination", "rule_name", "policy_version", "reason", "matched_entities")
    kept = base.withColumn("base", F.struct(*fields))
    final = routing_floor(kept, mode)
    return final.withColumn("effective", F.struct(*fields)).drop(*fields)


def decide(inspected: DataFrame, rules: DataFrame, mode: str = "off") -> DataFrame:
    """Effective decision per request of inspected messages."""
    return routing_floor(first_match(request_facts(inspected), rules), mode)


def required_destinations(rules: DataFrame, mode: str = "off") -> DataFrame:
    """Destinations a non-blocking decision can name under the mode."""
    mode = _check_mode(mode)
    local = rules.sparkSession.createDataFrame([(fixed.LOCAL,)], "destination string")
    if mode == "all":
        return local
    named = rules.where("action <> 'block'").selectExpr(
        "if(destination is null or destination = '', default_destination, destination) as destination").distinct()
    return named.union(local).distinct() if mode == "detected" else named


def missing_destinations(rules: DataFrame, configured: DataFrame, mode: str = "off") -> DataFrame:
    """Required destinations that are not configured."""
    return required_destinations(rules, mode).join(configured, "destination", "left_anti")


def rules_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A rule table from plain rows; missing fields take their defaults."""
    defaults = {
        "priority": 0, "destination": "", "entities": [], "applications": [], "min_score": 0.0,
        "version": "unversioned", "default_destination": "external",
    }
    full = [{**defaults, **r} for r in rows]
    names = [f.split()[0] for f in RULES_SCHEMA.split(", ")]
    return _local(spark, [{n: r[n] for n in names} for r in full])
