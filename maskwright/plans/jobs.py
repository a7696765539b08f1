"""Whole jobs: pseudonymise requests, restore replies, evaluate, preview."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions import fixed
from maskwright.operators import audit as audit_ops
from maskwright.operators import evaluate as ev
from maskwright.operators.contract import cap_input_chars, flatten_json_leaves, replace_json_leaves
from maskwright.operators.detectors import BUILTIN, Detector
from maskwright.operators.inspect import inspect, quarantine
from maskwright.operators.policy import base_vs_effective, decide, request_facts
from maskwright.operators.restore import (
    REPLY_KEYS, classify_tokens, minted_here, output_budget, restore_atomic, restore_counts, restore_text, scan_tokens,
)
from maskwright.operators.tokens import mint_tokens, replace_spans, token_collisions, with_tokens
from maskwright.operators.vault import SCOPE, vault_collisions, vault_put
from maskwright.session import materialize
from maskwright.sources.vault_store import read_vault


def pseudonymize(
    msgs: DataFrame, rules: DataFrame, token_keys: DataFrame, vault_keys: DataFrame, as_of, *,
    key_version: int = 1, ttl_seconds: int = 3600, mode: str = "off",
    detectors: Sequence[Detector] = BUILTIN, max_chars: int | None = None, block_mixed: bool = False,
    earlier: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Request side: ``text``, ``prov``, ``vault``, ``decisions``, ``refused`` and ``audit``.

    Detection is written once, without the texts being shuffled; every later step
    works on ids, spans and tokens. Requests refused or blocked have no text; those
    allowed keep theirs; a transform replaces all spans of the request. ``earlier`` gives the
    vault rows of the tokens of a provenance table: a token that stands for another value there is refused as well.
    """
    every = msgs
    if max_chars is not None:
        msgs, too_long = cap_input_chars(msgs, max_chars)
    inspected = materialize(inspect(msgs, detectors, block_mixed), "inspected")
    refused = quarantine(inspected).select("request_id", "reason")
    if max_chars is not None:
        refused = refused.unionByName(too_long.select("request_id", "reason"))
    decisions = materialize(decide(inspected, rules, mode), "decisions")
    acted = decisions.where("action in ('allow', 'transform', 'route_local')").join(refused, "request_id", "left_anti").select("request_id", "action")
    # one join of the texts with their decisions; what is allowed has nothing to replace
    treated = inspected.join(acted, "request_id").withColumn("spans", F.when(F.col("action") != "allow", F.col("spans"))).drop("action")
    replaced = materialize(with_tokens(treated, token_keys), "tokens")
    columns = ["request_id", "tenant_id", "conversation_id", "idx", "role", "text"]
    text = replace_spans(replaced).select(*columns)
    prov = materialize(mint_tokens(replaced), "prov")
    if token_collisions(prov).head(1):
        raise ValueError("two values share a token; nothing may be written")
    if earlier is not None and vault_collisions(prov, earlier(prov), vault_keys, as_of).head(1):
        raise ValueError("a token stands for another value in the vault; nothing may be written")
    vault = materialize(vault_put(prov, vault_keys, as_of, ttl_seconds, key_version), "vault")
    # one event for every request that came in, however it ended
    ids = every.groupBy("request_id").agg(
        *[F.first(c).alias(c) for c in ("tenant_id", "conversation_id", "api_key_id", "application")]
    ).withColumn("active_version", rules.select(F.max("version")).scalar())
    events = ids.join(refused.withColumnRenamed("reason", "error"), "request_id", "left")
    blocked = decisions.where("action = 'block'").select("request_id", F.lit("blocked_by_policy").alias("__blocked"))
    events = events.join(blocked, "request_id", "left").withColumn("error", F.coalesce("error", "__blocked")).drop("__blocked")
    audit = audit_ops.build_audit(events, inspected, decisions, None, as_of)
    return {"text": text, "prov": prov, "vault": vault, "decisions": decisions, "refused": refused,
            "audit": audit, "inspected": inspected, "tokens": replaced}


def _asked(found: DataFrame, prov: DataFrame, vault: DataFrame | str) -> DataFrame:
    """The vault rows that the tokens of replies may need: a table as it is, a stored vault by their scopes."""
    if isinstance(vault, DataFrame):
        return vault
    own = minted_here(found.select("request_id", "token").distinct(), prov).where("minted")
    return read_vault(found.sparkSession, vault, materialize(own.select(*SCOPE).distinct(), "asked"))


def restore(
    replies: DataFrame, prov: DataFrame, vault: DataFrame | str, vault_keys: DataFrame, as_of,
    cap: int = fixed.MAX_RESTORED_BYTES, keys: Sequence[str] = REPLY_KEYS,
) -> dict[str, DataFrame]:
    """Reply side: restored ``text``, token ``outcomes``, ``counts`` per request, ``refused``.

    ``vault`` is a table or the path of a stored one, of which only the tokens of the replies are looked up.
    """
    found = scan_tokens(replies, keys)
    if isinstance(vault, str):
        found = materialize(found, "found")
    outcomes = materialize(classify_tokens(found, prov, _asked(found, prov, vault), vault_keys, as_of), "outcomes")
    kept, refused = output_budget(restore_text(replies, outcomes, keys), cap)
    return {"text": kept, "outcomes": outcomes, "counts": restore_counts(outcomes), "refused": refused}


def restore_arguments(
    calls: DataFrame, prov: DataFrame, vault: DataFrame | str, vault_keys: DataFrame, as_of, keys: Sequence[str] = REPLY_KEYS,
) -> dict[str, DataFrame]:
    """Tool calls whose ``text`` is JSON: strings restored inside it, or the whole call refused.

    ``text`` has ``refusal`` beside it, NULL for restored calls, whose text stays valid JSON.
    """
    keys = list(keys)
    records = calls.withColumn("record_id", F.to_json(F.struct(*keys)))
    wrapped = records.select("record_id", "request_id", F.to_json(F.struct(F.col("text").alias("arguments"))).alias("body"))
    leaves = materialize(flatten_json_leaves(wrapped, encoded=("arguments",)), "arguments")
    # the wrapper's own key is no part of the call
    leaves = leaves.where("json_path is not null or reason is not null")
    found = scan_tokens(leaves, ("request_id", "record_id", "leaf"))
    outcomes = materialize(classify_tokens(found, prov, _asked(found, prov, vault), vault_keys, as_of), "outcomes")
    done, refused = restore_atomic(leaves, outcomes)
    refused = materialize(refused, "refused")
    kept = wrapped.join(refused.select("record_id"), "record_id", "left_anti")
    touched = done.drop("request_id").join(outcomes.select("record_id", "leaf").distinct(), ["record_id", "leaf"], "left_semi")
    whole = replace_json_leaves(kept, touched).select("record_id", F.get_json_object("body", "$.arguments").alias("__text"))
    text = records.join(whole, "record_id", "left").join(refused.select("record_id", F.col("reason").alias("refusal")), "record_id", "left")
    text = text.withColumn("text", F.when(F.col("refusal").isNull(), F.col("__text"))).drop("__text", "record_id")
    return {"text": text, "outcomes": outcomes}


def predict(examples: DataFrame, detectors: Sequence[Detector] = BUILTIN) -> DataFrame:
    """Predicted spans of examples; a span that does not map back counts as a miss."""
    from maskwright.operators.detectors import detect_all
    from maskwright.operators.view import map_spans

    return map_spans(detect_all(examples.select("id", "text"), detectors)).select("id", F.inline("spans"))


def evaluate(examples: DataFrame, detectors: Sequence[Detector] = BUILTIN, aliased: bool = False) -> dict[str, DataFrame]:
    """Headline, adversarial and known-gap scores, failures, and the threshold gate."""
    gold, pred = ev.gold_spans(examples), predict(examples, detectors)
    if aliased:
        gold, pred = ev.alias_labels(gold), ev.alias_labels(pred)
    outcomes = materialize(ev.match_spans(gold, pred, examples), "outcomes")
    scores = {
        name: ev.precision_recall_f1(ev.score_buckets(ev.split_by_kind(outcomes, kinds)))
        for name, kinds in (("headline", fixed.SCORED_KINDS), ("adversarial", ("adversarial",)), ("known_gap", ("known_gap",)))
    }
    headline = ev.split_by_kind(outcomes)
    return {**scores, "failures": ev.failure_list(headline),
            "gate": ev.threshold_gate(scores["headline"], ev.thresholds_frame(examples.sparkSession)),
            "overall": ev.overall(scores["headline"])}


def preview(
    msgs: DataFrame, rules: DataFrame, token_keys: DataFrame, mode: str = "off",
    detectors: Sequence[Detector] = BUILTIN,
) -> DataFrame:
    """Per text what would happen, without writing a vault."""
    inspected = materialize(inspect(msgs, detectors), "preview")
    decisions = base_vs_effective(request_facts(inspected), rules, mode)
    return audit_ops.preview_table(with_tokens(inspected, token_keys), decisions)
