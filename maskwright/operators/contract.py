"""Contract checks on request records, JSON leaves, tools."""

from __future__ import annotations

import json
from collections.abc import Sequence
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import fixed


def _sql_list(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def validate_requests(df: DataFrame, json_col: str = "body") -> DataFrame:
    """Adds ``reason``: NULL for accepted records, else the first failure's code.

    Order: shape, stream flag, known fields that are refused, messages, the rest.
    """
    body = f"try_parse_json({json_col})"
    parsed = df.withColumn("__v", F.expr(body)).withColumn("__type", F.expr("schema_of_variant(__v)"))
    fields = F.expr("json_object_keys({0})".format(json_col))
    staged = parsed.withColumns({
        "__object": F.coalesce(F.col("__type").startswith("OBJECT"), F.lit(False)),
        "__keys": F.coalesce(fields, F.array().cast("array<string>")),
    })
    staged = staged.withColumns({
        "__stream": F.expr("schema_of_variant(variant_get(__v, '$.stream'))"),
        "__messages": F.expr("try_variant_get(__v, '$.messages', 'array<variant>')"),
    })
    kind = "schema_of_variant({0})"
    # json_object_keys gives the names of a message object without parsing its text
    texts = staged.withColumn("__m", F.expr(
        "transform(__messages, m -> named_struct('type', schema_of_variant(m), 'keys', "
        "coalesce(json_object_keys(to_json(m)), cast(array() as array<string>)), "
        "'role', try_variant_get(m, '$.role', 'string'), 'role_type', schema_of_variant(variant_get(m, '$.role')), "
        "'content_type', schema_of_variant(variant_get(m, '$.content'))))"
    ))
    checks = {
        "number": "DECIMAL|BIGINT|DOUBLE|FLOAT|INT", "integer": "BIGINT", "boolean": "BOOLEAN", "string": "STRING",
    }
    wrong = []
    for name, want in fixed.REQUEST_FIELDS.items():
        if want in ("array",):
            continue
        found = kind.format(f"variant_get(__v, '$.{name}')")
        if name == "model":
            wrong.append(f"coalesce({found}, 'VOID') <> 'STRING'")
        elif want == "tier":
            value = f"try_variant_get(__v, '$.{name}', 'string')"
            wrong.append(f"coalesce({found}, 'VOID') <> 'VOID' and "
                         f"({found} <> 'STRING' or {value} not in ({_sql_list(fixed.SERVICE_TIERS)}))")
        else:
            wrong.append(f"coalesce({found}, 'VOID') <> 'VOID' and not {found} rlike '^({checks[want]})'")
    truthy = (
        "case when __stream = 'BOOLEAN' then variant_get(__v, '$.stream', 'boolean') "
        "when __stream is null or __stream = 'VOID' then false "
        "when __stream = 'STRING' then variant_get(__v, '$.stream', 'string') <> '' "
        "when __stream rlike '^(BIGINT|DECIMAL|DOUBLE)' then variant_get(__v, '$.stream', 'double') <> 0 "
        "else to_json(variant_get(__v, '$.stream')) not in ('[]', '{}') end"
    )
    reason = f"""case
        when {json_col} is null or __v is null then 'invalid_json'
        when not __object then 'invalid_request'
        when {truthy} then 'streaming_unsupported'
        when arrays_overlap(__keys, array({_sql_list(fixed.REFUSED_FIELDS)})) then 'uninspectable_field'
        when exists(__m, m -> m.type like 'OBJECT%' and arrays_overlap(m.keys,
            array({_sql_list(fixed.REFUSED_MESSAGE_FIELDS)}))) then 'uninspectable_field'
        when exists(__m, m -> m.role_type = 'STRING' and m.role not in ({_sql_list(fixed.ROLES)}))
            then 'unsupported_role'
        when coalesce(schema_of_variant(variant_get(__v, '$.model')), 'VOID') <> 'STRING' then 'invalid_request'
        when __m is null or size(__m) not between 1 and {fixed.MAX_MESSAGES} then 'invalid_message'
        when exists(__m, m -> not m.type like 'OBJECT%') then 'invalid_message'
        when exists(__m, m -> coalesce(m.role_type, 'VOID') <> 'STRING') then 'unsupported_role'
        when exists(__m, m -> coalesce(m.content_type, 'VOID') <> 'STRING') then 'inspection_failed'
        when exists(__m, m -> size(array_except(m.keys, array('role', 'content'))) > 0) then 'unknown_field'
        when {' or '.join(f'({w})' for w in wrong)} then 'invalid_request'
        when size(array_except(__keys, array({_sql_list(list(fixed.REQUEST_FIELDS))}))) > 0 then 'unknown_field'
        end"""
    helpers = ("__v", "__type", "__object", "__keys", "__stream", "__messages", "__m")
    return texts.withColumn("reason", F.expr(reason)).drop(*helpers)


def project_allowed(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Only the listed columns, so that nothing unknown is passed on."""
    return df.select(*[f for f in fields if f in df.columns])


def cap_input_chars(msgs: DataFrame, cap: int = fixed.MAX_INPUT_CHARS) -> tuple[DataFrame, DataFrame]:
    """Messages of requests within the character cap, and the refused requests.

    Lengths are summed before the shuffle, and texts are not shuffled: only the
    few refused ids are joined back.
    """
    over = (
        msgs.groupBy("request_id").agg(F.sum(F.length("text")).alias("n_chars"))
        .where(F.col("n_chars") > cap).withColumn("reason", F.lit("inspection_failed"))
    )
    return msgs.join(over.select("request_id"), "request_id", "left_anti"), over


_LEAF = T.StructType([
    T.StructField("path", T.ArrayType(T.StringType())), T.StructField("json_path", T.ArrayType(T.StringType())),
    T.StructField("text", T.StringType()), T.StructField("structural", T.BooleanType()), T.StructField("reason", T.StringType())])
_LEAVES_ARROW = pa.list_(pa.struct([
    ("path", pa.list_(pa.string())), ("json_path", pa.list_(pa.string())), ("text", pa.string()),
    ("structural", pa.bool_()), ("reason", pa.string())]))


def _step(part) -> str:
    """Array positions are ``#n`` in a path; keys starting with ``#`` get one more."""
    return f"#{part}" if isinstance(part, int) else ("#" + part if part.startswith("#") else part)


def _key(step: str):
    return int(step[1:]) if step.startswith("#") and step[1:].isdigit() else step[1:] if step.startswith("##") else step


def _plain(path) -> str:
    return ".".join("*" if isinstance(p, int) else p for p in path)


def _children(node):
    if isinstance(node, dict):
        return list(node.items())
    return list(enumerate(node)) if isinstance(node, list) else []


def flatten_json_leaves(
    df: DataFrame, json_col: str = "body", content: Sequence[str] = (), encoded: Sequence[str] = (),
    numeric: Sequence[str] = (), key: str = "record_id",
) -> DataFrame:
    """One row per string leaf, object key and listed number of each record.

    ``content`` names the paths whose strings may be changed (``messages.*.content``;
    ``*`` is an array position), ``encoded`` the strings that hold JSON themselves,
    whose strings all are content, ``numeric`` the numbers to be inspected. Keys,
    numbers and all other strings are structural. A record that is not JSON, or has
    such an encoded string, is one row with ``reason`` and no text.
    """
    content, encoded, numeric = frozenset(content), frozenset(encoded), frozenset(numeric)

    def leaves(text: str):
        out = []
        stack = [(json.loads(text), (), None)]
        while stack:
            node, path, inner = stack.pop()
            here = _plain(path)
            if isinstance(node, (dict, list)):
                for part, child in reversed(_children(node)):
                    nxt = (path, inner + (part,)) if inner is not None else (path + (part,), None)
                    stack.append((child, *nxt))
                    if isinstance(part, str):
                        out.append((*nxt, part, True))
            elif isinstance(node, str):
                if inner is None and here in encoded:
                    stack.append((json.loads(node), path, ()))
                else:
                    out.append((path, inner, node, inner is None and here not in content))
            elif not isinstance(node, bool) and node is not None and (inner is not None or here in numeric):
                out.append((path, inner, str(node) if isinstance(node, int) else format(Decimal(str(node)), "f"), True))
        return [
            {"path": [_step(p) for p in path], "json_path": None if inner is None else [_step(p) for p in inner],
             "text": value, "structural": fixed_part, "reason": None}
            for path, inner, value, fixed_part in out
        ]

    def safe(text: str):
        try:
            return leaves(text)
        except (ValueError, RecursionError):
            return [{"path": None, "json_path": None, "text": None, "structural": True, "reason": "invalid_json"}]

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else safe(t) for t in texts.to_pylist()], _LEAVES_ARROW)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    others = [c for c in df.columns if c != json_col]
    return df.select(*others, F.posexplode(F.arrow_udf(run, T.ArrayType(_LEAF))(F.col(json_col))).alias("leaf", "__l")).select(
        *others, "leaf", "__l.*")


_EDIT = T.ArrayType(T.StructType([
    T.StructField("path", T.ArrayType(T.StringType())), T.StructField("json_path", T.ArrayType(T.StringType())),
    T.StructField("text", T.StringType())]))


@F.arrow_udf(T.StringType())
def _edited(texts: pa.Array, edits: pa.Array) -> pa.Array:
    def put(node, path, value):
        for part in path[:-1]:
            node = node[_key(part)]
        node[_key(path[-1])] = value

    def get(node, path):
        for part in path:
            node = node[_key(part)]
        return node

    def dump(node):
        return json.dumps(node, ensure_ascii=False, separators=(",", ":"))

    def apply(text, changes):
        if text is None or not changes:
            return text
        root = json.loads(text)
        for change in changes:
            if change["json_path"] is None:
                put(root, change["path"], change["text"])
            elif not change["json_path"]:
                put(root, change["path"], dump(change["text"]))
            else:
                inner = json.loads(get(root, change["path"]))
                put(inner, change["json_path"], change["text"])
                put(root, change["path"], dump(inner))
        return dump(root)

    return pa.array([apply(t, e) for t, e in zip(texts.to_pylist(), edits.to_pylist())], pa.string())


def replace_json_leaves(
    df: DataFrame, locations: DataFrame, json_col: str = "body", key: str = "record_id"
) -> DataFrame:
    """Puts changed leaves back into their records, JSON inside strings included.

    The leaves of one record are grouped, which the record's size bounds.
    Structural leaves must not be among them.
    """
    edits = locations.where("not structural").groupBy(key).agg(
        F.collect_list(F.struct("path", "json_path", "text")).cast(_EDIT).alias("__edits"))
    return df.join(edits, key, "left").withColumn(
        json_col, _edited(F.col(json_col), F.coalesce("__edits", F.array().cast(_EDIT)))).drop("__edits")


def refuse_structural_hits(
    locations: DataFrame, spans: DataFrame, key: str = "record_id"
) -> tuple[DataFrame, DataFrame]:
    """Locations of clean records, and records with a span where nothing may change or without JSON."""
    fixed_parts = locations.where("structural").select(key, "leaf")
    hit = spans.join(fixed_parts, [key, "leaf"], "left_semi").select(key).distinct()
    refused = hit.withColumn("reason", F.lit("sensitive_structure")).unionByName(
        locations.where("reason is not null").select(key, "reason").distinct())
    return locations.join(refused.select(key), key, "left_anti"), refused


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


@F.arrow_udf(T.StringType())
def _tree_violation(texts: pa.Array) -> pa.Array:
    def check(text):
        stack = [(json.loads(text, parse_constant=_no_constant), 0)]
        while stack:
            node, depth = stack.pop()
            if depth > fixed.MAX_JSON_DEPTH or len(_children(node)) > fixed.MAX_JSON_ENTRIES:
                return "request_too_large"
            if isinstance(node, str) and any(0xD800 <= ord(c) <= 0xDFFF for c in node):
                return "invalid_json"
            for part, child in _children(node):
                stack.append((child, depth + 1))
                if isinstance(part, str):
                    stack.append((part, depth + 1))
        return None

    def safe(text):
        if text is None:
            return None
        try:
            return check(text)
        except (ValueError, RecursionError):
            return "invalid_json"

    return pa.array([safe(t) for t in texts.to_pylist()], pa.string())


def json_bounds(df: DataFrame, json_col: str = "body") -> DataFrame:
    """Adds ``violation``: too many bytes, not JSON (duplicate keys and NaN
    included), or nested or filled beyond the limits; NULL if none.

    A record that is short, and has no more brackets than the depth limit and no
    more separators than the entry limit, needs no look at its tree. NaN may be a
    word of a string, so a record with it is judged by its tree.
    """
    col = F.col(json_col)
    parses = F.expr(f"try_parse_json({json_col})").isNotNull()
    small = (
        ~col.rlike("NaN|Infinity") &
        (F.regexp_count(col, F.lit(r"[\[{]")) <= fixed.MAX_JSON_DEPTH)
        & (F.regexp_count(col, F.lit(",")) < fixed.MAX_JSON_ENTRIES)
        & ~col.contains("\\u")
    )
    staged = df.withColumns({"__bytes": F.octet_length(col), "__ok": parses})
    tree = _tree_violation(F.when((F.col("__bytes") <= fixed.MAX_JSON_BYTES) & F.col("__ok") & ~small, col))
    return staged.withColumn("__tree", tree).withColumn(
        "violation",
        F.when(F.col("__bytes") > fixed.MAX_JSON_BYTES, "request_too_large")
        .when(~F.coalesce("__ok", F.lit(False)), "invalid_json")
        .otherwise(F.col("__tree")),
    ).drop("__bytes", "__ok", "__tree")


def model_allowed(requests: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests whose key permits the model, and the refused ones.

    An empty set of models permits all of them.
    """
    joined = requests.join(keys.select("api_key_id", "allowed_models"), "api_key_id", "left")
    ok = F.coalesce(
        (F.size("allowed_models") == 0) | F.array_contains("allowed_models", F.col("model")), F.lit(False))
    judged = joined.withColumn("__ok", ok).drop("allowed_models")
    return (
        judged.where("__ok").drop("__ok"),
        judged.where("not __ok").drop("__ok").withColumn("reason", F.lit("model_not_allowed")),
    )


def tool_call_pairing(blocks: DataFrame) -> DataFrame:
    """``(request_id, id, problem)`` of call and result blocks that do not pair.

    ``blocks``: ``(request_id, pos, kind call|result, tool_kind, id)``. An id is
    used by one call; a result follows exactly one call of its kind, once. All
    rules are read off per-id positions, so no pairs are formed.
    """
    per_id = blocks.groupBy("request_id", "id").agg(
        F.count_if(F.col("kind") == "call").alias("calls"),
        F.count_if(F.col("kind") == "result").alias("results"),
        F.min(F.when(F.col("kind") == "call", F.struct("pos", "tool_kind"))).alias("call"),
        F.min(F.when(F.col("kind") == "result", F.col("pos"))).alias("first_result"),
        F.min(F.when(F.col("kind") == "result", F.col("tool_kind"))).alias("kind_a"),
        F.max(F.when(F.col("kind") == "result", F.col("tool_kind"))).alias("kind_b"),
    )
    cases = {
        "duplicate_call": F.col("calls") > 1,
        "orphan_result": (F.col("calls") == 0) & (F.col("results") > 0),
        "result_before_call": (F.col("calls") > 0) & (F.col("first_result") < F.col("call.pos")),
        "wrong_kind": (F.col("calls") > 0) & ((F.col("kind_a") != F.col("call.tool_kind")) | (F.col("kind_b") != F.col("call.tool_kind"))),
        "reused_result": F.col("results") > 1,
    }
    problems = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in cases.items()]), lambda p: p.isNotNull())
    return per_id.select("request_id", "id", F.explode(problems).alias("problem"))


def tool_declarations(tools: DataFrame, choices: DataFrame) -> DataFrame:
    """``(request_id, name, problem)``: names declared twice, and selected tools that
    are not declared with the same type.

    ``tools``: ``(request_id, name, type)``; ``choices``: the same columns.
    """
    twice = tools.groupBy("request_id", "name").count().where("count > 1").select(
        "request_id", "name", F.lit("duplicate_tool").alias("problem"))
    missing = choices.join(tools.select("request_id", "name", "type").distinct(), ["request_id", "name", "type"], "left_anti").select(
        "request_id", "name", F.lit("undeclared_choice").alias("problem"))
    return twice.unionByName(missing)


def strip_attribution(df: DataFrame, columns: Sequence[str] = ("client_metadata", "user", "metadata", "prompt_cache_key")) -> DataFrame:
    """Without client metadata; a cache key is replaced by the scoped one."""
    from maskwright.operators.tokens import scoped_cache_key

    scoped = {"protocol", "model", "destination", "policy_version", "identity"} <= set(df.columns)
    keyed = scoped_cache_key(df) if scoped and "prompt_cache_key" in df.columns else df
    return keyed.drop(*columns)
