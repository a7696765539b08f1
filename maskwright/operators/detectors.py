"""Detectors as columns, and the table operators that run them.

A detector is a list of stages. Each stage is given the text and the columns of
the stages before it and returns new columns; the last one returns ``spans``.
All detectors of a run share the stages, so a table is read once, every regular
expression runs once per text, and offsets and checksums are computed only for
texts with a candidate.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import checks, fixed
from maskwright.functions.arrays import MATCHES, fence, find_all, let, locate, raw
from maskwright.operators.resolve import SPANS_TYPE, resolve_spans
from maskwright.operators.view import detection_view

# stage(text, columns so far) -> new columns; all are Spark SQL text
Stage = Callable[[str, dict[str, str]], dict[str, str]]


@dataclass(frozen=True)
class Detector:
    """A named detector: its entity types, the view it reads, and its stages.

    ``prepare``, where given, adds columns to the table before the first stage.
    """

    name: str
    entity_types: tuple[str, ...]
    stages: tuple[Stage, ...]
    folded: bool = True
    kind: str = "builtin"
    prepare: Callable[[DataFrame, str], DataFrame] | None = field(default=None, compare=False)


def _spans(matches: str, entity_type: str, score: float | str, detector: str) -> str:
    """Spans of an array of matches ``m``; type, score and detector are SQL text."""
    return (
        f"transform({matches}, m -> named_struct('start', cast(m.start as int), 'end', cast(m.end as int), "
        f"'entity_type', {entity_type}, 'text', m.text, 'score', cast({score} as double), 'detector', {detector}))"
    )


def _found(matches: str, build: str) -> str:
    """``build`` for texts with a match, else NULL; keeps the costly part rare."""
    return f"case when size({matches}) > 0 then {build} end"


def _contains_any(literals: Sequence[str], text: str) -> str:
    return "(" + " or ".join(f"contains({text}, '{x}')" for x in literals) + ")"


def _has_digit(text: str) -> str:
    """Cheap gate of the number detectors; most texts of a corpus stop here."""
    return f"{text} rlike {raw(fixed.DIGIT)}"


def _gated(gate: str, value: str) -> str:
    return f"case when {gate} then {value} end"


def pattern_detector(
    name: str, entity_type: str, pattern: str, score: float, guard: Callable[[str], str] | None = None,
    detector: str | None = None, folded: bool = True, kind: str = "builtin",
) -> Detector:
    """A detector whose every match is a span."""

    def matches(text: str, _: dict[str, str]) -> dict[str, str]:
        hits = find_all(text, pattern)
        return {"m": _gated(guard(text), hits) if guard else hits}

    def spans(text: str, cols: dict[str, str]) -> dict[str, str]:
        return {"spans": _found(cols["m"], _spans(
            locate(text, pattern, cols["m"]), f"'{entity_type}'", score, f"'{detector or name}'"))}

    return Detector(name, (entity_type,), (matches, spans), folded, kind)


# --- e-mail -----------------------------------------------------------------
def _email_matches(text: str, _: dict[str, str]) -> dict[str, str]:
    return {"m": _gated(f"contains({text}, '@')", find_all(text, fixed.EMAIL_CANDIDATE))}


def _email_spans(text: str, cols: dict[str, str]) -> dict[str, str]:
    # The address ends with the last label that is a top-level domain and has
    # only well-formed labels before it.
    labels = r"split(substring_index(m.text, '@', -1), r'\.', -1)"
    usable = (
        f"coalesce(nullif(array_position(transform(labels, x -> x rlike {raw(fixed.EMAIL_LABEL)}), false), 0) - 1, "
        "size(labels))"
    )
    last = (
        f"array_max(transform(labels, (x, i) -> if(i >= 1 and i < {usable} and x rlike {raw(fixed.EMAIL_TLD)}, "
        "i, null)))"
    )
    address = let("labels", labels, let("tld", last,
                  "if(tld is null, null, concat(substring_index(m.text, '@', 1), '@', "
                  "array_join(slice(labels, 1, tld + 1), '.')))"))
    cut = (
        f"filter(transform({locate(text, fixed.EMAIL_CANDIDATE, cols['m'])}, m -> named_struct('start', m.start, "
        f"'text', {address})), m -> m.text is not null)"
    )
    ended = f"transform({cut}, m -> named_struct('start', m.start, 'end', m.start + length(m.text), 'text', m.text))"
    return {"spans": _found(cols["m"], _spans(ended, "'EMAIL_ADDRESS'", fixed.CERTAIN, "'email'"))}


EMAIL = Detector("email", ("EMAIL_ADDRESS",), (_email_matches, _email_spans))


# --- bank accounts ----------------------------------------------------------
def _iban_matches(text: str, _: dict[str, str]) -> dict[str, str]:
    return {"m": _gated(_has_digit(text), find_all(text, fixed.IBAN_CANDIDATE))}


def _iban_spans(text: str, cols: dict[str, str]) -> dict[str, str]:
    # The longest run of whole groups that passes the checksum.
    prefixes = "transform(sequence(1, size(groups)), n -> array_join(slice(groups, 1, n), ' '))"
    valid = f"filter({prefixes}, p -> {let('plain', checks.ascii_digits('p'), checks.iban_ok('plain'))})"
    account = let("groups", "split(m.text, ' ', -1)", let("valid", valid, "get(valid, size(valid) - 1)"))
    cut = (
        f"filter(transform({locate(text, fixed.IBAN_CANDIDATE, cols['m'])}, m -> named_struct('start', m.start, "
        f"'text', {account})), m -> m.text is not null)"
    )
    ended = f"transform({cut}, m -> named_struct('start', m.start, 'end', m.start + length(m.text), 'text', m.text))"
    return {"spans": _found(cols["m"], _spans(ended, "'IBAN'", fixed.CERTAIN, "'iban'"))}


IBAN = Detector("iban", ("IBAN",), (_iban_matches, _iban_spans))


# --- cards ------------------------------------------------------------------
def _card_matches(text: str, _: dict[str, str]) -> dict[str, str]:
    return {"m": _gated(_has_digit(text), find_all(text, fixed.CARD_CANDIDATE))}


def _card_spans(text: str, cols: dict[str, str]) -> dict[str, str]:
    valid = let("digits", f"translate({checks.ascii_digits('m.text')}, ' -', '')",
                f"length(digits) between {fixed.CARD_MIN} and {fixed.CARD_MAX} and luhn_check(digits)")
    kept = f"filter({locate(text, fixed.CARD_CANDIDATE, cols['m'])}, m -> {valid})"
    return {"spans": _found(cols["m"], _spans(kept, "'PAYMENT_CARD'", fixed.CERTAIN, "'payment_card'"))}


CARD = Detector("payment_card", ("PAYMENT_CARD",), (_card_matches, _card_spans))

IPV4 = pattern_detector("ip_address", "IP_ADDRESS", fixed.IPV4, fixed.MEDIUM, _has_digit)

# --- credentials ------------------------------------------------------------
SECRET_DETECTORS = {
    entity: pattern_detector(
        f"secrets:{entity}", entity, pattern, fixed.CERTAIN, partial(_contains_any, literals), "secrets")
    for entity, literals, pattern in fixed.SECRETS
}


# --- national personal codes ------------------------------------------------
def _code_matches(text: str, _: dict[str, str], forms: Sequence[str] = ("hyphenated", "plain")) -> dict[str, str]:
    found = {
        "hyphenated": _gated(f"{_has_digit(text)} and contains({text}, '-')", find_all(text, fixed.LV_HYPHENATED)),
        "plain": _gated(_has_digit(text), find_all(text, fixed.ELEVEN_DIGITS)),
    }
    return {form: found[form] for form in forms}


def country_marks(text: str) -> str:
    """Which countries a document points at; one look per document."""
    return (
        f"named_struct('lt', {text} rlike {raw(fixed.LT_MARKERS)}, 'ee', {text} rlike {raw(fixed.EE_MARKERS)}, "
        f"'lv', {text} rlike {raw(fixed.LV_MARKERS)})"
    )


def name_window(text: str, start: str, size: int = fixed.NAME_WINDOW) -> str:
    """The ``size`` characters before ``start``, in lower case."""
    return f"lower(substr({text}, greatest({start} - {size}, 0) + 1, least({start}, {size})))"


def infer_country_sql(window: str, marks: str) -> str:
    """LT, EE or NULL: the nearest identifier name before the code, else the
    document's marks when exactly one of the two countries is indicated."""
    names = "|".join(re.escape(n) for n in fixed.LT_NAMES + fixed.EE_NAMES)
    ee = ", ".join(f"'{n}'" for n in fixed.EE_NAMES)
    nearest = f"regexp_extract({window}, {raw(rf'(?s)^.*({names})')}, 1)"
    return let("named", nearest, (
        f"case when named in ({ee}) then 'EE' when named <> '' then 'LT' "
        f"when {marks}.lt and not {marks}.ee then 'LT' when {marks}.ee and not {marks}.lt then 'EE' end"))


def _code_context(text: str, cols: dict[str, str]) -> dict[str, str]:
    return {"marks": f"case when size({cols['plain']}) > 0 then {country_marks(text)} end"}


def _hyphenated_spans(text: str, cols: dict[str, str]) -> str:
    bare = let("digits", f"translate({checks.ascii_digits('m.text')}, '-', '')", checks.lv_ok("digits"))
    return _spans(
        f"filter({locate(text, fixed.LV_HYPHENATED, cols['hyphenated'])}, "
        f"m -> startswith(m.text, '32') or {bare})",
        "'LV_PERSONAL_CODE'", f"if(startswith(m.text, '32'), {fixed.MEDIUM}, {fixed.CERTAIN})", "'lv_personal_code'")


def _plain_spans(text: str, cols: dict[str, str]) -> str:
    judged = let("digits", checks.ascii_digits("m.text"), (
        "named_struct('start', m.start, 'end', m.end, 'text', m.text, "
        f"'lv', {checks.lv_ok('digits')}, 'lt_ee', {checks.lt_ee_ok('digits')})"))
    valid = (
        f"filter(transform({locate(text, fixed.ELEVEN_DIGITS, cols['plain'])}, m -> {judged}), m -> m.lv or m.lt_ee)"
    )
    marks = cols["marks"]
    latvian = " or ".join(f"contains(near, '{n}')" for n in fixed.LV_NAMES)
    label = let("near", name_window(text, "m.start"), let("country", infer_country_sql("near", marks), (
        f"case when m.lv and (not m.lt_ee or (country is null and ({latvian} or {marks}.lv))) "
        "then 'LV_PERSONAL_CODE' when m.lt_ee and m.text rlike '^[1-6]' "
        "then concat(coalesce(country, 'BALTIC'), '_PERSONAL_CODE') end")))
    labelled = (
        f"filter(transform({valid}, m -> named_struct('start', m.start, 'end', m.end, 'text', m.text, "
        f"'label', {label})), m -> m.label is not null)"
    )
    return _spans(labelled, "m.label", fixed.CERTAIN,
                  "if(m.label = 'LV_PERSONAL_CODE', 'lv_personal_code_plain', 'baltic_personal_code')")


def _code_spans(text: str, cols: dict[str, str]) -> dict[str, str]:
    """Spans of the forms that were looked for."""
    built = {form: build(text, cols) for form, build in (("hyphenated", _hyphenated_spans), ("plain", _plain_spans)) if form in cols}
    empty = f"cast(array() as {SPANS_TYPE})"
    some = " or ".join(f"size({cols[form]}) > 0" for form in built)
    parts = ", ".join(f"coalesce({_found(cols[form], spans)}, {empty})" for form, spans in built.items())
    return {"spans": f"case when {some} then concat({parts}) end"}


PERSONAL_CODES = Detector(
    "baltic_personal_codes",
    ("LV_PERSONAL_CODE", "LT_PERSONAL_CODE", "EE_PERSONAL_CODE", "BALTIC_PERSONAL_CODE"),
    (_code_matches, _code_context, _code_spans),
)
LV_HYPHENATED = Detector("lv_personal_code", ("LV_PERSONAL_CODE",), (partial(_code_matches, forms=("hyphenated",)), _code_spans))
PLAIN_CODES = Detector(
    "plain_personal_codes", PERSONAL_CODES.entity_types, (partial(_code_matches, forms=("plain",)), _code_context, _code_spans))


# --- telephone numbers ------------------------------------------------------
def _phone_matches(text: str, _: dict[str, str]) -> dict[str, str]:
    return {
        "intl": _gated(f"contains({text}, '+')", find_all(text, fixed.PHONE_INTERNATIONAL)),
        "nat": _gated(_has_digit(text), find_all(text, fixed.PHONE_NATIONAL)),
    }


def _fits(number: str, plan: tuple[str, tuple[int, ...]]) -> str:
    first, lengths = plan
    return f"(length({number}) in ({', '.join(map(str, lengths))}) and {number} rlike '^[{first}]')"


def _phone_claims(text: str, cols: dict[str, str]) -> dict[str, str]:
    pattern, separator = raw(fixed.PHONE_INTERNATIONAL), raw(fixed.PHONE_SEPARATOR)
    plans = " ".join(f"when code = '{dial}' then {_fits('rest', p)}" for dial, p in fixed.PHONE_PLANS.items())
    low, high = fixed.PHONE_OTHER_LENGTHS
    ok = let("code", f"regexp_extract(m.text, {pattern}, 1)", let(
        "rest", f"regexp_replace(regexp_extract(m.text, {pattern}, 2), {separator}, '')",
        f"case {plans} else length(rest) between {low} and {high} end"))
    accepted = f"filter({locate(text, fixed.PHONE_INTERNATIONAL, cols['intl'])}, m -> {ok})"
    return {"claimed": f"case when size({cols['intl']}) > 0 then {accepted} else cast(array() as {MATCHES}) end"}


def _phone_spans(text: str, cols: dict[str, str]) -> dict[str, str]:
    separator = raw(fixed.PHONE_SEPARATOR)
    words = raw("|".join(fixed.PHONE_WORDS))
    plan = " or ".join(_fits("number", p) for p in fixed.PHONE_PLANS.values())
    ok = let("number", f"regexp_replace(m.text, {separator}, '')", (
        f"({plan}) and not exists({cols['claimed']}, c -> c.start <= m.start and m.start < c.end) "
        f"and {name_window(text, 'm.start', fixed.PHONE_WINDOW)} rlike {words}"))
    national = f"filter({locate(text, fixed.PHONE_NATIONAL, cols['nat'])}, m -> {ok})"
    empty = f"cast(array() as {SPANS_TYPE})"
    return {"spans": (
        f"case when size({cols['claimed']}) > 0 or size({cols['nat']}) > 0 then concat("
        f"{_spans(cols['claimed'], quoted_phone, fixed.CERTAIN, quoted_name)}, "
        f"coalesce({_found(cols['nat'], _spans(national, quoted_phone, fixed.HIGH, quoted_name))}, {empty})) end")}


quoted_phone, quoted_name = "'PHONE_NUMBER'", "'phone_number'"
PHONE = Detector("phone_number", ("PHONE_NUMBER",), (_phone_matches, _phone_claims, _phone_spans))

BUILTIN = (*SECRET_DETECTORS.values(), EMAIL, PERSONAL_CODES, PHONE, IBAN, CARD, IPV4)


# --- running ----------------------------------------------------------------
def _run(df: DataFrame, detectors: Sequence[Detector], pick: Callable[[Detector], str]) -> DataFrame:
    """Adds ``found``, the concatenated spans of all detectors."""
    if not detectors:
        raise ValueError("no detector is enabled")
    for d in detectors:
        if d.prepare is not None:
            df = d.prepare(df, pick(d))
    state: list[dict[str, str]] = [{} for _ in detectors]
    for depth in range(max(len(d.stages) for d in detectors)):
        new: dict[str, str] = {}
        for i, d in enumerate(detectors):
            if depth < len(d.stages):
                for key, sql in d.stages[depth](pick(d), state[i]).items():
                    new[f"__d{i}_{key}"] = sql
        df = df.selectExpr("*", *[f"{sql} as {name}" for name, sql in new.items()])
        for name in new:
            i, key = re.match(r"__d(\d+)_(.*)", name).groups()
            state[int(i)][key] = name
    found = [s["spans"] for s in state]
    empty = f"cast(array() as {SPANS_TYPE})"
    merged = ", ".join(f"coalesce({f}, {empty})" for f in found)
    kept = [f"`{c}`" for c in df.columns if not c.startswith("__d")]
    spans = f"case when coalesce({', '.join(found)}) is null then {empty} else concat({merged}) end"
    return df.selectExpr(*kept, f"{fence(spans)} as found")


def detect_view(df: DataFrame, detectors: Sequence[Detector] = BUILTIN) -> DataFrame:
    """Runs detectors over the view, each on the view it reads; adds ``found``."""
    return _run(df, detectors, lambda d: "view_folded" if d.folded else "view_text")


def span_columns(df: DataFrame, detectors: Sequence[Detector], text: str = "text") -> DataFrame:
    """Adds ``found`` for detectors read on a plain text column."""
    return _run(df, detectors, lambda _: text)


def explode_spans(df: DataFrame, spans: str, *keys: str) -> DataFrame:
    """One row per span, with the key columns."""
    return df.select(*keys, F.explode(spans).alias("__s")).select(*keys, "__s.*")


def _keys(msgs: DataFrame) -> list[str]:
    return [c for c in msgs.columns if c not in ("text", "role")]


def detect_with(msgs: DataFrame, detectors: Sequence[Detector]) -> DataFrame:
    """Span table of ``detectors`` on the text as it is."""
    keys = _keys(msgs)
    return explode_spans(span_columns(msgs, detectors), "found", *keys)


def detect_email(msgs: DataFrame) -> DataFrame:
    """E-mail addresses."""
    return detect_with(msgs, [EMAIL])


def detect_iban(msgs: DataFrame) -> DataFrame:
    """Bank account numbers with a valid checksum."""
    return detect_with(msgs, [IBAN])


def detect_card(msgs: DataFrame) -> DataFrame:
    """Payment cards: card-shaped and Luhn-valid."""
    return detect_with(msgs, [CARD])


def detect_ipv4(msgs: DataFrame) -> DataFrame:
    """IPv4 addresses."""
    return detect_with(msgs, [IPV4])


def detect_aws_key(msgs: DataFrame) -> DataFrame:
    """AWS access key ids."""
    return detect_with(msgs, [SECRET_DETECTORS["AWS_ACCESS_KEY"]])


def detect_private_key(msgs: DataFrame) -> DataFrame:
    """PEM private key blocks."""
    return detect_with(msgs, [SECRET_DETECTORS["PRIVATE_KEY"]])


def detect_jwt(msgs: DataFrame) -> DataFrame:
    """JSON web tokens."""
    return detect_with(msgs, [SECRET_DETECTORS["JWT"]])


def detect_openai_key(msgs: DataFrame) -> DataFrame:
    """``sk-`` keys."""
    return detect_with(msgs, [SECRET_DETECTORS["OPENAI_API_KEY"]])


def detect_anthropic_key(msgs: DataFrame) -> DataFrame:
    """``sk-ant-`` keys."""
    return detect_with(msgs, [SECRET_DETECTORS["ANTHROPIC_API_KEY"]])


def detect_github_token(msgs: DataFrame) -> DataFrame:
    """GitHub tokens."""
    return detect_with(msgs, [SECRET_DETECTORS["GITHUB_TOKEN"]])


def detect_slack_token(msgs: DataFrame) -> DataFrame:
    """Slack tokens."""
    return detect_with(msgs, [SECRET_DETECTORS["SLACK_TOKEN"]])


def detect_secrets(msgs: DataFrame) -> DataFrame:
    """All seven credential types in one pass."""
    return detect_with(msgs, list(SECRET_DETECTORS.values()))


def detect_personal_codes(msgs: DataFrame) -> DataFrame:
    """Latvian, Lithuanian and Estonian codes in one pass."""
    return detect_with(msgs, [PERSONAL_CODES])


def detect_lv_code(msgs: DataFrame) -> DataFrame:
    """Latvian codes written with the hyphen."""
    return detect_with(msgs, [LV_HYPHENATED])


def detect_lv_code_plain(msgs: DataFrame) -> DataFrame:
    """Latvian codes written without the hyphen."""
    return detect_with(msgs, [PLAIN_CODES]).where("detector = 'lv_personal_code_plain'")


def detect_lt_ee_code(msgs: DataFrame) -> DataFrame:
    """Lithuanian and Estonian codes not claimed as Latvian."""
    return detect_with(msgs, [PLAIN_CODES]).where("detector = 'baltic_personal_code'")


def detect_phone(msgs: DataFrame) -> DataFrame:
    """Telephone numbers, international and national."""
    return detect_with(msgs, [PHONE])


def detect_phone_intl(msgs: DataFrame) -> DataFrame:
    """Telephone numbers with a country code."""
    return detect_phone(msgs).where(F.col("score") == fixed.CERTAIN)


def detect_phone_national(msgs: DataFrame) -> DataFrame:
    """National numbers licensed by a word before them."""
    return detect_phone(msgs).where(F.col("score") == fixed.HIGH)


def span_countries(df: DataFrame, spans: str = "found", text: str = "text") -> DataFrame:
    """Adds ``country`` (LT, EE or NULL) to every span of an array that lies beside its text.

    Offsets are those of ``text``. Nothing is shuffled: marks are computed once per text with a span, and the
    windows where the text lies.
    """
    fields = ", ".join(f"'{f}', s.`{f}`" for f in df.schema[spans].dataType.elementType.names)
    country = let("near", name_window(text, "s.start"), infer_country_sql("near", "__marks"))
    marked = df.selectExpr("*", f"case when size({spans}) > 0 then {country_marks(text)} end as __marks")
    return marked.withColumn(spans, F.expr(f"transform({spans}, s -> named_struct({fields}, 'country', {country}))")).drop("__marks")


def infer_country(spans: DataFrame, docs: DataFrame, key: str = "request_id") -> DataFrame:
    """Adds ``country`` (LT, EE or NULL) to a table of spans, from the text of their documents.

    Only for spans that were recorded apart from their texts, which have to meet them again; spans that are
    found in the same run get theirs from ``span_countries``. What leaves the join is a country for each start.
    """
    keys = [key, *(c for c in ("idx",) if c in spans.columns and c in docs.columns)]
    starts = spans.groupBy(*keys).agg(F.collect_set("start").alias("__starts"))
    marked = (
        docs.select(*keys, "text").join(starts, keys)
        .selectExpr(*keys, f"{country_marks('text')} as marks", "explode(transform(__starts, s -> named_struct("
                           f"'start', s, 'near', {name_window('text', 's')}))) as w")
        .selectExpr(*keys, "w.start as start", f"{infer_country_sql('w.near', 'marks')} as country")
    )
    return spans.join(marked, [*keys, "start"], "left")


def detect_all(msgs: DataFrame, enabled: Sequence[Detector] = BUILTIN) -> DataFrame:
    """Spans of all enabled detectors on the detection view, resolved, as ``spans``.

    Offsets are those of the view; ``inspect`` maps them to the text.
    """
    found = detect_view(detection_view(msgs), enabled)
    return found.withColumn("spans", F.expr(resolve_spans("found"))).drop("found")


def capabilities(spark: SparkSession, detectors: Sequence[Detector] = BUILTIN) -> DataFrame:
    """``(detector, kind, entity_type)`` of the given detectors."""
    rows = sorted({(d.name.split(":")[0] if d.kind == "builtin" else d.name, d.kind, e)
                   for d in detectors for e in d.entity_types})
    return spark.createDataFrame(rows, "detector string, kind string, entity_type string")


def uncovered_entities(rules: DataFrame, available: DataFrame) -> DataFrame:
    """Entity types named by rules that no available detector can report."""
    named = rules.select(F.explode("entities").alias("entity_type")).distinct()
    return named.join(available, "entity_type", "left_anti")
