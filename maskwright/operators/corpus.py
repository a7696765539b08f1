"""Labelled examples made from templates and seeded values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import checks, fixed
from maskwright.functions.arrays import let

# (split, lang, kind, template); {slot} is filled, its type is given by SLOTS
TEMPLATES = (
    ("dev", "en", "positive", "Write to {email} about the open order."),
    ("dev", "en", "positive", "The transfer went to {iban} on Monday."),
    ("dev", "en", "positive", "Charge {card} for the renewal."),
    ("dev", "en", "positive", "You can phone {phone} before noon."),
    ("dev", "lv", "positive", "Personas kods {lv_code} ir pievienots lietai."),
    ("dev", "lt", "positive", "Jo asmens kodas {lt_code} nurodytas byloje."),
    ("dev", "et", "positive", "Tema isikukood {ee_code} on toimikus."),
    ("dev", "en", "negative", "What changed in the second chapter of the manual?"),
    ("dev", "lv", "negative", "Kad sākas nākamā sanāksme?"),
    ("dev", "en", "boundary", "Batch {bad_code} left the plant."),
    ("dev", "en", "boundary", "The total of {bad_card} units was disputed."),
    ("dev", "en", "mixed", "Mail {email} and pay {iban} today."),
    ("dev", "lv", "adversarial", "Kods {cyrillic_code} dokumentā."),
    ("dev", "lv", "adversarial", "Kods {hidden_code} dokumentā."),
    ("dev", "lv", "adversarial", "Kods {wide_code} dokumentā."),
    ("dev", "en", "known_gap", "Reach me at {spoken_email} please."),
    ("holdout", "en", "positive", "Our contact for invoices is {email}, please keep it."),
    ("holdout", "en", "positive", "Refund {card} in full."),
    ("holdout", "en", "positive", "Settle the balance to {iban}."),
    ("holdout", "lt", "positive", "Skambinkite tel. {phone} rytoj."),
    ("holdout", "lv", "positive", "Darbinieks ar personas kodu {lv_code} ir atvaļinājumā."),
    ("holdout", "en", "negative", "Compare both offers by their running cost."),
    ("holdout", "en", "boundary", "Ticket {bad_code} was closed."),
    ("holdout", "lv", "adversarial", "Iesniegumā ir {hidden_code}."),
)
SLOTS = {
    "email": "EMAIL_ADDRESS", "iban": "IBAN", "card": "PAYMENT_CARD", "phone": "PHONE_NUMBER",
    "lv_code": "LV_PERSONAL_CODE", "lt_code": "LT_PERSONAL_CODE", "ee_code": "EE_PERSONAL_CODE",
    "cyrillic_code": "LV_PERSONAL_CODE", "hidden_code": "LV_PERSONAL_CODE", "wide_code": "LV_PERSONAL_CODE",
    "spoken_email": "EMAIL_ADDRESS", "bad_code": None, "bad_card": None,
}


def _digits(salt: str, n: int) -> str:
    """``n`` digits from the row and the seed."""
    return f"lpad(cast(pmod(xxhash64(seed, n, '{salt}'), {10 ** n}) as string), {n}, '0')"


def _pick(salt: str, low: int, high: int, width: int) -> str:
    return f"lpad(cast({low} + pmod(xxhash64(seed, n, '{salt}'), {high - low + 1}) as string), {width}, '0')"


def _lv_code() -> str:
    body = f"concat({_pick('day', 1, 28, 2)}, {_pick('month', 1, 12, 2)}, {_digits('yy', 2)}, {_digits('tail', 4)})"
    total = " + ".join(f"{checks.digit_at('b', i)} * {w}" for i, w in enumerate(fixed.LV_WEIGHTS, 1))
    return let("b", body, f"concat(left(b, 6), '-', substr(b, 7), pmod(pmod(1101 - ({total}), 11), 10))")


def _lt_ee_code(salt: str) -> str:
    body = (f"concat({_pick(salt + 'g', 3, 6, 1)}, {_digits(salt + 'yy', 2)}, {_pick(salt + 'm', 1, 12, 2)}, "
            f"{_pick(salt + 'd', 1, 28, 2)}, {_digits(salt + 'nnn', 3)})")
    one = " + ".join(f"{checks.digit_at('b', i)} * {w}" for i, w in enumerate(fixed.LT_EE_WEIGHTS, 1))
    two = " + ".join(f"{checks.digit_at('b', i)} * {w}" for i, w in enumerate(fixed.LT_EE_WEIGHTS_SECOND, 1))
    return let("b", body, f"concat(b, case when pmod({one}, 11) < 10 then pmod({one}, 11) "
                          f"when pmod({two}, 11) < 10 then pmod({two}, 11) else 0 end)")


def _iban() -> str:
    account = f"concat('BANK', {_digits('account', 13)})"
    number = ("aggregate(split(concat(a, 'LV00'), ''), 0, (acc, ch) -> if(ascii(ch) < 58, "
              "pmod(acc * 10 + ascii(ch) - 48, 97), pmod(acc * 100 + ascii(ch) - 55, 97)))")
    return let("a", account, f"concat('LV', lpad(cast(98 - {number} as string), 2, '0'), a)")


def _card() -> str:
    total = " + ".join(
        (f"(2 * {checks.digit_at('b', i)} - if({checks.digit_at('b', i)} > 4, 9, 0))" if i % 2 else checks.digit_at("b", i))
        for i in range(1, 16))
    return let("b", f"concat('4', {_digits('card', 14)})", f"concat(b, pmod(10 - pmod({total}, 10), 10))")


def _values() -> dict[str, str]:
    lv = _lv_code()
    name = f"concat('user', {_digits('name', 6)})"
    return {
        "email": f"concat({name}, '@mail.example.com')",
        "spoken_email": f"concat({name}, ' at mail dot example dot com')",
        "iban": _iban(), "card": _card(),
        "phone": f"concat('+371 2', {_digits('phone', 7)})",
        "lv_code": lv, "lt_code": _lt_ee_code("lt"), "ee_code": _lt_ee_code("ee"),
        # the last digit moved by one breaks the checksum
        "bad_code": let("c", lv, "concat(left(c, 11), pmod(cast(right(c, 1) as int) + 1, 10))"),
        "bad_card": let("c", _card(), "concat(left(c, 15), pmod(cast(right(c, 1) as int) + 1, 10))"),
        "cyrillic_code": f"replace({lv}, '3', 'З')",
        "hidden_code": let("c", lv, "concat(left(c, 3), '​', substr(c, 4))"),
        "wide_code": f"translate({lv}, '0123456789', '０１２３４５６７８９')",
    }


def _template_rows(split: str) -> list[tuple]:
    rows = []
    for number, (which, lang, kind, text) in enumerate(t for t in TEMPLATES if t[0] == split):
        pieces, slots = [], []
        rest = text
        while "{" in rest:
            before, _, after = rest.partition("{")
            slot, _, rest = after.partition("}")
            pieces.append(before)
            slots.append(slot)
        rows.append((number, lang, kind, pieces + [rest], slots, [SLOTS[s] for s in slots]))
    return rows


def generate_corpus(spark: SparkSession, n: int, seed: int, split: str = "dev") -> DataFrame:
    """``n`` examples with exact gold spans; the same seed gives the same rows.

    Rows come from ``range``, templates by an equi-join on their number; values
    are hashes of seed and row, and offsets are sums of piece lengths.
    """
    rows = _template_rows(split)
    templates = spark.createDataFrame(
        rows, "number int, lang string, kind string, pieces array<string>, slots array<string>, types array<string>")
    values = _values()
    by_slot = " ".join(f"when s = '{slot}' then {sql}" for slot, sql in values.items())
    base = spark.range(n).selectExpr("id as n", f"cast({int(seed)} as bigint) as seed",
                                     f"cast(id % {len(rows)} as int) as number")
    filled = base.join(F.broadcast(templates), "number").withColumn(
        "values", F.expr(f"transform(slots, s -> case {by_slot} end)"))
    start = (
        "aggregate(sequence(0, i), 0, (a, j) -> a + length(pieces[j]) + if(j < i, length(values[j]), 0))"
    )
    spans = F.expr(
        "filter(transform(values, (v, i) -> named_struct("
        f"'start', {start}, 'end', {start} + length(v), 'entity_type', types[i])), s -> s.entity_type is not null)"
    )
    text = F.expr("array_join(transform(pieces, (p, i) -> concat(p, coalesce(get(values, i), ''))), '')")
    return filled.select(
        F.concat(F.lit(f"{split}-"), F.lpad(F.col("n").cast("string"), 9, "0")).alias("id"), "lang", "kind",
        text.alias("text"), spans.alias("spans"), F.lit("generated").alias("note"), F.lit(split).alias("split"))


def verify_boundaries(examples: DataFrame) -> DataFrame:
    """``(id, problem)``: boundary rows whose number would pass a checksum after all.

    Computed apart from the detectors, from the digits of the text alone.
    """
    digits = F.expr("translate(regexp_extract(text, r'[0-9][0-9-]{9,}', 0), '-', '')")
    judged = examples.where("kind = 'boundary'").withColumn("__d", digits)
    passes = (
        F.when(F.length("__d") == 11, F.expr(f"{checks.lv_ok('__d')} or {checks.lt_ee_ok('__d')}"))
        .when(F.length("__d").between(13, 19), F.expr("luhn_check(__d)"))
        .otherwise(False))
    return judged.where(passes).select("id", F.lit("passes_checksum").alias("problem"))
