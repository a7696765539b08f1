"""Operators against planted values and plain-Python models."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from maskwright.functions import fixed
from maskwright.functions.text import canonicalize
from maskwright.operators import admission, audit, contract, corpus, custom, detectors, evaluate, policy, resolve, screening, tokens
from maskwright.operators.inspect import inspect
from maskwright.operators.view import _rebuild, detection_view, map_spans
from maskwright.plans import jobs
from maskwright.sources import tables
from maskwright.streaming.chunks import open_token_at


def texts(spark, values):
    return spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "request_id string, text string")


def found(spark, values, detector_list=detectors.BUILTIN):
    rows = map_spans(detectors.detect_all(texts(spark, values), detector_list)).collect()
    by_id = {int(r.request_id): [(s.text, s.entity_type) for s in r.spans] for r in rows}
    return [by_id[i] for i in range(len(values))]


def test_values_that_match_and_that_do_not(spark):
    cases = [
        ("kods: 140673-12349.", [("140673-12349", "LV_PERSONAL_CODE")]),
        ("140673-12348", []), ("(14067312349)", [("14067312349", "LV_PERSONAL_CODE")]),
        ("329876-54321", [("329876-54321", "LV_PERSONAL_CODE")]),
        ("88888888888 19991301007 23456789012", []),
        ("11010125557", [("11010125557", "BALTIC_PERSONAL_CODE")]),
        ("see isikukood 11010125557", [("11010125557", "EE_PERSONAL_CODE")]),
        ("Liepāja, 11010125557", [("11010125557", "LV_PERSONAL_CODE")]),
        ("asmens kodas 49112230159 ir isikukood 49112230159",
         [("49112230159", "LT_PERSONAL_CODE"), ("49112230159", "EE_PERSONAL_CODE")]),
        ("4532015809731241 20250230-44556", []),
        ("LV80UNLA0050019482638", []),
        ("me@here; you@.org; @none.net", []), ("p@q.org.7.8", [("p@q.org", "EMAIL_ADDRESS")]),
        ("p@q.org- or r@s.net_", []),
        ("phone 28714093", [("28714093", "PHONE_NUMBER")]), ("Order number 28714093", []),
        ("10.20.30.777", []),
        ("Kods 140673–12349", [("140673–12349", "LV_PERSONAL_CODE")]),
        ("14​0673-12349", [("14​0673-12349", "LV_PERSONAL_CODE")]),
        ("٤٥٣٢٠١٥٨٠٩٧٣١٢٤٠", [("٤٥٣٢٠١٥٨٠٩٧٣١٢٤٠", "PAYMENT_CARD")]),
    ]
    assert found(spark, [c for c, _ in cases]) == [e for _, e in cases]


def test_long_runs_of_labels_do_not_exhaust_the_stack(spark):
    assert found(spark, ["a@" + "b." * 20_000 + "com"])[0][0][1] == "EMAIL_ADDRESS"


def test_offsets_of_many_matches(spark):
    value = " ".join(f"u{i}@example.com é" for i in range(1500))
    rows = detectors.detect_email(texts(spark, [value])).orderBy("start").collect()
    assert len(rows) == 1500 and all(value[r.start:r.end] == r.text for r in rows)


def greedy(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-s[4], s[0] - s[1], s[0], s[2], s[5])):
        if all(k[1] <= s[0] or s[1] <= k[0] for k in kept):
            kept.append(s)
    return sorted(kept)


def test_resolution_equals_the_plain_model(spark):
    rng = random.Random(7)
    sets = []
    for n in [0, 1, 2, 5, 20, 60, 70, 150, 400]:
        spans = []
        for _ in range(n):
            a = rng.randrange(0, 4 * n + 1)
            spans.append((a, a + rng.randrange(1, 9), rng.choice("AB"), "t", rng.choice([1.0, 0.6]), rng.choice("xy")))
        sets.append(spans)
    df = spark.createDataFrame(list(enumerate(sets)), f"id int, found {resolve.SPANS_TYPE}")
    rows = df.withColumn("kept", F.expr(resolve.resolve_spans("found"))).orderBy("id").collect()
    for row, spans in zip(rows, sets):
        assert [tuple(s) for s in row.kept] == greedy(spans)


def test_view_and_canonical_form_equal_the_plain_model(spark):
    rng = random.Random(3)
    alphabet = "ab1 é́̄​­①⑿ﬁＡ３ЗΣςßİ　\t\n한ज़𝟙\x07"
    values = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 12))) for _ in range(300)] + ["\x08", "plain"]
    rows = detection_view(texts(spark, values)).collect()
    for row in rows:
        model = _rebuild(row.text)
        starts = row.view_starts if row.view_starts is not None else list(range(len(row.text)))
        assert (row.view_text, list(starts)) == (model["text"], model["starts"])
    canon = texts(spark, values).withColumn("c", canonicalize(F.col("text"))).collect()
    for row in canon:
        assert row.c == " ".join(unicodedata.normalize("NFKC", row.text).split()).casefold()


def test_cut_clusters_are_refused(spark):
    digits = custom.regex_detector("[0-9]", "DIGIT")
    msgs = texts(spark, ["⑿", "12", "Left ‮ right"]).withColumn("idx", F.lit(0))
    rows = {r.request_id: r.refusal for r in inspect(msgs, [digits]).collect()}
    assert rows == {"0": "inspection_failed", "1": None, "2": fixed.BIDI}


def test_screening_shares_and_scripts(spark):
    values = ["a​b", "a​" * 10, "Bērziņa Šiauliai Jõgeva", "pаypal", "Ωmega ok", "привет мир"]
    rows = {int(r.request_id): r.screening for r in screening.screen_table(texts(spark, values)).collect()}
    assert rows[0].blocking is None and rows[1].blocking == fixed.INVISIBLE
    assert [rows[i].signals.get(fixed.MIXED_SCRIPT, 0) for i in range(2, 6)] == [0, 1, 1, 0]


def test_user_patterns(spark):
    with pytest.raises(custom.UnsafePattern):
        custom.check_pattern("(a+)+")
    with pytest.raises(custom.UnsafePattern):
        custom.check_pattern("x" * 501)
    for pattern in (r"\bEMP-[0-9]{6}\b", "EMP-[0-9]{6}"):
        rows = custom.detect_custom_regex(texts(spark, ["é EMP-123456, EMP-12345"]), pattern, "emp").collect()
        assert [(r.start, r.end, r.text, r.entity_type) for r in rows] == [(2, 12, "EMP-123456", "EMP")]
    assert custom.detect_custom_regex(texts(spark, ["baa"]), "a*", "x").count() == 1


def test_dictionary_equals_a_scan_with_python_rules(spark):
    rng = random.Random(8)
    terms = ["Nord Baltic SIA", "Nord Baltic", "(gamma) y", "ķīmija", "a.b", "istanbul", "sea", "οδοσ", "straße", "++", "İx", "K"]
    values = ["nord baltic sia; NORD BALTIC; nord baltics", "(GAMMA) Y, xķīmija Ķīmija a.b.c", "none", "İstanbul ıstanbul ISTANBUL", "ſea SEA", "ΟΔΟΣ οδος", "STRAẞE strasse",
              "c++ and ++", "K k\u212a", ""]
    values += ["".join(rng.choice("aAkKsSſİıiΣσς. +b") for _ in range(30)) for _ in range(200)]
    for sensitive in (False, True):
        for chosen in (terms, terms + [f"zzz{i}" for i in range(3000)]):
            ordered = sorted(set(chosen), key=lambda t: (-len(t), t))
            scan = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, ordered)) + r")(?!\w)", 0 if sensitive else re.IGNORECASE)
            want = sorted((str(i), m.start(), m.end(), m.group()) for i, v in enumerate(values) for m in scan.finditer(v))
            got = custom.detect_dictionary(texts(spark, values), chosen, case_sensitive=sensitive).collect()
            assert sorted((r.request_id, r.start, r.end, r.text) for r in got) == want
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    assert custom.detect_dictionary_table(texts(spark, values), table).count() == custom.detect_dictionary(texts(spark, values), terms).count()


def test_dealt_dictionary_equals_the_automaton(spark):
    rng = random.Random(9)
    terms = ["Nord Baltic SIA", "Nord Baltic", "(gamma) y", "ķīmija", "a.b", "istanbul", "sea", "οδοσ", "straße", "++", "İx", "K", "b+", "+b", "a", " a b ", ". .", "k k k", None, "", "  "]
    values = ["nord baltic sia; NORD BALTIC; nord baltics", "(GAMMA) Y, xķīmija Ķīmija a.b.c (gamma) yy x(gamma) y", "none", "İstanbul ıstanbul ISTANBUL", "ſea SEA", "ΟΔΟΣ οδος",
              "c++ and ++", "++", "+++ +", "k k k k k", "(gamma) y", "STRAẞE strasse", "K k\u212a", "", None, "Nord  Baltic", "same text a", "same text a"]
    values += ["".join(rng.choice("aAkKbB+. ") for _ in range(25)) for _ in range(300)]
    msgs = texts(spark, values).repartition(3)
    for sensitive in (False, True):
        for chosen in (terms, ["a"], ["++", "."], [f"zzz{i}" for i in range(50)], []):
            table = spark.createDataFrame([(t, 1) for t in chosen], "term string, n int")
            want = custom.detect_dictionary(msgs, [t for t in chosen if t], case_sensitive=sensitive)
            got = custom.detect_dictionary_table(msgs, table, case_sensitive=sensitive)
            assert got.columns == want.columns and got.dtypes == want.dtypes
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_term_tables_stay_off_the_driver(spark):
    msgs = texts(spark, [f"w{i} w{i + 1} tail" for i in range(200)])
    table = spark.range(3000).selectExpr("concat('w', id, if(id % 2 = 0, concat(' w', id + 1), '')) as term")
    found = custom.detect_dictionary_table(msgs, table).collect()
    assert sorted(r.text for r in found) == sorted([f"w{i} w{i + 1}" if i % 2 == 0 else f"w{i}" for i in range(200)])


def test_terms_in_several_automata(spark, monkeypatch):
    values = ["alpha beta alpha beta gamma", "beta"]
    want = custom.detect_dictionary(texts(spark, values), ["alpha", "alpha beta", "beta", "gamma"]).collect()
    monkeypatch.setattr(custom, "BLOCK_CHARS", 6)
    assert custom.detect_dictionary(texts(spark, values), ["alpha", "alpha beta", "beta", "gamma"]).collect() == want


def test_order_statistics_of_hard_values(spark):
    rng = random.Random(4)
    groups = {
        "even": [float(i) for i in range(1000)], "same": [2.5] * 70, "one": [-0.0], "wide": [10.0 ** rng.uniform(-300, 300) * rng.choice((-1, 1)) for _ in range(500)],
        "close": [1.0 + i * 2**-52 for i in range(300)], "huge": [1.7e308, -1.7e308, 1.0, 5e-324, 0.0], None: [3.0, 1.0, 2.0], "skew": [1.0] * 900 + [1e9] * 3,
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("even", None), ("even", float("nan")), ("empty", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(3)
    ranks = {"low": lambda n: F.lit(1), "mid": lambda n: F.floor((n + 1) / 2), "p95": lambda n: F.ceil(n * 0.95), "top": lambda n: n}
    for bins in (4096, 40):
        got = {r.g: r for r in evaluate.order_statistics(frame, ["g"], "v", ranks, bins).collect()}
        for k, values in groups.items():
            if k in got:
                v, n = sorted(values), len(values)
                assert (got[k].n, got[k].low, got[k].mid, got[k].p95, got[k].top) == (n, v[0], v[(n + 1) // 2 - 1], v[-(-n * 95 // 100) - 1], v[-1])
        assert "empty" not in got and len(got) == len(groups)
    assert evaluate.order_statistics(frame.limit(0), ["g"], "v", ranks).count() == 0


def test_quantiles_gather_no_group(spark):
    frame = spark.range(5000).selectExpr("if(id % 3 = 0, 'a', 'b') as stage", "cast(id * 7 % 1000 as double) as ms")
    plan = evaluate.stage_latency(frame)._jdf.queryExecution().toString()
    assert "percentile" not in plan and not re.search(r"Window[^\n]*stage", plan)


def test_leaks_in_any_output(spark):
    originals = spark.createDataFrame([("EMAIL", "anna@example.org"), ("EMAIL", "anna@example.org"), ("PIN", "4711"), ("NAME", "Bo"), ("KEY", "k" * 900), ("X", ""), ("X", None), ("EMAIL", "nobody@example.org"), ("ALIAS", "4711")], "entity_type string, text string")
    rows = [("reply", "1", "r9", "write to xanna@example.orgy"), ("audit", "2", "r2", '{"note":"47110"}'), ("metric", "3", None, "label=Bo"), ("reply", "4", "r1", "nothing at all, bo"), ("reply", "5", "r1", None),
            ("reply", "6", "r1", ""), ("audit", "7", "r3", "x" + "k" * 950 + " 4711 Bo"), ("metric", "3", None, "label=Bo"), ("reply", "8", "r1", "anna@example.com nobody at example.org")]
    outputs = spark.createDataFrame([(*r, 1) for r in rows], "kind string, output_id string, request_id string, text string, value int")
    for gram in (6, 3, 40):
        got = sorted(map(tuple, audit.leak_scan_everywhere(originals, outputs, gram).collect()), key=str)
        assert got == sorted([("reply", "1", "r9", "EMAIL", 1), ("audit", "2", "r2", "PIN", 1), ("audit", "2", "r2", "ALIAS", 1), ("metric", "3", None, "NAME", 2),
                              ("audit", "7", "r3", "KEY", 1), ("audit", "7", "r3", "PIN", 1), ("audit", "7", "r3", "ALIAS", 1), ("audit", "7", "r3", "NAME", 1)], key=str)
    assert audit.leak_scan_everywhere(originals.limit(0), outputs).count() == 0 == audit.leak_scan_everywhere(originals, outputs.limit(0)).count()


def test_rule_checks_and_implicit_deny(spark):
    bad = policy.rules_frame(spark, [dict(name="a", action="drop", entities=["X"], min_score=2.0), dict(name="a", action="allow", entities=["X"])])
    assert {r.problem for r in policy.validate_rules(bad).collect()} == {
        "unknown_action", "bad_min_score", "duplicate_name", "no_catch_all"}
    only = policy.rules_frame(spark, [dict(name="a", action="allow", entities=["X"])])
    facts = spark.createDataFrame([("r", None, None)], "request_id string, entity_type string, score double")
    assert policy.first_match(facts, only).first()["rule_name"] == fixed.IMPLICIT_DENY


def test_token_bucket_equals_a_plain_loop(spark):
    rng = random.Random(5)
    rows, now = [], 1_700_000_000.0
    for i in range(3000):
        now += rng.choice([0.0, 0.1, 0.5, 3.0]) if i % 150 else rng.choice([0.1, 5000.0])
        rows.append((i, rng.choice(["hot", "hot", "cold"]), now))
    log = spark.createDataFrame(rows, "event_id long, key_id string, t double").selectExpr(
        "event_id", "key_id", "timestamp_micros(cast(t * 1000000 as bigint)) as ts")
    got = {r.event_id: r.admitted for r in admission.token_bucket(log, 20).collect()}
    buckets, want = {}, {}
    for i, key, t in rows:
        level, last = buckets.get(key, (20.0, t))
        level = min(20.0, level + (t - last) * 20 / 60)
        want[i] = level >= 1.0
        buckets[key] = (level - 1.0 if want[i] else level, t)
    assert got == want and not all(want.values())


def test_slots_equal_a_plain_loop(spark):
    rng = random.Random(6)
    rows, now = [], 1_700_000_000.0
    for i in range(1500):
        now += rng.choice([0.25, 1.0, 4000.0]) if i % 40 == 0 else rng.choice([0.25, 1.0])
        rows.append((i, now, float(rng.randrange(1, 12))))
    log = spark.createDataFrame(rows, "event_id long, t double, duration_s double").selectExpr(
        "event_id", "timestamp_micros(cast(t * 1000000 as bigint)) as ts", "duration_s")
    got = {r.event_id: r.admitted for r in admission.admit_in_flight(log, 4).collect()}
    ends, want = [], {}
    for i, t, d in rows:
        ends = [e for e in ends if e > t]
        want[i] = len(ends) < 4
        if want[i]:
            ends.append(t + d)
    assert got == want and not all(want.values())


def test_records_that_are_not_json(spark):
    rows = [("a", '{"x":1}'), ("b", "{broken"), ("c", '{"args":"not json"}'), ("d", None)]
    leaves = contract.flatten_json_leaves(spark.createDataFrame(rows, "record_id string, body string"), encoded=("args",))
    assert {r.record_id: r.reason for r in leaves.collect() if r.reason} == {"b": "invalid_json", "c": "invalid_json"}
    none = spark.createDataFrame([], "record_id string, leaf int")
    assert {r.record_id for r in contract.refuse_structural_hits(leaves, none)[1].collect()} == {"b", "c"}
    bodies = ['{"a":"NaN, "}', '{"a":NaN}', '{"a":[Infinity]}', '{"Infinity":"-NaN"}', '{"a":-Infinity}']
    bounds = contract.json_bounds(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert [r.violation for r in bounds] == [None, "invalid_json", "invalid_json", None, "invalid_json"]


def test_requests_without_scope_or_messages_are_refused(spark):
    rows = [("1", "t", "c", "k", "a", "m", [("user", "x")]), ("2", None, "c", "k", "a", "m", [("user", "x")]), ("3", "t", "c", "k", "a", "m", []),
            ("4", "t", "c", "k", None, "m", None), ("5", "t", "", "k", "a", "m", None)]
    frame = spark.createDataFrame(rows, tables.REQUEST_SCHEMA)
    assert [r.request_id for r in tables.messages_of(frame).collect()] == ["1"]
    assert {r.request_id: r.reason for r in tables.refused_requests(frame).collect()} == {
        "2": "incomplete_scope", "3": "no_messages", "4": "no_messages", "5": "incomplete_scope"}


def test_requests_that_take_no_time_count_themselves(spark):
    rows = [(1, 10.0, 0.0), (2, 10.0, 0.0), (3, 10.0, 5.0), (4, 15.0, 1.0), (5, 15.0, 0.0)]
    log = spark.createDataFrame(rows, "event_id long, t double, duration_s double").selectExpr(
        "event_id", "timestamp_micros(cast(t * 1000000 as bigint)) as ts", "duration_s")
    got = {r.event_id: r.active for r in admission.in_flight(log, 4).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2}


def test_country_of_codes_in_several_messages(spark):
    msgs = spark.createDataFrame([("r", 0, "isikukood 49112230159"), ("r", 1, "asmens kodas 49112230159")], "request_id string, idx int, text string")
    found_ = detectors.infer_country(detectors.detect_lt_ee_code(msgs), msgs)
    assert sorted((r.idx, r.country) for r in found_.collect()) == [(0, "EE"), (1, "LT")]


def test_countries_beside_their_text(spark):
    texts = ["isikukood 49112230159", "asmens kodas 49112230159", "49112230159", None, "", "x" * 5000 + " isikukood 49112230159 and asmens kodas 49112230159"]
    msgs = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)], "idx int, text string, __marks_of string")
    found = detectors.span_countries(detectors.span_columns(msgs, [detectors.PLAIN_CODES]))
    assert found.columns == [*msgs.columns, "found"] and found.count() == len(texts) and found.limit(0).count() == 0
    spans = detectors.explode_spans(found, "found", "idx").where("detector = 'baltic_personal_code'")
    recorded = detectors.infer_country(detectors.detect_lt_ee_code(msgs), msgs, "idx")
    key = lambda df: sorted((r.idx, r.start, r.end, r.country or "") for r in df.collect())
    assert key(spans) == key(recorded) and [k[0] for k in key(spans)] == [0, 1, 2, 5, 5] and [k[3] for k in key(spans)][-2:] == ["EE", "LT"]
    assert "Exchange" not in spans._jdf.queryExecution().executedPlan().toString()


def test_one_form_of_code_is_what_all_forms_find_of_it(spark):
    texts = ["131280-11211 32131280112 39001010077 49112230159", "personas kods 131280-11213, 32-1312801", "320313-11111", "none", None]
    msgs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "idx int, text string")
    every = sorted(map(str, detectors.detect_personal_codes(msgs).collect()))
    parts = [detectors.detect_lv_code(msgs), detectors.detect_lv_code_plain(msgs), detectors.detect_lt_ee_code(msgs)]
    assert every == sorted(str(r) for p in parts for r in p.collect()) and every


def test_json_leaves_round_trip(spark):
    body = '{"a":"x","b":[{"c":"y"},"z"],"args":"{\\"k\\":\\"v\\",\\"n\\":7}"}'
    df = spark.createDataFrame([("r", body)], "record_id string, body string")
    leaves = contract.flatten_json_leaves(df, content=("a", "b.*.c"), encoded=("args",)).cache()
    free = {r.text for r in leaves.where("not structural").collect()}
    assert free == {"x", "y", "v"} and {"a", "k", "7", "z"} <= {r.text for r in leaves.where("structural").collect()}
    out = contract.replace_json_leaves(df, leaves.withColumn("text", F.upper("text"))).first()["body"]
    assert out == '{"a":"X","b":[{"c":"Y"},"z"],"args":"{\\"k\\":\\"V\\",\\"n\\":7}"}'


def test_generated_corpus_scores_fully(spark):
    for split in ("dev", "holdout"):
        examples = corpus.generate_corpus(spark, 160, 11, split)
        result = jobs.evaluate(examples)
        assert result["gate"].count() == 0 and result["failures"].count() == 0
        assert all(r.recall == 1.0 for r in result["adversarial"].collect())
        assert corpus.verify_boundaries(examples).count() == 0


def test_chunk_cuts_never_split_a_token():
    token = f"<EMAIL_ADDRESS:v1:{'a' * 32}>"
    text = f"a < b {token} c <X {token}"
    for step in range(1, 40):
        held, parts = "", []
        for i in range(0, len(text), step):
            held += text[i:i + step]
            cut = open_token_at(held)
            parts.append(held[:cut])
            held = held[cut:]
        parts.append(held)
        assert "".join(parts) == text and sum(p.count(token) for p in parts) == 2


def test_keys_are_checked(spark):
    with pytest.raises(ValueError):
        tokens.token_key_table(spark, b"short")
    a, b = (tokens.derive_key(b"r" * 32, info) for info in (b"vault", b"token"))
    assert len(a) == 32 and a != b
