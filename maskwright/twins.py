"""SQL twins of the catalogue, for an engine without this library.

Written from the planted truth and from plain SQL, not from the detectors.
"""

from __future__ import annotations

import hashlib

from maskwright import catalogue as c
from maskwright.functions import fixed
from maskwright.operators import tokens


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def planted(plants, index: str) -> str:
    return f"text || chr(10) || list_extract([{', '.join(q(s) for s, _ in plants)}], cast(({index}) % {len(plants)} as int) + 1)"


def truth(plants, accept=lambda e, d: True) -> str:
    """Rows (k, o, txt, entity_type, score, detector) of the planted values."""
    rows = [
        f"({k}, {s.index(v)}, {q(v)}, {q(e)}, {score}, {q(d)})"
        for k, (s, found) in enumerate(plants) for v, e, score, d in found if accept(e, d)
    ]
    return ("(select k, o, txt, entity_type, cast(score as double) as score, detector from (values "
            + ", ".join(rows) + ") v(k, o, txt, entity_type, score, detector))")


def doc_truth(accept) -> str:
    n = len(c.PLANTS)
    return (f"select doc_id, cast(length(text) + 1 + o as int) as start, cast(length(text) + 1 + o + length(txt) as int) as \"end\", "
            f"entity_type, txt as text, score, detector from documents join {truth(c.PLANTS, accept)} on doc_id % {n} = k")


def turn_truth(plants=c.PLANTS, accept=lambda e, d: True, per_turn: bool = False) -> str:
    request = "'c' || conv_id || '-' || turn" if per_turn else "'c' || conv_id"
    return (f"select {request} as request_id, cast(turn as int) as idx, conv_id, cast(length(text) + 1 + o as int) as start, "
            f"cast(length(text) + 1 + o + length(txt) as int) as \"end\", entity_type, txt as text, score, detector, "
            f"(conv_id + turn) % {len(plants)} as k from conversations join {truth(plants, accept)} on (conv_id + turn) % {len(plants)} = k")


SPAN = 'start, "end", entity_type, text, score, detector'


def located(source: str, key: str, pattern: str) -> str:
    """(key, start, end, text) of all matches of a pattern, from pieces and matches."""
    return f"""(select {key}, cast(s as int) as start, cast(s + length(m) as int) as "end", m as text from (
        select {key}, ms[i] as m, list_sum(list_transform(gs[1:i], lambda g: length(g)))
            + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as s
        from (select {key}, ms, gs, unnest(generate_series(1, len(ms))) as i from (
            select {key}, regexp_extract_all(text, {q(pattern)}) as ms, regexp_split_to_array(text, {q(pattern)}) as gs
            from {source}))))"""


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"
HEX = 'token = "[0-9a-f]{40}"'


def spans_sql(pattern: str, entity: str, score: float, detector: str) -> str:
    return (f"select doc_id, start, \"end\", {q(entity)} as entity_type, text, cast({score} as double) as score, "
            f"{q(detector)} as detector from {located('documents', 'doc_id', pattern)}")


def cards() -> str:
    digits = "list_transform(list_reverse(string_split(text, '')), lambda d, i: case when i % 2 = 1 then cast(d as int) " \
             "when cast(d as int) > 4 then 2 * cast(d as int) - 9 else 2 * cast(d as int) end)"
    return (f"select doc_id, start, \"end\", 'PAYMENT_CARD' as entity_type, text, 1.0::double as score, 'payment_card' as detector "
            f"from {located('documents', 'doc_id', r'[0-9]+')} where length(text) between 13 and 19 and list_sum({digits}) % 10 = 0")


def words(terms: str, entity: str = "CUSTOMER_TERM", detector: str = "customer_dictionary") -> str:
    return (f"select doc_id, start, \"end\", {q(entity)} as entity_type, text, 1.0::double as score, {q(detector)} as detector "
            f"from {located('documents', 'doc_id', '[' + chr(92) + 'pL' + chr(92) + 'pN_]+')} where lower(text) in ({terms})")


TERMS = ", ".join(q(t) for t in c.FREQUENT)
PER_TURN = turn_truth(per_turn=True)
PER_CONV = turn_truth()

POLICY = "(select * from (values " + ", ".join(
    f"({r['priority']}, {q(r['name'])}, {q(r['action'])}, {q(r.get('destination', ''))}, {q(e)}, {r.get('min_score', 0.0)})"
    for r in c.POLICY for e in (r.get("entities") or ["*"])
) + ") r(priority, rule_name, action, destination, entity, min_score))"


def decided(mode: str) -> str:
    """One row per turn: the best rule, then the floor of the mode."""
    return f"""
        with spans as ({PER_TURN}),
        reqs as (select 'c' || conv_id || '-' || turn as request_id, conv_id, turn from conversations),
        hits as (
            select distinct s.request_id, r.priority, r.rule_name, r.action, r.destination, s.entity_type
            from spans s join {POLICY} r on r.entity = s.entity_type and s.score >= r.min_score
            union all select request_id, priority, rule_name, action, destination, null from reqs, {POLICY} r where entity = '*'),
        best as (select *, dense_rank() over (partition by request_id order by priority desc) as rk from hits),
        base as (
            select request_id, max(rule_name) as rule_name, max(action) as action,
                case when max(destination) = '' then 'external' else max(destination) end as destination,
                coalesce(string_agg(entity_type, ',' order by entity_type), '') as matched
            from best where rk = 1 group by request_id),
        types as (select request_id, string_agg(t, ',' order by t) as types from (
            select distinct request_id, entity_type as t from spans) group by request_id),
        moved as (select b.*, t.types, b.action <> 'block' and b.destination <> 'local'
            and {"true" if mode == "all" else "t.types is not null" if mode == "detected" else "false"} as m
            from base b left join types t using (request_id)),
        final as (select request_id, case when m then 'route_local' else action end as action,
            case when m then 'local' else destination end as destination,
            case when m then 'local-routing:{mode}' else rule_name end as rule_name,
            'example-1' || '{"" if mode == "off" else "+local-routing:" + mode}' as policy_version,
            case when m then coalesce(types, '') else matched end as matched_entities,
            action as base_action, rule_name as base_rule from moved)"""


DECIDED_COLUMNS = "request_id, action, destination, rule_name, policy_version, matched_entities"


def pad(byte: int) -> str:
    return "".join(f"{b ^ byte:02X}" for b in c.TOKEN_KEY.ljust(64, b"\0"))


def tag(tenant: str, conversation: str, entity: str, canonical: str) -> str:
    parts = [q(tokens.TAG_DOMAIN), q("v1"), tenant, conversation, entity, canonical]
    message = " || '\\x00'::blob || ".join(f"encode(strlen({p})::varchar || ':' || {p})" for p in parts)
    return (f"left(sha256(unhex('{pad(0x5C)}') || unhex(sha256(unhex('{pad(0x36)}') || {message}))), 32)")


CANON = "lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')))"
TENANT, CONV = "'t' || conv_id % 4", "'conv-' || conv_id"
MINTED = f"""
    {decided("off")},
    minted as (select s.request_id, s.idx, s.conv_id, s.start, s."end", s.entity_type, s.text, {CANON} as canonical,
        '<' || s.entity_type || ':v1:' || {tag(TENANT, CONV, "s.entity_type", CANON)} || '>' as token
        from spans s join final f on f.request_id = s.request_id and f.action in ('transform', 'route_local'))"""
OUTPUT = f"""
    {MINTED},
    pieces as (select *, row_number() over (partition by request_id order by start) as rn,
        count(*) over (partition by request_id) as cnt from minted),
    originals as (select 'c' || conv_id || '-' || turn as request_id, conv_id, cast(turn as int) as idx, role,
        {planted(c.PLANTS, 'conv_id + turn')} as text from conversations),
    two as (select request_id, max(case when rn = 1 then start end) as s1, max(case when rn = 1 then "end" end) as e1,
        max(case when rn = 1 then token end) as t1, max(case when rn = 2 then start end) as s2,
        max(case when rn = 2 then "end" end) as e2, max(case when rn = 2 then token end) as t2 from pieces group by request_id),
    output as (select o.request_id, o.conv_id, o.idx, o.role, case when s1 is null then o.text
        when s2 is null then substr(o.text, 1, s1) || t1 || substr(o.text, e1 + 1)
        else substr(o.text, 1, s1) || t1 || substr(o.text, e1 + 1, s2 - e1) || t2 || substr(o.text, e2 + 1) end as text, o.text as original
        from originals o join final f on f.request_id = o.request_id and f.action <> 'block' left join two w on w.request_id = o.request_id)"""

LAST = "conv_id % 10"
STATUS = (f"case when {LAST} = 1 then 'absent' when {LAST} = 2 then 'expired' when {LAST} = 3 then 'unknown_format' "
          f"when {LAST} = 4 then 'key_unavailable' when {LAST} in (5, 6) then 'unauthentic' else 'found' end")
# in restoration the moved rows are looked up under their own tenant, where nothing is left
OUTCOME = (f"case when {LAST} in (1, 2, 3, 5, 6) then 'vault_miss' when {LAST} = 4 then 'key_unavailable' else 'restored' end")
FORGED = f"<EMAIL_ADDRESS:v1:{'0' * 32}>"
# the token of the least request of a conversation; among several of that request any is
# the same, since a minimum by request with ties is avoided by the plants
REPLIES = f"""
    {OUTPUT},
    own as (select distinct request_id, conv_id, token, {OUTCOME} as outcome from minted),
    first_request as (select conv_id, min(request_id) as owner from minted group by conv_id)"""


TAIL = """,
    tail as (select o.request_id, o.conv_id, length(o.text) as len, f.token as foreign_token, f.owner from output o left join (
        select m.conv_id, first_request.owner, max(m.token) as token from minted m join first_request on m.request_id = first_request.owner
        group by m.conv_id, first_request.owner) f using (conv_id))"""
# requests of a conversation share its fate, so a reply comes back whole or not at all
RESTORED = f"""{REPLIES}{TAIL},
    back as (select request_id, conv_id, case when conv_id % 10 in (1, 2, 3, 4, 5, 6) then text else original end as back from output)"""


def scored() -> str:
    n = len(c.PLANTS)
    shift = f"case when k % 6 = 0 then 1 else 0 end"
    return f"""
        with t as (select 'c' || conv_id || '-' || turn as id, conv_id, (conv_id + turn) % {n} as k, s.start, s."end", s.entity_type
            from ({PER_TURN}) s join (select conv_id as cc, turn from conversations) v on v.cc = s.conv_id and v.turn = s.idx),
        ex as (select 'c' || conv_id || '-' || turn as id, case when conv_id % 2 = 0 then 'en' else 'lv' end as lang,
            case when (conv_id + turn) % {n} in (17, 18) then 'boundary' when (conv_id + turn) % {n} = 16 then 'adversarial' else 'positive' end as kind
            from conversations),
        o as (select id, start, "end", entity_type, case when k % 6 = 0 then 'fp' else 'tp' end as outcome from t
            union all select id, start, "end" + 1, entity_type, 'fn' from t where k % 6 = 0),
        outcomes as (select o.*, ex.lang, ex.kind from o join ex using (id) where kind <> 'adversarial'),
        b as (select case grouping(entity_type) * 4 + grouping(lang) * 2 + grouping(kind) when 3 then 'entity' when 5 then 'language'
                when 1 then 'entity_language' else 'kind' end as bucket,
            case grouping(entity_type) * 4 + grouping(lang) * 2 + grouping(kind) when 3 then entity_type when 5 then lang
                when 1 then entity_type || '/' || lang else kind end as key,
            count(*) filter (outcome = 'tp') as tp, count(*) filter (outcome = 'fp') as fp, count(*) filter (outcome = 'fn') as fn
            from outcomes group by grouping sets ((entity_type), (lang), (entity_type, lang), (kind))),
        s as (select *, tp + fn as support, case when tp + fp = 0 then 1.0 else tp / (tp + fp) end as precision,
            case when tp + fn = 0 then 1.0 else tp / (tp + fn) end as recall from b)"""


F1 = "case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end"


def chars(text: str, members: str) -> str:
    return f"length({text}) - length(translate({text}, {q(members)}, ''))"


BIDI = "‪‫‬‭‮⁦⁧⁨⁩؜‎‏"
HIDDEN = r"[\p{Cf}\p{Cc}]"


def screened() -> str:
    t = planted(c.EVASIONS, "conv_id + turn")
    return f"""
        with t as (select conv_id, turn, (conv_id + turn) % {len(c.EVASIONS)} as k, {t} as text from conversations),
        n as (select *, {chars('text', BIDI)} as b,
            length(text) - length(regexp_replace(text, '{HIDDEN}', '', 'g')) - ({chars("text", chr(9) + chr(10) + chr(13))}) as h,
            {chars('text', fixed.CONFUSABLE_FROM)} as f, 0 as m from t)"""


def session_hash(*parts: str) -> str:
    return " || '\\x00'::blob || ".join(f"encode(strlen({p})::varchar || ':' || {p})" for p in parts)


def all_twins() -> dict[str, str]:
    low = "select request_id, idx, " + SPAN
    faults = "(select 'c' || conv_id as request_id, conv_id, max(turn) as m, count(*) as n from conversations group by conv_id)"
    base = session_hash("'agent-session-v1'", TENANT, "'key-' || conv_id % 4", "'s-' || conv_id")
    nested = session_hash("'agent-subagent-v1'", f"lower(hex({base}))", "'helper'")
    cache = session_hash("'agent-cache-v1'", TENANT, "'key-' || conv_id % 4", CONV, "'messages'", "'m-1'", "'external'", "'v1'", "'id-' || turn")
    kind = "(conv_id + turn) % 10"
    long_words = ("select lower(w) from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from benchmark)")
    audit_counts = "string_agg(entity_type || '=' || n, ',' order by entity_type)"
    tools = "(select 'c' || conv_id as request_id, conv_id, 'tool' || turn % 5 as name, turn % 2 = 0 as fn from conversations)"
    found = {
        "entity_counts_by_lang": f"""
            select lang, 'EMAIL_ADDRESS' as entity_type, sum(len(regexp_extract_all(text, {q(EMAIL)})))::bigint as n
            from documents group by lang having n > 0 union all
            select lang, 'IP_ADDRESS', sum(len(regexp_extract_all(text, {q(IPV4)})))::bigint as n from documents group by lang having n > 0""",
        "email_spans": spans_sql(EMAIL, "EMAIL_ADDRESS", 1.0, "email"),
        "ipv4_spans": spans_sql(IPV4, "IP_ADDRESS", 0.6, "ip_address"),
        "card_spans": cards(),
        "iban_spans": doc_truth(lambda e, d: e == "IBAN"),
        "lv_code_spans": doc_truth(lambda e, d: d == "lv_personal_code"),
        "lv_code_plain_spans": doc_truth(lambda e, d: d == "lv_personal_code_plain"),
        "lt_ee_code_spans": doc_truth(lambda e, d: d == "baltic_personal_code"),
        # before conflicts are resolved, an sk-ant- value is reported under both of its labels
        "secret_spans": doc_truth(lambda e, d: d == "secrets") + " union all " + doc_truth(
            lambda e, d: e == "ANTHROPIC_API_KEY").replace("entity_type, txt", "'OPENAI_API_KEY' as entity_type, txt"),
        "infer_country_spans": "select doc_id, start, \"end\", text, case entity_type when 'EE_PERSONAL_CODE' then 'EE' "
                               "when 'LT_PERSONAL_CODE' then 'LT' end as country from ("
                               + doc_truth(lambda e, d: d == "baltic_personal_code") + ")",
        "dictionary_spans": words(TERMS),
        "dictionary_table_spans": words(long_words),
        "custom_regex_spans": spans_sql(HEX, "HEX_SECRET", 0.85, "custom_regex:HEX_SECRET"),
        "filter_spans": spans_sql(HEX, "HEX_SECRET", 0.85, "filter:hex-secrets") + " union all " + words("'the', 'der'", "ARTICLE", "filter:articles"),
        "phone_spans": f"{low} from ({turn_truth(accept=lambda e, d: e == 'PHONE_NUMBER')})",
        "resolved_spans": f"{low} from ({PER_CONV})",
        "evasion_spans": f"{low} from ({turn_truth(c.EVASIONS)})",
        "entity_counts": f"select request_id, entity_type, count(*) as n from ({PER_CONV}) group by all",
        "entity_presence": f"""
            with t as (select distinct request_id, entity_type from ({PER_CONV})),
            r as (select distinct 'c' || conv_id as request_id from conversations)
            select request_id, coalesce(string_agg(entity_type, ',' order by entity_type), '') as types,
                count(entity_type) > 0 as any_detection from r left join t using (request_id) group by request_id""",
        "aliased_counts": f"select case when entity_type in ('LT_PERSONAL_CODE', 'EE_PERSONAL_CODE') then 'BALTIC_PERSONAL_CODE' "
                          f"else entity_type end as entity_type, count(*) as n from ({PER_TURN}) group by 1",
        "screening": f"""{screened()} select 'c' || conv_id as request_id, cast(turn as int) as idx,
            case when b > 0 then '{fixed.BIDI}' when length(text) >= 12 and h / length(text) > 0.1 then '{fixed.INVISIBLE}' else 'none' end as blocking,
            cast(case when b > 0 then b when length(text) >= 12 and h / length(text) > 0.1 then h else 0 end as bigint) as n,
            cast(b as bigint) as bidi, cast(case when b > 0 then 0 else h end as bigint) as invisible,
            cast(case when b > 0 then 0 else f end as bigint) as confusable, cast(case when b > 0 then 0 else m end as bigint) as script from n""",
        "document_confusables": f"select doc_id, cast({chars('text', fixed.CONFUSABLE_FROM)} as bigint) as confusable, "
                                f"cast(length(text) - length(regexp_replace(text, '{HIDDEN}', '', 'g')) - ({chars('text', chr(9) + chr(10) + chr(13))}) as bigint) as invisible, "
                                f"cast({chars('text', BIDI)} as bigint) as bidi from documents",
        "signal_rollup": f"""{screened()}, u as (
            select conv_id, '{fixed.BIDI}' as code, b as n from n union all
            select conv_id, '{fixed.INVISIBLE}', case when b > 0 then 0 else h end from n union all
            select conv_id, '{fixed.CONFUSABLE}', case when b > 0 then 0 else f end from n)
            select 'c' || conv_id as request_id, code, cast(sum(n) as bigint) as n from u group by all having sum(n) > 0""",
        "quarantined": f"""{screened()} select 'c' || conv_id as request_id, '{fixed.BIDI}' as reason, count(*) as n_messages
            from n where b > 0 group by conv_id""",
        **{name: f"{decided(mode)} select {DECIDED_COLUMNS} from final"
           for name, mode in (("decisions", "off"), ("decisions_detected", "detected"), ("decisions_all", "all"))},
        "rule_matches": f"""
            with s as (select distinct request_id, entity_type, score from ({PER_CONV}))
            select request_id, rule_name, string_agg(distinct entity_type, ',' order by entity_type) as matched_entities
            from s join {POLICY} r on r.entity = s.entity_type and s.score >= r.min_score group by all
            union all select distinct 'c' || conv_id, 'rest-passes', '' from conversations""",
        "routing_violations": f"{decided('off')} select request_id, rule_name, 'local_routing_violation' as code from final "
                              "where action <> 'block' and destination <> 'local' and request_id in (select request_id from spans)",
        "base_and_effective": f"{decided('detected')} select request_id, base_action, base_rule, action, destination from final",
        "minted_tokens": f"{MINTED} select distinct request_id, entity_type, token, canonical, text as original from minted",
        "pseudonymized_text": f"{OUTPUT} select request_id, idx, role, text from output",
        "token_checks": f"{MINTED} select kind, ok, n from (select count(distinct (request_id, token)) as n from minted), "
                        "(values ('right', true), ('wrong', false)) v(kind, ok)",
        "spelling_conflicts": f"""
            with s as (select request_id, entity_type, case when idx % 2 = 1 then upper(text) else text end as text from ({PER_CONV}))
            select request_id, entity_type, {CANON} as canonical, count(*) as n from s group by all having min(text) <> max(text)""",
        "screening_planted": f"""select 'c' || conv_id as request_id, cast(turn as int) as idx,
            case when conv_id % 3 = 1 then '{fixed.INVISIBLE}' else 'none' end as blocking, cast(case when conv_id % 3 = 0 then 2 else 0 end as bigint) as script from conversations""",
        "spelling_conflicts_planted": f"""
            with s as (select request_id, entity_type, text from ({PER_CONV}) union all select request_id, entity_type, upper(text) from ({PER_CONV}))
            select request_id, entity_type, {CANON} as canonical, count(*) as n from s group by all having min(text) <> max(text)""",
        "session_scopes": f"""select conv_id, turn, case when turn in (3, 4) then null when role = 'assistant'
            then 'agent_' || sha256({nested}) else 'agent_' || sha256({base}) end as session_scope,
            case turn when 3 then 'conflicting_session' when 4 then 'invalid_identifier' end as scope_error,
            'cache_' || sha256({cache}) as cache_key from conversations""",
        "vault_values": f"""{MINTED}, d as (select distinct conv_id, token, text from minted)
            select {CONV} as conversation_id, token, {STATUS} as status, case when {STATUS} = 'found' then text end as value from d""",
        "vault_purged": f"""{MINTED}, d as (select distinct conv_id, token from minted)
            select case when {LAST} = 5 then 't9' else {TENANT} end as tenant_id, count(*) as n from d where {LAST} not in (1, 2) group by 1""",
        "vault_erased": f"""{MINTED}, d as (select distinct conv_id, token from minted),
            asked as (select distinct conv_id from conversations where role = 'system')
            select {TENANT} as tenant_id, {CONV} as conversation_id, count(token) as n, 'removed' as what
            from asked left join d using (conv_id) group by conv_id
            union all select {TENANT}, {CONV}, count(*), 'left' from d where conv_id not in (select conv_id from asked) group by conv_id""",
        "vault_formats": f"""{MINTED}, d as (select distinct conv_id, token from minted where {LAST} = 3)
            select cast(2 as int) as record_format, count(*) as n from d having count(*) > 0""",
        "json_leaves": f"""{OUTPUT}, l as (select request_id, false as s, text from output union all select request_id, false, text from output
                union all select request_id, true, unnest(['model', 'm-1', 'n', 'messages', 'role', role, 'content', 'arguments', 'note', 'depth', idx::varchar]) from output)
            select request_id as record_id, s as structural, count(*) as n, cast(sum(length(text)) as bigint) as chars from l group by all""",
        "restored_json": f"{OUTPUT} select request_id as record_id, original as content, original as note from output",
        "reply_budget": f"""select 'c' || conv_id as request_id, cast(sum(strlen({planted(c.PLANTS, 'conv_id + turn')})) as bigint) as bytes,
            'restoration_refused' as reason from conversations group by conv_id having bytes > 2000""",
        "lookalikes": "select conv_id, turn from conversations where (conv_id + turn) % 7 not in (3, 5)",
        "sequence_problems": f"""select request_id, case when conv_id % 5 = 2 and m >= 1 then 'after_end'
            when conv_id % 5 = 2 then 'after_end' else 'sequence_violation' end as problem from {faults}
            where conv_id % 5 = 2 or (conv_id % 5 = 1 and m >= 2)""",
        "truncated_replies": f"select request_id from {faults} where conv_id % 5 = 3",
        "stream_limit_problems": """
            with b as (select conv_id, turn % 2 as block, sum(strlen(text)) as b, max(strlen(text)) as e from conversations group by all),
            r as (select conv_id, sum(b) as b, max(e) as e, count(*) as n from b group by conv_id)
            select 'c' || conv_id as request_id, case when e > 1500 then 'event_too_large' when n > 1 then 'provider_item_limit'
                when b > 2000 then 'provider_output_too_large' end as problem from r where e > 1500 or n > 1 or b > 2000""",
        "snapshot_mismatches": f"""
            with t as (select conv_id, turn % 2 as block, string_agg(text, '' order by turn) as text, max(turn) as lastturn from conversations group by all),
            x as (select t.*, f.m, not (conv_id % 5 = 4 and lastturn = 0) and lastturn >= f.m - 1 as closed from t join {faults} f using (conv_id))
            select 'c' || conv_id as request_id, 'b' || block as block, case when not closed then 'not_closed' else 'mismatch' end as problem
            from x where not closed or (conv_id % 7 = 0 and length(text) > 5)""",
        "call_batch_violations": """
            with calls as (select conv_id, 'tool' || turn % 4 as name, turn % 3 = 0 as custom from conversations where role = 'assistant'),
            counts as (select c.conv_id, count(k.name) as n from (select distinct conv_id from conversations) c left join calls k using (conv_id) group by 1)
            select distinct 'c' || conv_id as request_id, case when conv_id % 11 = 0 or name not in ('tool1', 'tool3') then 'undeclared_tool_call'
                when (name = 'tool3') <> custom then 'tool_choice_violation'
                when conv_id % 5 = 0 and (name <> 'tool1' or custom) then 'tool_choice_violation' end as problem
            from calls where problem is not null
            union select 'c' || conv_id, 'tool_choice_violation' from counts
            where n > case when conv_id % 3 = 0 then 1 else 2 end or (conv_id % 2 = 0 and n = 0)""",
        "auth_log": """select case when user_id % 3 = 0 then null else 't' || user_id % 4 end as tenant_id,
            case when user_id % 3 = 0 then 'invalid_api_key' end as reason, count(*) as n from events group by all""",
        "allowed_models": """select event_id, case when event_id % 2 = 0 then 'm-1' else 'm-2' end as model, 'model_not_allowed' as reason
            from events where user_id % 3 = 1 and event_id % 2 = 1""",
        # by the rule of a counter: one up at the start, one down at the end, ends before a start being over
        "in_flight": """
            with e as (select event_id, epoch_us(ts) / 1000000.0 as t, epoch_us(ts) / 1000000.0 + case when event_id % 7 = 0 then 0 else value end as u from events),
            o as (select *, row_number() over (order by t, event_id) as n from e),
            g as (select a.event_id, count(b.event_id) as gone from o a left join o b on b.n < a.n and b.u <= a.t group by 1)
            select event_id, n - gone as active, n - gone > 2 as over from o join g using (event_id)""",
        "audit": f"""{decided('off')}, counts as (select request_id, {audit_counts} as entity_counts, sum(n) as n from (
                select request_id, entity_type, count(*) as n from spans group by all) group by 1)
            select f.request_id, 't' || r.conv_id % 4 as tenant_id, f.action as decision, f.rule_name, case when f.action = 'block' then 'external' else f.destination end as destination,
                case when f.action = 'block' then 'none' else f.destination end as provider,
                coalesce(entity_counts, '') as entity_counts, cast(case when f.action in ('transform', 'route_local') then coalesce(c.n, 0) else 0 end as bigint) as entities_transformed,
                case when f.action = 'block' then 'blocked_by_policy' else 'none' end as error, false as raw_content_logged
            from final f join reqs r using (request_id) left join counts c using (request_id)""",
        "audit_refused": f"""
            with t as (select 'c' || conv_id || '-' || turn as request_id, (conv_id + turn) % {len(c.EVASIONS)} as k, length({planted(c.EVASIONS, 'conv_id + turn')}) as n from conversations),
            e as (select *, case when n > 900 then 'inspection_failed' when k = 6 then '{fixed.BIDI}' else 'none' end as error from t)
            select request_id, case when error <> 'none' then 'block' when k < 4 then 'route_local' when k = 4 then 'transform' else 'allow' end as decision,
                case when error <> 'none' then 'request-refused' when k < 4 then 'codes-stay-local' when k = 4 then 'people-as-tokens' else 'rest-passes' end as rule_name,
                case when error <> 'none' then 'none' when k < 4 then 'local' else 'external' end as destination,
                case when error <> 'none' then 'none' when k < 4 then 'local' else 'external' end as provider, 'example-1' as policy_version,
                cast(case when error = 'none' and k < 5 then 1 else 0 end as bigint) as entities_transformed, error from e""",
        "refused_requests": """select 'c' || conv_id as request_id, case when conv_id % 5 in (1, 3) then 'incomplete_scope' else 'no_messages' end as reason
            from (select distinct conv_id from conversations) where conv_id % 5 in (1, 2, 3) or conv_id % 10 = 4""",
        "audit_gaps": """select 'c' || conv_id || '-' || turn as request_id, cast(case when conv_id % 10 = 3 then 0 else 2 end as bigint) as events,
            case when conv_id % 10 = 3 then 'no_event' else 'many_events' end as problem from conversations where conv_id % 10 in (3, 7)""",
        "metrics": f"""{decided('off')} select 'requests_total' as metric, 'chat_completions,' || case when action = 'block' then '4xx' else '2xx' end
                || ',' || action || ',' || destination as labels, count(*) as value from final group by all
            union all select 'request_refusals_total', 'chat_completions,blocked_by_policy', count(*) from final where action = 'block' having count(*) > 0""",
        "leaks": "select cast(null as varchar) as request_id, cast(null as varchar) as entity_type, cast(null as bigint) as n where false",
        "leaks_untreated": f"{MINTED} select request_id, entity_type, count(distinct text) as n from minted group by all",
        "leaks_everywhere": f"""{MINTED}, v as (select distinct entity_type, text as value from minted),
            o as (select conv_id % 10 as c, conv_id, turn, {planted(c.PLANTS, 'conv_id + turn')} as text from conversations where conv_id % 10 < 3),
            h as (select c, entity_type, conv_id, turn, count(*) as n from o join v on contains(o.text, v.value) group by all)
            select list_extract(['reply', 'note', 'label'], cast(c as int) + 1) as kind, entity_type, count(*) as outputs, cast(sum(n) as bigint) as n from h group by all""",
        "span_scores": f"{scored()} select bucket, key, tp, fp, fn, support, round(precision, 4) as precision, round(recall, 4) as recall, round({F1}, 4) as f1 from s",
        "score_totals": f"{scored()} select cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from s where bucket = 'entity'",
        "threshold_gate": f"""{scored()}, g as (select *, case when key like 'PHONE_NUMBER/%' then 0.95 when key like 'IP_ADDRESS/%' then 0.85 else 0.99 end as min_precision,
                case when key like 'PHONE_NUMBER/%' or key like 'IP_ADDRESS/%' then 0.9 else 0.99 end as min_recall from s where bucket = 'entity_language')
            select key, tp, fp, fn, cast(min_precision as double) as min_precision, cast(min_recall as double) as min_recall from g
            where precision < min_precision or recall < min_recall""",
        "eval_report": f"""{scored()}, g as (select *, case when key like 'PHONE_NUMBER/%' then 0.95 when key like 'IP_ADDRESS/%' then 0.85 else 0.99 end as min_precision,
                case when key like 'PHONE_NUMBER/%' or key like 'IP_ADDRESS/%' then 0.9 else 0.99 end as min_recall from s where bucket = 'entity_language')
            select 'scores' as part, cast(sum(fp + fn) as bigint) as n from s where bucket = 'entity'
            union all select 'failures', count(*) from outcomes where outcome <> 'tp'
            union all select 'gate', count(*) from g where precision < min_precision or recall < min_recall
            union all select 'thresholds', {len(fixed.THRESHOLDS)}""",
        "failures": f"""{scored()} select id as example_id, kind, lang, case when outcome = 'fn' then 'missed' else 'spurious' end as reason, entity_type,
            start, "end" from outcomes where outcome <> 'tp' """,
        "baseline_regressions": f"""{scored()}, e as (select * from s where bucket = 'entity'), w as (select unnest([{', '.join(q(t) for t in sorted(fixed.THRESHOLDS))}]) as entity_type)
            select entity_type, case when precision is null then 'missing' when precision < 1 then 'precision_regressed' else 'recall_regressed' end as problem
            from w left join e on e.key = w.entity_type where precision is null or precision < 1 or recall < 1""",
        "latency": """
            with v as (select event_type as stage, value as ms, row_number() over (partition by event_type order by value) as rn,
                count(*) over (partition by event_type) as n from events)
            select stage, max(n) as iterations, round(median(ms), 3) as p50_ms,
                round(min(ms) filter (rn = greatest(1, floor(n * 0.95))), 3) as p95_ms, round(min(ms) filter (rn = greatest(1, floor(n * 0.99))), 3) as p99_ms,
                round(max(ms), 3) as max_ms, round(avg(ms), 3) as mean_ms, min(ms) filter (rn = greatest(1, floor(n * 0.95))) <= 150 as within_budget
            from v group by stage""",
        "split_overlap": """
            with d as (select distinct unnest(string_split(text, chr(10))) as t from documents), b as (select distinct unnest(string_split(text, chr(10))) as t from benchmark)
            select 'text' as what, count(*) as n from (select t from d intersect select t from b) having count(*) > 0
            union all select 'shape', count(*) from (select regexp_replace(t, '[0-9]', '#', 'g') from d intersect select regexp_replace(t, '[0-9]', '#', 'g') from b) having count(*) > 0""",
        "coverage_gap": f"""select entity_type from (select unnest([{', '.join(q(t) for t in sorted(fixed.THRESHOLDS))}]) as entity_type)
            where entity_type not in (select entity_type from ({PER_TURN}) where entity_type <> 'PRIVATE_KEY')""",
        "corpus_checks": f"""
            with e as (select conv_id, turn, (conv_id + turn) % {len(c.PLANTS)} as k from conversations), h as (select k, count(*) as n from {truth(c.PLANTS)} group by k),
            x as (select e.*, coalesce(h.n, 0) as n from e left join h using (k))
            select 'c' || conv_id as id, 'duplicate_id' as problem from x where conv_id % 9 = 1 group by conv_id having count(*) > 1
            union all select 'c' || conv_id || '-' || turn, 'control_with_gold' from x where conv_id % 9 = 2 and n > 0
            union all select case when conv_id % 9 = 1 then 'c' || conv_id else 'c' || conv_id || '-' || turn end, 'out_of_bounds' from x where conv_id % 9 = 4 and n > 0""",
        "path_comparison": """
            with r as (select 'p' || user_id % 2 as protocol, event_type as profile, user_id % 3 as size, event_id % 2 = 0 as direct, event_id % 10 = 0 as failed, value from events)
            select protocol, profile, size, quantile_cont(value, 0.5) filter (direct and not failed) as direct_total_ms_p50,
                quantile_cont(value, 0.5) filter (not direct and not failed) as gateway_total_ms_p50,
                quantile_cont(value, 0.5) filter (not direct and not failed) - quantile_cont(value, 0.5) filter (direct and not failed) as total_ms_p50_change,
                avg(cast(failed as int)) filter (direct) as direct_failure_rate, avg(cast(failed as int)) filter (not direct) as gateway_failure_rate,
                count(*) filter (direct) as direct_runs, count(*) filter (not direct) as gateway_runs from r group by all""",
        "request_contract": f"""select conv_id, turn, list_extract(['accepted', 'invalid_request', 'streaming_unsupported', 'uninspectable_field', 'unknown_field',
            'unsupported_role', 'inspection_failed', 'invalid_message', 'invalid_json', 'invalid_request'], cast({kind} as int) + 1) as reason from conversations""",
        "json_violations": f"""select conv_id, turn, case conv_id % 5 when 1 then 'invalid_json' when 2 then 'request_too_large' when 3 then 'invalid_json'
            else case when {kind} = 8 then 'invalid_json' else 'none' end end as violation from conversations""",
        "capped_requests": f"""select 'c' || conv_id as request_id, cast(sum(length({planted(c.PLANTS, 'conv_id + turn')})) as bigint) as n_chars,
            'inspection_failed' as reason from conversations group by conv_id having n_chars > 2000""",
        "kept_fields": "select 'c' || conv_id as request_id, cast(turn as int) as idx, role from conversations",
        "structural_hits": "select 'c' || conv_id || '-' || turn as record_id, 'sensitive_structure' as reason from conversations where turn = 2",
        "tool_pairing": """
            with b as (select conv_id, turn as pos, role = 'assistant' as call, (turn + case when role = 'assistant' then 1 else 0 end) // 4 as id from conversations where role <> 'system'),
            g as (select conv_id, id, count(*) filter (call) as calls, count(*) filter (not call) as results, min(pos) filter (call) as c, min(pos) filter (not call) as r from b group by all)
            select 'c' || conv_id as request_id, 'id-' || id as id, 'duplicate_call' as problem from g where calls > 1
            union all select 'c' || conv_id, 'id-' || id, 'orphan_result' from g where calls = 0 and results > 0
            union all select 'c' || conv_id, 'id-' || id, 'result_before_call' from g where calls > 0 and r < c
            union all select 'c' || conv_id, 'id-' || id, 'reused_result' from g where results > 1""",
        "tool_declarations": f"""select request_id, name, 'duplicate_tool' as problem from {tools} group by all having count(*) > 1
            union all select distinct 'c' || conv_id, 'tool3', 'undeclared_choice' from conversations where conv_id not in (
                select conv_id from {tools} where name = 'tool3' and not fn)""",
        "preview": f"""{decided('detected')}, found as (select request_id, count(*) as n from spans group by 1)
            select f.request_id, cast(r.turn as int) as idx, cast(coalesce(n, 0) as int) as n_detections, base_action, action,
                cast(case when action = 'block' then null else length({planted(c.PLANTS, 'conv_id + turn')}) + coalesce(d.delta, 0) end as int) as output_chars
            from final f join reqs r using (request_id) join (select conv_id, turn, text from conversations) v using (conv_id, turn)
            left join found using (request_id)
            left join (select request_id, sum(length(entity_type) + 38 - length(text)) as delta from spans group by 1) d using (request_id)""",
        "restored_text": f"""{RESTORED} select x.request_id, back || ' {FORGED} ' || coalesce(case when own.outcome = 'restored' then own_text
                else foreign_token end, '') as text from (select b.*, t.foreign_token from back b join tail t using (request_id)) x
            left join (select distinct o.request_id, o.token, o.outcome, m.text as own_text from own o join minted m using (request_id, token)) own
                on own.request_id = x.request_id and own.token = x.foreign_token""",
        "stream_restored": f"""{RESTORED} select x.request_id, back || ' {FORGED} ' || coalesce(case when own.outcome = 'restored' then own_text
                else foreign_token end, '') as text from (select b.*, t.foreign_token from back b join tail t using (request_id)) x
            left join (select distinct o.request_id, o.token, o.outcome, m.text as own_text from own o join minted m using (request_id, token)) own
                on own.request_id = x.request_id and own.token = x.foreign_token""",
        "stream_reordered": f"""{RESTORED} select x.request_id, back || ' {FORGED} ' || coalesce(case when own.outcome = 'restored' then own_text
                else foreign_token end, '') as text from (select b.*, t.foreign_token from back b join tail t using (request_id)) x
            left join (select distinct o.request_id, o.token, o.outcome, m.text as own_text from own o join minted m using (request_id, token)) own
                on own.request_id = x.request_id and own.token = x.foreign_token""",
        "stream_deadlines": """select 'c' || conv_id as request_id, case when conv_id % 5 = 1 then 'truncated'
                when conv_id % 5 in (2, 3) then 'truncated'
                when conv_id % 5 = 4 then 'sequence_violation' end as refusal from conversations group by conv_id""",
        "restore_outcomes": f"""{REPLIES},
            own_tokens as (select o.request_id, p.token, p.rn, p.start + coalesce((select sum(length(x.token) - length(x.text)) from pieces x
                where x.request_id = p.request_id and x.rn < p.rn), 0) as s from output o join pieces p using (request_id)){TAIL}
            select request_id, cast(s as int) as start, cast(s + length(token) as int) as "end", token, outcome from own_tokens join own using (request_id, token)
            union all select request_id, cast(len + 1 as int), cast(len + 1 + {len(FORGED)} as int), '{FORGED}', 'not_minted' from tail
            union all select t.request_id, cast(len + 2 + {len(FORGED)} as int), cast(len + 2 + {len(FORGED)} + length(foreign_token) as int), foreign_token,
                coalesce(own.outcome, 'not_minted') from tail t left join own on own.request_id = t.request_id and own.token = t.foreign_token
                where foreign_token is not null""",
    }
    sources = "(select distinct source, cast(substr(source, 4) as int) as k from documents)"
    found |= {
        "tokens_erased": f"""{MINTED}, d as (select distinct conv_id, token, entity_type from minted)
            select {TENANT} as tenant_id, {CONV} as conversation_id, count(*) as n from d where entity_type <> 'EMAIL_ADDRESS' group by conv_id""",
        "token_clashes": f"""{MINTED} select distinct {TENANT} as tenant_id, {CONV} as conversation_id, token from minted where conv_id % 3 = 0""",
        "token_clashes_between_batches": f"""{MINTED} select distinct {TENANT} as tenant_id, {CONV} as conversation_id, token from minted where conv_id % 3 = 0""",
        "pseudonymized_stream": f"{OUTPUT} select request_id, idx, role, text from output",
        "rules_loaded": """
            with s as (select source, row_number() over (order by source) - 1 as k from (select distinct source from documents where source is not null)),
            d as (select doc_id, k, source from documents left join s using (source))
            select case when k % 3 <> 0 and doc_id % 10 >= 5 then source else 'rest' end as rule_name,
                case when k % 3 <> 0 and doc_id % 10 >= 5 then case k % 2 when 0 then 'block' else 'transform' end else 'allow' end as action,
                'of-sources' as policy_version, count(*) as n from d group by all""",
        "implicitly_denied": f"""select case lang when 'en' then 'english' when 'de' then 'german' else {q(fixed.IMPLICIT_DENY)} end as rule_name,
            case lang when 'en' then 'allow' when 'de' then 'transform' else 'block' end as action, count(*) as n from documents group by all""",
        "filters_loaded": f"""
            with f as (select * from ({words("select lower(regexp_extract(text, '^[A-Za-z]+')) from benchmark where regexp_extract(text, '^[A-Za-z]+') <> ''")})),
            g as (select unnest(regexp_extract_all(text, '[0-9]{{7}}')) as m from documents)
            select 'OPENING' as entity_type, count(*) as n, cast(sum(length(text)) as bigint) as chars, 'transform' as action from f having count(*) > 0
            union all select 'SEVEN_DIGITS', count(*), 7 * count(*), 'block' from g having count(*) > 0""",
        "corpus_read": """select case conv_id % 2 when 0 then 'dev' else 'holdout' end as split, '1.' || (conv_id % 2) || '.0' as version, role as lang,
            count(*) as n, cast(sum(length(text)) as bigint) as chars from conversations group by all""",
        "keys_read": """select case when user_id % 4 <> 1 then 't' || (user_id % 3) end as tenant_id, case when user_id % 4 = 1 then 'invalid_api_key' end as reason,
            case when user_id % 4 <> 1 then case user_id % 2 when 0 then 1 else 0 end end as n_models, count(*) as n from events group by all""",
        "withheld_calls": f"""
            with t as (select conv_id, turn % 2 as block, sum(length(text)) as chars, max(turn) as last, bool_or(not (conv_id % 5 = 4 and turn = 0) and turn >= m - 1) as closed
                from (select *, max(turn) over (partition by conv_id) as m from conversations) group by all),
            w as (select conv_id, bool_and(closed) as whole from t group by conv_id)
            select 'c' || conv_id as request_id, 'b' || block as block, cast(chars as int) as chars from t join w using (conv_id)
            where whole and conv_id % 5 <> 3 and conv_id % 7 <> 0""",
        "audit_written": f"""{decided('off')} select action as decision, rule_name, case when action = 'block' then 'external' else destination end as destination, count(*) as n
            from final group by all""",
        "reasons": """
            with r as (select list_extract(['contract', 'screening', 'inspection', 'timeout', 'routing', 'egress', 'provider', 'vault', 'cancelled', 'other'], cast((conv_id + turn) % 10 as int) + 1) as source,
                list_extract(['unknown_field', 'no such code', 'rate_limit_exceeded'], cast(conv_id % 3 as int) + 1) as code from conversations)
            select source, code, case source when 'contract' then case code when 'unknown_field' then code else 'invalid_request' end
                when 'screening' then case code when 'no such code' then 'inspection_failed' else code end when 'inspection' then 'inspection_failed'
                when 'timeout' then 'detector_timeout' when 'routing' then 'local_routing_violation' when 'egress' then 'egress_blocked'
                when 'provider' then case code when 'no such code' then 'provider_error' else code end when 'vault' then 'vault_error'
                when 'cancelled' then 'cancelled' else 'internal_error' end as reason, count(*) as n from r group by all""",
        # one event after the other, as a counter would see them
        "rate_limited": """
            with recursive c as (select cast(1 as double) / 60 as rate),
            e as (select event_id, user_id, epoch_us(ts) / 1000000.0 as t, row_number() over (partition by user_id order by ts, event_id) as rn from events),
            r as (select event_id, user_id, rn, t, true as admitted, cast(0 as double) as level, cast(null as double) as wait from e where rn = 1
                union all select event_id, user_id, rn, t, tokens >= 1, tokens - case when tokens >= 1 then 1 else 0 end, case when tokens < 1 then (1 - tokens) / rate end
                from (select e.event_id, e.user_id, e.rn, e.t, c.rate, least(cast(1 as double), r.level + (e.t - r.t) * c.rate) as tokens
                    from r join e on e.user_id = r.user_id and e.rn = r.rn + 1 cross join c))
            select event_id, admitted, case when not admitted then cast(greatest(1, ceil(wait)) as int) end as retry_after from r""",
        "slots_with_refusals": """
            with recursive e as (select event_id, epoch_us(ts) / 1000000.0 as t, value as d, row_number() over (order by ts, event_id) as rn from events),
            r as (select event_id, rn, true as admitted, [t + d] as ends from e where rn = 1
                union all select event_id, rn, len(live) < 2, case when len(live) < 2 then list_append(live, t + d) else live end
                from (select e.event_id, e.rn, e.t, e.d, list_filter(r.ends, lambda x: x > e.t) as live from r join e on e.rn = r.rn + 1))
            select event_id, admitted, not admitted as refund from r""",
        "admitted": """
            with recursive e as (select event_id, user_id % 2 + 1 as k, epoch_us(ts) / 1000000.0 as t, greatest(coalesce(value, 0), 0) as d, row_number() over (order by ts, event_id) as rn from events),
            r as (
                select cast(0 as bigint) as rn, cast(0 as bigint) as event_id, true as admitted, cast(null as varchar) as reason, cast(null as double) as wait,
                    cast([] as double[]) as ends, list_transform(range(2), lambda i: {'tokens': cast(1 as double), 'at': cast(null as double)}) as b
                union all
                select rn, event_id, tokens >= 1 and len(live) < 2, case when tokens < 1 then 'rate_limit_exceeded' when len(live) >= 2 then 'capacity_exceeded' end,
                    case when tokens < 1 then (1 - tokens) / (1.0::double / 60) end,
                    case when tokens >= 1 and len(live) < 2 then list_append(live, t + d) else live end,
                    list_concat(list_append(b[1:k - 1], {'tokens': case when tokens < 1 then tokens when len(live) < 2 then tokens - 1 else least(1, tokens - 1 + 1) end,
                        'at': greatest(coalesce(b[k].at, t), t)}), b[k + 1:])
                from (select e.rn, e.event_id, e.k, e.t, e.d, r.b, list_filter(r.ends, lambda x: x > e.t) as live,
                        least(cast(1 as double), r.b[e.k].tokens + greatest(0, e.t - coalesce(r.b[e.k].at, e.t)) * (1.0::double / 60)) as tokens
                    from r join e on e.rn = r.rn + 1))
            select event_id, admitted, reason, case when reason = 'rate_limit_exceeded' then cast(greatest(1, ceil(wait)) as int) end as retry_after,
                coalesce(reason = 'capacity_exceeded', false) as refund from r where rn > 0""",
        "rule_problems": f"""
            with s as (select case when k % 7 = 1 then '' else source end as name, k from {sources})
            select name, case k % 7 when 1 then 'missing_name' when 2 then 'unknown_action' when 3 then 'bad_entities' else 'bad_min_score' end as problem
            from s where k % 7 between 1 and 4
            union all select '', 'duplicate_name' from s where name = '' having count(*) > 1
            union all select '-', 'no_catch_all'""",
        "composed_rules": f"""
            with a as (select action from (select distinct rule_name, action from {POLICY})
                union all select case when k % 7 = 2 then 'drop' else 'transform' end from {sources} where k % 7 <> 1)
            select 'example-1+by-source' as version, action, count(*) as n from a group by action""",
        "uncovered_types": f"select distinct case when k % 7 = 3 then ' ' else 'TYPE_' || k end as entity_type from {sources}",
        "restorable": "select role as field, role = 'assistant' as restorable, count(*) as n from conversations group by all",
        "corpus_written": """select case when conv_id % 2 = 0 then 'dev' else 'holdout' end as split, role as lang, count(*) as n,
            cast(sum(length(text)) as bigint) as chars from conversations group by all""",
    }
    count = "cast(count(*) filter (outcome {}) as bigint)"
    reasons = ", ".join(count.format(f"= '{r}'") + f" as {r}" for r in ("not_minted", "vault_miss", "key_unavailable"))
    found["restore_totals"] = (
        f"select request_id, {count.format(chr(61) + ' ' + q('restored'))} as tokens_restored, {count.format('<> ' + q('restored'))} as tokens_refused, {reasons} "
        f"from ({found['restore_outcomes']}) group by request_id")
    # the same results by another way
    found["stream_lookups"], found["restored_from_store"] = found["vault_values"], found["restored_text"]
    named = located(f"(select 'c' || conv_id || '|' || turn as k, {planted(c.PLANTS, 'conv_id + turn')} as text from conversations)", "k", "Konts|Bearer|Bot")
    found["model_spans"] = (
        f"select split_part(k, '|', 1) as request_id, cast(split_part(k, '|', 2) as int) as idx, start, \"end\", 'ORG' as entity_type, text, "
        f"cast(0.9 as double) as score, 'ner' as detector from {named}")
    return found
