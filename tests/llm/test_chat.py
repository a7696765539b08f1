"""Role repair against an exhaustive search, segments against whole conversations, defined cases."""

import random
from itertools import product

import pytest

from maskwright.llm import chat


def exhaustive(roles):
    """Lowest cost over all ways to label, merge and insert, found by trying every repaired sequence."""
    best = None
    n = len(roles)
    for merges in product([False, True], repeat=max(n - 1, 0)):
        groups = [[0]] if n else []
        for k, m in enumerate(merges, 1):
            if m:
                groups[-1].append(k)
            else:
                groups.append([k])
        for labels in product((1, 2, 3), repeat=len(groups)):
            cost = chat.MERGE * sum(merges) + sum(chat.RELABEL * (roles[k] != lab) for g, lab in zip(groups, labels) for k in g)
            # empty turns needed between labels
            state = 0
            for lab in labels:
                path = chat._between(state, [s for s in range(4) if lab in chat.LEGAL[s]])
                if path is None:
                    break
                cost += chat.INSERT * len(path)
                state = lab
            else:
                cost += chat.INSERT * len(chat.CLOSING[state])
                best = cost if best is None else min(best, cost)
    return best


def test_cost_is_the_lowest():
    for n in range(1, 5):
        for roles in product(range(4), repeat=n):
            assert chat.repair_cost(list(roles)) == exhaustive(roles), roles
    rng = random.Random(2)
    for _ in range(30):
        roles = [rng.randint(0, 3) for _ in range(6)]
        assert chat.repair_cost(roles) == exhaustive(roles), roles


def test_segments_give_the_same_repair():
    rng = random.Random(4)
    for _ in range(200):
        roles = [rng.randint(0, 3) for _ in range(rng.randint(1, 25))]
        whole = chat.forward(roles, {0: 0})[0]
        end = chat.closed(whole)
        cuts = sorted(rng.sample(range(1, len(roles)), min(3, len(roles) - 1)))
        pieces = [roles[a:b] for a, b in zip([0, *cuts], [*cuts, len(roles)])]
        segments = [(k, len(p), {s: chat.forward(p, {s: 0})[0] for s in range(4)}) for k, p in enumerate(pieces)]
        settled = chat.settle(segments)
        total, steps, turns = 0, 0, 0
        for k, p in enumerate(pieces):
            entry, leave, at, out, last = settled[k]
            assert (at, out) == (steps, turns) and last == (k == len(pieces) - 1)
            way = chat.repair(p, entry, leave)
            total += segments[k][2][entry][leave]
            steps += len(p) + sum(len(path) for _, _, path in way)
            turns += sum(len(path) + (what != "merge") for _, what, path in way)
        assert total == whole[end]


def legal(roles):
    state = 0
    for r in roles:
        assert chat.ROLES.index(r) in chat.LEGAL[state], roles
        state = chat.ROLES.index(r)
    assert state in chat.ENDS


def rendered(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.step):
        out.setdefault(r.conv_id, []).append(r)
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_query(spark, sf, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = chat.op9_chat(spark, sf).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    given = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        given.setdefault(r.conv_id, []).append(r)
    got = rendered(rows)
    assert got.keys() == given.keys()
    for conv, turns in given.items():
        turns.sort(key=lambda r: (r.turn, r.role, r.text))
        steps = got[conv]
        assert [s.step for s in steps] == list(range(len(steps)))
        used = [s for s in steps if s.action in ("keep", "relabel", "merge")]
        assert [s.turn for s in used] == [t.turn for t in turns]
        merged = {}
        for s in steps:
            merged.setdefault(s.out_turn, s.role)
        assert list(merged) == list(range(len(merged)))
        legal(list(merged.values()))
        kinds = [s.action for s in steps]
        wrong = sum(chat.role_of(t.role) != chat.ROLES.index(s.role) for s, t in zip(used, turns))
        cost = chat.MERGE * kinds.count("merge") + chat.INSERT * kinds.count("insert") + chat.RELABEL * wrong
        assert cost == chat.repair_cost([chat.role_of(t.role) for t in turns])
        text = "".join(s.piece for s in steps)
        assert text.count(chat.CLOSE) >= len(merged) and text.endswith(chat.CLOSE) and all((t.text or "") in text for t in turns)


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(9)
    turns = [(1, k // 3, rng.choice(["user", "assistant", "tool", "system"]), f"t{k % 50}", 0) for k in range(3000)]
    frame = spark.createDataFrame(turns + [(0, 0, "user", "a", 0), (2, 0, "assistant", "b", 0)], "conv_id long, turn long, role string, text string, step int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    texts = []
    try:
        for n in (1, 9):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = chat.format_chats(frame).collect()
            texts.append({c: (len(s), {r.out_turn: r.role for r in s}, sum(r.action == "insert" for r in s), sorted(r.turn for r in s if r.turn is not None)) for c, s in rendered(rows).items()})
            legal(list(texts[-1][1][1].values()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert texts[0].keys() == texts[1].keys() == {0, 1, 2}
    assert [texts[0][1][k] for k in (0, 2, 3)] == [texts[1][1][k] for k in (0, 2, 3)] and len(texts[0][1][1]) == len(texts[1][1][1])


def test_defined_cases(spark):
    rows = [(1, 0, "USER ", None, 0), (1, 1, None, "x", 0), (None, 0, "user", "n", 0), (None, None, "system", "s", 0), (3, 0, "assistant", "hi", 0), (3, 0, "assistant", "hi", 0),
            (4, 0, "user", "y" * 200_000, 0)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int")
    got = {c: "".join(s.piece for s in steps) for c, steps in rendered(chat.format_chats(frame).collect()).items()}
    assert got[1] == "<|user|>\n<|end|>\n<|assistant|>\nx<|end|>\n"
    assert got[None] == "<|system|>\ns<|end|>\n<|user|>\nn<|end|>\n<|assistant|>\n<|end|>\n"
    assert len(got[4]) > 200_000 and got[4].endswith("<|assistant|>\n<|end|>\n")
    assert got[3] == "<|user|>\nhi<|end|>\n<|assistant|>\nhi<|end|>\n"
    assert chat.format_chats(frame.limit(0)).count() == 0
