"""Chat formatting with minimum-cost role repair.

A legal conversation is a path through a small automaton: an optional system turn, then user and
assistant in turn, ending with the assistant. The turns of a conversation are read in order, and each
is kept, relabelled, or merged into the turn before; empty turns may be inserted before it, and at
the end. Dynamic programming over the states of the automaton finds the repair of the lowest cost; of
several, the one with the fewest insertions, then the fewest merges. The repaired turns are then
rendered by a template, as one piece of text per step, and the pieces of a conversation in order are
the formatted conversation.

A conversation may hold any share of all turns. Turns are sorted across the cluster by conversation
and turn, and a conversation that runs over the border of a partition is solved in segments: what a
segment can do is a matrix over the states before and after it, and a segment's matrix is the product,
in the algebra of minimum and sum, of the matrices of its turns. Only these matrices, at most two per
partition, meet on the driver, which settles the states at the borders; each segment then traces its
own steps between its two states. No task holds more than a partition.

Defined cases: roles are compared without case and outer spaces, and a null or other role fits no
state, so it is relabelled or merged; a null text is empty; turns are in the order of turn (null
first), then role, then text; repeated rows are turns of their own; the rows without conv_id are one
conversation; an empty table gives no rows; extra columns are not used.
"""

from __future__ import annotations

import ast
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import arrow_rows, materialize, table

ROLES = ("", "system", "user", "assistant")
#: What may follow a state, by places in ROLES; state 0 is the start.
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
ENDS = (0, 3)
#: Costs of a repair.
MERGE, RELABEL, INSERT = 1, 2, 3
#: Template: before and after the text of a turn, and between the texts of merged turns.
OPEN, CLOSE, JOIN = "<|{role}|>\n", "<|end|>\n", "\n"


def weight(cost: int, inserts: int = 0, merges: int = 0) -> int:
    """One number that orders repairs by cost, then insertions, then merges, and adds up."""
    return cost << 80 | inserts << 40 | merges


def inserts_of(w: int) -> int:
    return w >> 40 & (1 << 40) - 1


def merges_of(w: int) -> int:
    return w & (1 << 40) - 1


def _between(state: int, goals) -> tuple[int, ...] | None:
    """Fewest turns to insert after ``state`` so that one of ``goals`` is the state."""
    queue, seen = deque([(state, ())]), {state}
    while queue:
        at, path = queue.popleft()
        if at in goals and (path or at == state):
            return path
        for role in LEGAL[at]:
            if role not in seen:
                seen.add(role)
                queue.append((role, (*path, role)))
    return None


def _steps() -> list[list[list[tuple[int, int, str, tuple[int, ...]]]]]:
    """By role and state: the ways to go on, as (next state, weight, what is done, inserted roles)."""
    out = []
    for role in range(4):
        by_state = []
        for state in range(4):
            ways = []
            for goal in (1, 2, 3):
                before = [s for s in range(4) if goal in LEGAL[s]]
                path = _between(state, before)
                if path is not None:
                    wrong = role != goal
                    ways.append((goal, weight(INSERT * len(path) + RELABEL * wrong, len(path)), "relabel" if wrong else "keep", path))
            if state:
                ways.append((state, weight(MERGE + RELABEL * (role != state), 0, 1), "merge", ()))
            by_state.append(ways)
        out.append(by_state)
    return out


STEPS = _steps()
CLOSING = {s: _between(s, ENDS) for s in range(4)}


def role_of(name: str | None) -> int:
    """Place in ROLES, 0 for any other role."""
    name = (name or "").strip().lower()
    return ROLES.index(name) if name in ROLES else 0


def forward(roles: list[int], start: dict[int, int]) -> tuple[dict[int, int], list[dict[int, tuple]]]:
    """Lowest weights by state after all turns, and for each turn how each state was reached."""
    best, trace = start, []
    for role in roles:
        new: dict[int, int] = {}
        how: dict[int, tuple] = {}
        for state in sorted(best):
            for goal, w, what, path in STEPS[role][state]:
                total = best[state] + w
                if goal not in new or total < new[goal]:
                    new[goal], how[goal] = total, (state, what, path)
        best = new
        trace.append(how)
    return best, trace


def closed(best: dict[int, int]) -> int:
    """The last state of the best repair, with the turns inserted at the end counted in."""
    return min(sorted(best), key=lambda s: best[s] + weight(INSERT * len(CLOSING[s]), len(CLOSING[s])))


def repair(roles: list[int], entry: int = 0, leave: int | None = None) -> list[tuple[int, str, tuple[int, ...]]]:
    """For each turn, its role, what is done, and the roles inserted before it."""
    best, trace = forward(roles, {entry: 0})
    state = closed(best) if leave is None else leave
    out = []
    for how in reversed(trace):
        before, what, path = how[state]
        out.append((state, what, path))
        state = before
    return out[::-1]


def repair_cost(roles: list[int]) -> int:
    best, _ = forward(roles, {0: 0})
    state = closed(best)
    return (best[state] >> 80) + INSERT * len(CLOSING[state])


def settle(segments: list[tuple[int, int, dict[int, dict[int, int]]]]) -> dict[int, tuple[int, int, int, int, bool]]:
    """For the segments of one conversation, (part, turns, matrix) in order: by part, the states before and after, the
    steps and the repaired turns before it, and whether it is the last."""
    best, traces = {0: 0}, []
    for _, _, matrix in segments:
        new, how = {}, {}
        for before in sorted(best):
            for after, w in sorted(matrix[before].items()):
                if after not in new or best[before] + w < new[after]:
                    new[after], how[after] = best[before] + w, before
        best = new
        traces.append(how)
    states = [closed(best)]
    for how in reversed(traces):
        states.append(how[states[-1]])
    states = states[::-1]
    out, steps, turns = {}, 0, 0
    for k, (part, n, matrix) in enumerate(segments):
        out[part] = (states[k], states[k + 1], steps, turns, k == len(segments) - 1)
        w = matrix[states[k]][states[k + 1]]
        steps += n + inserts_of(w)
        turns += n + inserts_of(w) - merges_of(w)
    return out


def placed(turns: DataFrame) -> DataFrame:
    """``turns`` in one order over the whole table: part and pos beside conv_id, turn, role, text."""
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    keys = ["conv_id", "turn", "role", "text", "row"]
    # equal rows may stand in any order, but a partition must not have to take all of them
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = pa.schema([("part", pa.int64()), ("pos", pa.int64()), ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield arrow_rows(schema, {"part": [part] * n, "pos": list(range(at, at + n))} | {c: batch.column(k) for k, c in enumerate(schema.names[2:])})
            at += n

    return materialize(dealt.drop("row").mapInArrow(run, "part long, pos long, conv_id long, turn long, role string, text string"), "turns")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, bool, list[dict]]]:
    """The rows of each conversation of each part, with whether it is at a border of its part."""
    part, conv, first, held = None, None, True, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part or row["conv_id"] != conv or not held:
                if held:
                    yield part, conv, first or row["part"] != part, held
                    first = row["part"] != part
                part, conv, held = row["part"], row["conv_id"], []
            held.append(row)
    if held:
        yield part, conv, True, held


def format_chats(turns: DataFrame, opening: str = OPEN, closing: str = CLOSE, join: str = JOIN) -> DataFrame:
    """The repaired conversations, a row for each step: conv_id, step, out_turn, role, action, turn, piece.

    action is keep, relabel, merge or insert; turn is that of the row, null for inserted turns; out_turn counts the
    repaired turns. The pieces of a conversation, in the order of step, are its text."""
    rows = placed(turns)
    borders = pa.schema([("part", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64()), ("matrix", pa.string())])

    def at_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, conv, border, held in runs(batches):
            if border:
                roles = [role_of(r["role"]) for r in held]
                matrix = repr({s: forward(roles, {s: 0})[0] for s in range(4)})
                yield arrow_rows(borders, {"part": [part], "conv_id": [conv], "n": [len(held)], "matrix": [matrix]})

    narrow = rows.select("part", "pos", "conv_id", "role").repartition("part").sortWithinPartitions("part", "pos")
    found: dict[int | None, list] = {}
    # two rows for each partition at most
    for r in narrow.drop("pos").mapInArrow(at_borders, "part long, conv_id long, n long, matrix string").collect():
        found.setdefault(r["conv_id"], []).append((r["part"], r["n"], ast.literal_eval(r["matrix"])))
    settled = {(part, conv): s for conv, segments in found.items() for part, s in settle(sorted(segments, key=lambda x: x[0])).items()}
    known = rows.sparkSession.sparkContext.broadcast(settled)
    schema = pa.schema([
        ("conv_id", pa.int64()), ("step", pa.int64()), ("out_turn", pa.int64()), ("role", pa.string()), ("action", pa.string()),
        ("turn", pa.int64()), ("piece", pa.string()),
    ])

    def steps_of(part: int, conv: int | None, held: list[dict]) -> Iterator[tuple]:
        entry, leave, step, out_turn, last = known.value.get((part, conv), (0, None, 0, 0, True))
        roles = [role_of(r["role"]) for r in held]
        state = entry

        def begun(role: int) -> str:
            return (closing.format(role=ROLES[state]) if state else "") + opening.format(role=ROLES[role])

        for row, (role, what, path) in zip(held, repair(roles, entry, leave)):
            for added in path:
                yield conv, step, out_turn, ROLES[added], "insert", None, begun(added)
                step, out_turn, state = step + 1, out_turn + 1, added
            text = row["text"] or ""
            if what == "merge":
                yield conv, step, out_turn - 1, ROLES[role], what, row["turn"], join + text
            else:
                yield conv, step, out_turn, ROLES[role], what, row["turn"], begun(role) + text
                out_turn += 1
            step, state = step + 1, role
        if last:
            for added in CLOSING[state]:
                yield conv, step, out_turn, ROLES[added], "insert", None, begun(added)
                step, out_turn, state = step + 1, out_turn + 1, added
            yield conv, step, out_turn - 1, ROLES[state], "close", None, closing.format(role=ROLES[state])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for part, conv, _, held in runs(batches):
            for step in steps_of(part, conv, held):
                out.append(step)
                if len(out) >= 2_000:
                    yield arrow_rows(schema, dict(zip(schema.names, map(list, zip(*out)))))
                    out = []
        if out:
            yield arrow_rows(schema, dict(zip(schema.names, map(list, zip(*out)))))

    dealt = rows.repartition("part").sortWithinPartitions("part", "pos").drop("pos")
    return dealt.mapInArrow(run, "conv_id long, step long, out_turn long, role string, action string, turn long, piece string")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
