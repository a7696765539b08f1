"""Chunks in any order and any batches: one verdict, one text. The processor is driven with plain dictionaries for states."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.functions import fixed
from maskwright.streaming.chunks import Align, open_token_at

TOKEN = "<CUSTOMER_TERM:v1:%s>" % ("a" * 32)


class Value:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Map(dict):
    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):
        return Value()

    def getMapState(self, *_):
        return Map()

    def registerTimer(self, at):
        self.timers.append(at)


def chunk(seq, delta="", kind="text", block="b", final=False, at=0):
    return SimpleNamespace(seq=seq, block=None if kind == "end" else block, delta=delta, final=final or kind == "end", kind=kind, at=at)


def run(batches, clock=None, idle=120, total=600, max_waiting=1 << 20, watermark=None, **limits):
    """Rows of all batches, the timers fired at the end where the watermark has passed them."""
    processor = Align(limits.get("max_bytes", 1 << 20), limits.get("max_blocks", 100), idle, total, clock, max_waiting)
    processor.init(Handle())
    times = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0, getCurrentWatermarkInMs=lambda: watermark)
    out = []
    for rows in batches:
        if rows:
            out += processor.handleInputRows(("r",), iter(rows), times)
    if watermark is not None:
        for at in sorted(processor.handle.timers):
            if at <= watermark:
                out += processor.handleExpiredTimer(("r",), times, None)
    return out, processor


def verdict(out):
    """The refusal, or the text and the tool calls of a whole reply."""
    refusals = {o.refusal for o in out if o.refusal}
    if refusals:
        return sorted(refusals)
    parts = sorted((o for o in out), key=lambda o: o.part)
    return "".join(o.text for o in parts if o.kind == "text"), [(o.block, o.text) for o in parts if o.kind == "tool"]


def batches_of(rows, order, cuts):
    mixed = [rows[k] for k in order]
    edges = [0, *sorted(c % (len(rows) + 1) for c in cuts), len(rows)]
    return [mixed[a:b] for a, b in zip(edges, edges[1:])]


def reply(width):
    text = f"Dear {TOKEN}, < that is {TOKEN}{TOKEN[:9]} all"
    rows = [chunk(i, text[i * width : (i + 1) * width]) for i in range(-(-len(text) // width))]
    rows[-1].final = True
    n = len(rows)
    rows += [chunk(n, '{"a": ', "tool", "t"), chunk(n + 1, "1}", "tool", "t", True), chunk(n + 2, kind="end")]
    return text, rows


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_any_order_and_any_batches_give_one_reply(data):
    text, rows = reply(data.draw(st.integers(3, 40)))
    order = data.draw(st.permutations(range(len(rows))))
    cuts = data.draw(st.lists(st.integers(0, 60), max_size=6))
    out, processor = run(batches_of(rows, order, cuts))
    assert verdict(out) == (text, [("t", '{"a": 1}')])
    # no token is split between rows, and nothing is left in state
    assert sum(o.text.count(TOKEN) for o in out if o.kind == "text") == text.count(TOKEN)
    assert [o.part for o in out] == list(range(len(out))) and not processor.waiting and not processor.blocks


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_repeated_and_late_numbers_are_always_refused(data):
    _, rows = reply(11)
    extra = data.draw(st.sampled_from(["again", "beyond", "other"]))
    k = data.draw(st.integers(0, len(rows) - 1))
    rows.append({"again": chunk(k, rows[k].delta, rows[k].kind, rows[k].block, rows[k].final), "beyond": chunk(len(rows) + k, "x"), "other": chunk(k, "unlike")}[extra])
    order = data.draw(st.permutations(range(len(rows))))
    out, _ = run(batches_of(rows, order, data.draw(st.lists(st.integers(0, 60), max_size=6))))
    assert verdict(out) == ["sequence_violation"] and sum(o.refusal is not None for o in out) == 1
    # tool calls are given out only if the reply ends without a violation, which a later one can't undo
    refused = next(i for i, o in enumerate(out) if o.refusal)
    assert not any(o.kind != "refused" for o in out[refused:])


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_deadlines_by_event_time_do_not_depend_on_batches(data):
    steps = data.draw(st.lists(st.integers(0, 130), min_size=3, max_size=8))
    at = [0]
    for s in steps:
        at.append(at[-1] + s * 1000)
    rows = [chunk(i, f"w{i} ", at=t) for i, t in enumerate(at[:-1])]
    rows[-1].final = True
    whole = data.draw(st.booleans())
    if whole:
        rows.append(chunk(len(rows), kind="end", at=at[-1]))
    times = [r.at for r in rows]
    late = any(b - a > 120_000 for a, b in zip(times, times[1:])) or times[-1] > 600_000
    order = data.draw(st.permutations(range(len(rows))))
    out, processor = run(batches_of(rows, order, data.draw(st.lists(st.integers(0, 9), max_size=4))), "event", watermark=10**8)
    assert verdict(out) == (["truncated"] if late or not whole else ("".join(f"w{i} " for i in range(len(rows) - 1)), []))
    assert processor.state.get() is None


def test_what_waits_is_bounded():
    rows = [chunk(i, "x" * 50) for i in range(1, 40)]
    assert verdict(run([rows], max_waiting=500)[0]) == ["reorder_limit"]
    assert verdict(run([[r] for r in rows], max_waiting=500)[0]) == ["reorder_limit"]
    # a gap that never closes ends at the deadline
    out, _ = run([[chunk(0, "a"), chunk(2, "c")]], "event", watermark=120_000)
    assert verdict(out) == ["truncated"] and out[0].text == "a"
    out, processor = run([[chunk(0, "a"), chunk(2, "c")]], "event", watermark=119_000)
    assert verdict(out) == ("a", []) and len(processor.waiting) == 1


def test_other_limits():
    assert verdict(run([[chunk(0, "x" * 99), chunk(1, "y" * 99)]], max_bytes=100)[0]) == ["provider_output_too_large"]
    assert verdict(run([[chunk(i, "x", block=f"b{i}") for i in range(5)]], max_blocks=3)[0]) == ["provider_item_limit"]
    assert verdict(run([[chunk(0, "x"), chunk(1, kind="end")]])[0]) == ["block_not_closed"]
    assert verdict(run([[chunk(0, "x", final=True), chunk(1, "y")]])[0]) == ["block_violation"]
    assert verdict(run([[chunk(0, "x"), chunk(1, "{", "tool")]])[0]) == ["block_violation"]
    assert verdict(run([[chunk(None, "x")]])[0]) == ["sequence_violation"]


@pytest.mark.parametrize("text", ["", "a", "<", "a <CARD", "<CARD:v1:" + "0" * 32, "<CARD:v1:" + "0" * 32 + ">", "<a <B", "<CARD:v2", "x" * 500 + "<E", "<" * 90, "<É"])
def test_open_token(text):
    def may_begin(part):
        whole = "<%s:v1:%s>" % ("A" * 3, "0" * 32)
        import re
        return part.startswith("<") and len(part) < fixed.TOKEN_MAX_LENGTH and bool(re.fullmatch(
            r"<(?:[A-Z][A-Z0-9_]*(?::(?:v(?:1(?::[0-9a-f]{0,32})?)?)?)?)?", part)) and whole is not None
    want = next((i for i in range(len(text)) if may_begin(text[i:])), len(text))
    assert open_token_at(text) == want


def test_streams_run_from_any_folder(tmp_path):
    """The driver's Python for states finds the package wherever the job is started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    job = tmp_path / "job.py"
    job.write_text(f"""
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
from maskwright.session import configure
spark = configure(SparkSession.builder.master("local[2]")).config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("rows", entry.queries()["stream_restored"](spark, "/root/testdata/sf0.001").count())
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(job)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "rows" in done.stdout and int(done.stdout.split("rows")[1]) > 0, done.stderr[-2000:]
