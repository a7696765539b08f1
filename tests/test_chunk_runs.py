"""Runs of chunks and the round trips to state: what Align is given and what it asks for."""

import numpy as np

from maskwright.streaming import chunks as ch
from tests.test_chunk_order import TOKEN, Handle, Map, Value, chunk, reply, run, verdict


class Counted(Handle):
    """States that count how often they are asked."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def _of(self, made):
        for name in ("get", "update", "clear", "containsKey", "getValue", "updateValue", "removeKey", "iterator"):
            if hasattr(made, name):
                def counted(*args, ask=getattr(made, name)):
                    self.calls += 1
                    return ask(*args)
                setattr(made, name, counted)
        return made

    def getValueState(self, *_):
        return self._of(Value())

    def getMapState(self, *_):
        return self._of(Map())


def test_state_is_asked_per_batch_and_not_per_chunk():
    class Times:
        getCurrentProcessingTimeInMs = staticmethod(lambda: 0)

    def calls(batches):
        processor, handle = ch.Align(1 << 20, 100, 120, 600, None, 1 << 20), Counted()
        processor.init(handle)
        for rows in batches:
            list(processor.handleInputRows(("r",), iter(rows), Times))
        return handle.calls

    _, rows = reply(3)
    assert len(rows) > 30
    assert calls([rows]) == 2
    assert calls([rows[1::2], rows[::2]]) <= 12


def test_text_of_a_batch_is_put_together():
    text, rows = reply(5)
    out, _ = run([rows])
    assert [o.kind for o in out] == ["text", "tool"] and out[0].text == text and TOKEN in text
    long = [chunk(i, "word " * 100) for i in range(100)]
    long[-1].final = True
    out, _ = run([[*long, chunk(100, kind="end")]])
    assert max(len(o.text) for o in out) <= ch.ROW_CHARS and verdict(out)[0] == "word " * 10_000 and len(out) < 20


def test_runs_hold_all_chunks(spark):
    rows = [("b", "x", 0, "né", False, "text"), ("a", "x", 0, "<", False, "text"), ("b", "x", 1, None, True, "text"), ("b", None, 2, "", True, "end"),
            ("a", "y", None, "{}", None, "tool"), ("a", "x", 5, "\U0001f600 z", True, "text")]
    made = spark.createDataFrame(rows, "request_id string, block string, seq bigint, delta string, final boolean, kind string").coalesce(1)
    processor = ch.AlignRuns(1, 1, 1, 1, None, 1)
    got = ch.chunk_runs(made).collect()
    found = [(r.request_id, seq, *c) for r in got for seq, c in processor.chunks_of(r, 7)]
    want = sorted(((q, seq, block, kind, delta or "", bool(final), 7) for q, block, seq, delta, final, kind in rows), key=lambda r: r[0])
    assert found == want
    assert len(got) == 5 and np.frombuffer(got[3].seqs, np.int64).tolist() == [0, 1]
