"""Reply chunks: stateful alignment, and checks of recorded chunk tables."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskwright.functions import fixed

_LONGEST = fixed.TOKEN_MAX_LENGTH
#: Text of a block that a batch gives out is put together up to that many characters a row.
ROW_CHARS = 4096
# the beginning of a token at the end of a text
_OPEN_TOKEN = re.compile(
    r"<(?:[A-Z][A-Z0-9_]{0,%d}(?::(?:v(?:1(?::[0-9a-f]{0,32})?)?)?)?)?\Z" % (fixed.TOKEN_MAX_TYPE - 1))

ALIGNED = T.StructType([
    T.StructField("request_id", T.StringType()), T.StructField("block", T.StringType()),
    T.StructField("part", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("refusal", T.StringType())])
_OUT = Row(*ALIGNED.names)
_STATE = T.StructType([
    T.StructField("next_seq", T.LongType()), T.StructField("bytes", T.LongType()),
    T.StructField("blocks", T.LongType()), T.StructField("parts", T.LongType()),
    T.StructField("done", T.StringType()), T.StructField("since", T.LongType()), T.StructField("last", T.LongType()),
    T.StructField("seen", T.LongType()), T.StructField("waiting_bytes", T.LongType())])
_BLOCK_KEY = T.StructType([T.StructField("block", T.StringType())])
_BLOCK = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("held", T.StringType()), T.StructField("closed", T.BooleanType())])
_SEQ_KEY = T.StructType([T.StructField("seq", T.LongType())])
# what one batch left waiting, chunk by chunk
_WAITING = T.StructType([
    T.StructField("seqs", T.ArrayType(T.LongType())), T.StructField("blocks", T.ArrayType(T.StringType())),
    T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("deltas", T.ArrayType(T.StringType())),
    T.StructField("finals", T.ArrayType(T.BooleanType())), T.StructField("ats", T.ArrayType(T.LongType()))])
# chunks of one block that a task has read one after the other: their text in one piece, numbers as bytes
RUNS = T.StructType([
    T.StructField("request_id", T.StringType()), T.StructField("block", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("seqs", T.BinaryType()), T.StructField("sizes", T.BinaryType()),
    T.StructField("finals", T.BinaryType())])
_NO_SEQ = -(1 << 63)


def open_token_at(text: str) -> int:
    """Where a token that is not complete yet may begin; the length if none."""
    tail = text[-(_LONGEST - 1):]
    found = _OPEN_TOKEN.search(tail)
    return len(text) - len(tail) + found.start() if found else len(text)


def _size(delta: str | None) -> int:
    return len((delta or "").encode("utf-8"))


class Align(StatefulProcessor):
    """Puts the chunks of a reply in order and re-cuts its text so that no token is split between rows.

    Chunks of a reply are numbered from ``first_seq`` on without gaps and may arrive in any order and in
    any batches: one that comes early waits in state until all before it are there.
    A number that comes twice, or one beyond the end, refuses the reply, however
    the arrivals are cut into batches. State of a reply: the number expected next,
    counters, the waiting chunks, and per block the held text: for prose at most
    the beginning of one token, for tool calls all of it until the reply ends. A
    violation ends the reply with one refusal row. Text that was given out before a refusal
    stays given out, so a reply with a refusal row is refused as a whole.

    ``clock`` is None, "processing" or "event". With a clock a reply that falls silent or takes too long ends as
    truncated. By event time the arrivals of the chunks decide, in the order of their numbers, so that the
    verdict doesn't depend on the batches; the watermark ends what nothing follows.
    """

    def __init__(self, max_bytes: int, max_blocks: int, idle_s: int, total_s: int, clock: str | None, max_waiting: int, first_seq: int = 0):
        self.first_seq = first_seq
        self.max_bytes, self.max_blocks, self.max_waiting, self.clock = max_bytes, max_blocks, max_waiting, clock
        self.idle_ms, self.total_ms = idle_s * 1000, total_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("reply", _STATE)
        self.blocks = handle.getMapState("blocks", _BLOCK_KEY, _BLOCK)
        self.waiting = handle.getMapState("waiting", _SEQ_KEY, _WAITING)

    def chunks_of(self, row: Row, now: int | None) -> Iterator[tuple[int | None, tuple]]:
        """The numbered chunks of an input row."""
        yield row.seq, (row.block, row.kind, row.delta, bool(row.final), row.at if now is None else now)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # state is read and written once per key and batch: every call is a round trip
        request, event = key[0], self.clock == "event"
        now = None if event else timerValues.getCurrentProcessingTimeInMs()
        arrived = [c for r in rows for c in self.chunks_of(r, now)]
        first = min(c[4] for _, c in arrived)
        expected, size, n_blocks, parts, done, since, last, seen, held = self.state.get() or (self.first_seq, 0, 0, 0, None, first, first, first, 0)
        seen = max([seen, *[c[4] for _, c in arrived]])
        if done == "refused":
            return
        blocks: dict[str, list] = {}
        out: list[tuple] = []
        problem = None
        early: dict[int, tuple] = {}
        # all that waits is read at once; it is bounded
        stored: dict[int, tuple] = {}
        if held:
            for _, kept in self.waiting.iterator():
                stored.update(zip(kept[0], zip(*kept[1:])))
        n_stored, known_blocks = len(stored), n_blocks
        for seq, chunk in arrived:
            repeated = seq is None or seq < expected or seq in early or seq in stored
            if done == "ended" or repeated:
                problem = "sequence_violation"
            early[seq] = chunk
        if expected == self.first_seq and expected in early:
            since = last = early[expected][4]
        while problem is None and done is None:
            if expected in early:
                block, kind, delta, final, at = early.pop(expected)
            elif expected in stored:
                block, kind, delta, final, at = stored.pop(expected)
                held -= _size(delta) + 1
            else:
                break
            expected += 1
            size += _size(delta)
            if self.clock and (at - last > self.idle_ms or at - since > self.total_ms):
                problem = "truncated"
            elif size > self.max_bytes:
                problem = "provider_output_too_large"
            elif kind == "end":
                done = "ended"
                for name, value in self.blocks.iterator() if known_blocks else ():
                    blocks.setdefault(name[0], list(value))
                if early or held:
                    problem = "sequence_violation"
                elif any(not closed for _, _, closed in blocks.values()):
                    problem = "block_not_closed"
                else:
                    for name, (of, text, _) in sorted(blocks.items()):
                        if of == "tool":
                            out.append((request, name, parts, "tool", text, None))
                            parts += 1
            else:
                if block not in blocks and known_blocks and self.blocks.containsKey((block,)):
                    blocks[block] = list(self.blocks.getValue((block,)))
                if block not in blocks:
                    blocks[block] = [kind, "", False]
                    n_blocks += 1
                entry = blocks[block]
                if entry[2] or entry[0] != kind:
                    problem = "block_violation"
                elif n_blocks > self.max_blocks:
                    problem = "provider_item_limit"
                else:
                    text = entry[1] + (delta or "")
                    cut = len(text) if final else open_token_at(text)
                    if kind == "text" and cut:
                        if out and out[-1][1] == block and len(out[-1][4]) + cut <= ROW_CHARS:
                            out[-1] = (*out[-1][:4], out[-1][4] + text[:cut], None)
                        else:
                            out.append((request, block, parts, "text", text[:cut], None))
                            parts += 1
                        text = text[cut:]
                    entry[1], entry[2] = text, final
            last = max(last, at)
        if problem is None:
            held += sum(_size(c[2]) + 1 for c in early.values())
            if held > self.max_waiting:
                problem = "reorder_limit"
        if problem is not None:
            done = "refused"
            out = [o for o in out if o[3] != "tool"] + [(request, None, parts, "refused", None, problem)]
        if done:
            # nothing is cleared that was never written: a reply that ends in its first batch takes two round trips
            if known_blocks:
                self.blocks.clear()
            if n_stored:
                self.waiting.clear()
            held = 0
        else:
            if len(stored) < n_stored:
                self.waiting.clear()
                early |= stored
            if early:
                self.waiting.updateValue((min(early),), (list(early), *(list(x) for x in zip(*early.values()))))
            for name, entry in blocks.items():
                self.blocks.updateValue((name,), tuple(entry))
        self.state.update((expected, size, n_blocks, parts, done, since, last, seen, held))
        if self.clock:
            self.handle.registerTimer(seen + self.idle_ms if done else min(seen + self.idle_ms, since + self.total_ms))
        for o in out:
            yield _OUT(*o)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.state.get()
        now = timerValues.getCurrentWatermarkInMs() if self.clock == "event" else timerValues.getCurrentProcessingTimeInMs()
        if state is not None:
            _, _, _, parts, done, since, _, seen, _ = state
            silent = now >= seen + self.idle_ms
            if silent or (done is None and now >= since + self.total_ms):
                self.blocks.clear()
                self.waiting.clear()
                self.state.clear()
                if done is None:
                    yield _OUT(key[0], None, parts, "refused", None, "truncated")

    def close(self) -> None:
        pass


class AlignRuns(Align):
    """The same over runs of chunks, which take far fewer rows of state input than chunks do."""

    def chunks_of(self, row: Row, now: int | None) -> Iterator[tuple[int | None, tuple]]:
        at = 0
        sizes, finals = np.frombuffer(row.sizes, np.int32).tolist(), bytes(row.finals)
        for seq, size, final in zip(np.frombuffer(row.seqs, np.int64).tolist(), sizes, finals):
            yield None if seq == _NO_SEQ else seq, (row.block, row.kind, row.text[at : at + size], bool(final), now)
            at += size


def _cut(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of ``values`` between ``edges``."""
    width = values.itemsize
    offsets = (edges * width).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def chunk_runs(chunks: DataFrame) -> DataFrame:
    """Chunks of a reply's block that lie in one Arrow batch, in their order, as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # stable, so chunks of a reply stay in the order of their arrival
            batch = batch.take(pc.sort_indices(batch.column(0)))
            request, block, kind, seq, delta, final = batch.columns
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for column in (request, block, kind):
                codes = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(new)
            edges = np.r_[starts, batch.num_rows]
            delta = pc.fill_null(delta, "")
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), delta), "")
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays([
                request.take(at), block.take(at), kind.take(at), text,
                _cut(pc.fill_null(seq, _NO_SEQ).to_numpy(zero_copy_only=False), edges),
                _cut(pc.utf8_length(delta).to_numpy(zero_copy_only=False).astype(np.int32), edges),
                _cut(pc.fill_null(final, False).to_numpy(zero_copy_only=False).astype(np.uint8), edges)], names=RUNS.names)

    return chunks.select("request_id", "block", "kind", F.col("seq").cast("bigint"), "delta", "final").mapInArrow(run, RUNS)


def align_stream(
    chunks: DataFrame, max_bytes: int = fixed.MAX_RESTORED_BYTES, max_blocks: int = fixed.MAX_JSON_ENTRIES,
    idle_s: int = fixed.IDLE_SECONDS, total_s: int = fixed.TOTAL_SECONDS, deadlines: str | None = "processing",
    max_waiting: int = fixed.MAX_JSON_BYTES, delay: str = "0 seconds", first_seq: int = 0,
) -> DataFrame:
    """Streaming chunks as rows whose text can be restored one by one.

    Without ``deadlines`` silent replies are not ended. A query over what is there now takes None, or
    "event": then ``chunks`` has ``arrived``, the watermark runs ``delay`` behind it, and a reply
    ends when nothing of it arrives for ``idle_s`` or it takes longer than ``total_s``. Timers of
    "processing" time keep a query running for ever. A reply whose early chunks take more than
    ``max_waiting`` bytes is refused.
    """
    # the driver's Python for states doesn't see packages that were sent to the workers, so the class goes by value
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    modes = {None: "None", "processing": "ProcessingTime", "event": "EventTime"}
    if deadlines == "event":
        chunks = chunks.withWatermark("arrived", delay).withColumn("at", F.unix_millis("arrived"))
    else:
        chunks = chunk_runs(chunks)
    # by event time the watermark judges single chunks
    align = Align if deadlines == "event" else AlignRuns
    return chunks.groupBy("request_id").transformWithState(
        align(max_bytes, max_blocks, idle_s, total_s, deadlines, max_waiting, first_seq), ALIGNED, "append", modes[deadlines])


def sequence_check(chunks: DataFrame, slice_rows: int = 100_000) -> DataFrame:
    """``(request_id, problem)`` of recorded replies whose numbers do not increase
    with ``arrival``, or that go on after their end.

    Judged inside slices of the arrival order and then between slices, so that a
    very long reply is not one task.
    """
    sliced = chunks.withColumn("__slice", F.floor(F.col("arrival") / slice_rows))
    inside = Window.partitionBy("request_id", "__slice").orderBy("arrival")
    local = sliced.withColumn("__bad", F.coalesce(F.col("seq") <= F.lag("seq").over(inside), F.lit(False)))
    per_slice = local.groupBy("request_id", "__slice").agg(
        F.max("__bad").alias("bad"), F.min("seq").alias("low"), F.max("seq").alias("high"),
        F.min(F.when(F.col("kind") == "end", F.col("arrival"))).alias("end_at"), F.max("arrival").alias("last_at"))
    earlier = Window.partitionBy("request_id").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    between = per_slice.withColumn("bad", F.col("bad") | F.coalesce(F.max("high").over(earlier) >= F.col("low"), F.lit(False)))
    judged = between.groupBy("request_id").agg(
        F.max("bad").alias("bad"), F.min("end_at").alias("end_at"), F.max("last_at").alias("last_at"))
    problem = F.when(F.col("bad"), "sequence_violation").when(F.col("last_at") > F.col("end_at"), "after_end")
    return judged.select("request_id", problem.alias("problem")).where("problem is not null")


def truncated_streams(chunks: DataFrame) -> DataFrame:
    """Replies without a terminal event."""
    return chunks.groupBy("request_id").agg(F.max(F.col("kind") == "end").alias("ended")).where("not ended").select("request_id")


def stream_limits(
    chunks: DataFrame, max_bytes: int = fixed.MAX_RESTORED_BYTES, max_blocks: int = fixed.MAX_JSON_ENTRIES,
    max_event_bytes: int = fixed.MAX_JSON_BYTES,
) -> DataFrame:
    """``(request_id, problem)`` of recorded replies beyond a cap."""
    size = F.octet_length("delta")
    per_block = chunks.groupBy("request_id", "block").agg(F.sum(size).alias("b"), F.max(size).alias("e"))
    sums = per_block.groupBy("request_id").agg(
        F.sum("b").alias("b"), F.max("e").alias("e"), F.count("block").alias("n"))
    problem = (
        F.when(F.col("e") > max_event_bytes, "event_too_large").when(F.col("n") > max_blocks, "provider_item_limit")
        .when(F.col("b") > max_bytes, "provider_output_too_large"))
    return sums.select("request_id", problem.alias("problem")).where("problem is not null")


def join_chunks(chunks: DataFrame) -> DataFrame:
    """The whole text of every block; the chunks grouped are one block's text."""
    return chunks.where("kind <> 'end'").groupBy("request_id", "block", "kind").agg(
        F.array_sort(F.collect_list(F.struct("seq", F.coalesce("delta", F.lit("")).alias("delta")))).alias("__c"),
        F.max("final").alias("closed"),
    ).withColumn("text", F.array_join(F.transform("__c", lambda c: c["delta"]), "")).drop("__c")


def withhold_tool_calls(chunks: DataFrame, refused: DataFrame) -> DataFrame:
    """Tool blocks of a recorded reply, released together: only of replies that
    ended, with every block closed and nothing refused."""
    blocks = join_chunks(chunks)
    ended = chunks.groupBy("request_id").agg(F.max(F.col("kind") == "end").alias("ended"))
    whole = blocks.groupBy("request_id").agg(F.min("closed").alias("all_closed"))
    ok = ended.join(whole, "request_id").where("ended and all_closed").join(refused, "request_id", "left_anti")
    return blocks.where("kind = 'tool'").join(ok.select("request_id"), "request_id", "left_semi").drop("closed", "kind")


def reconcile_snapshots(chunks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``(request_id, block, problem)``: joined deltas against final texts.

    Compared by length and 256-bit digest after one aggregation per side.
    """
    joined = join_chunks(chunks).select(
        "request_id", "block", "closed", F.sha2(F.col("text"), 256).alias("got"))
    wanted = snapshots.select("request_id", "block", F.sha2(F.col("text"), 256).alias("want"))
    both = joined.join(wanted, ["request_id", "block"], "full")
    problem = (
        F.when(F.col("got").isNull(), "no_chunks").when(~F.col("closed"), "not_closed")
        .when(F.col("want").isNull(), "no_snapshot").when(F.col("got") != F.col("want"), "mismatch"))
    return both.select("request_id", "block", problem.alias("problem")).where("problem is not null")


def call_batch_rules(calls: DataFrame, requests: DataFrame, declared: DataFrame) -> DataFrame:
    """``(request_id, problem)``: too many calls, none where one is required, undeclared
    tools, tools of another kind, and calls other than the selected one.

    ``calls``: ``(request_id, name, custom)``; ``requests``: ``(request_id, max_calls,
    parallel, required, forbidden, selected_name, selected_custom)``; ``declared``:
    ``(request_id, name, custom)``.
    """
    known = declared.select("request_id", "name", F.col("custom").alias("declared_custom")).distinct()
    selection = requests.select("request_id", "forbidden", "selected_name", "selected_custom")
    judged = calls.join(known, ["request_id", "name"], "left").join(selection, "request_id")
    call_problem = (
        F.when(F.coalesce("forbidden", F.lit(False)) | F.col("declared_custom").isNull(), "undeclared_tool_call")
        .when(F.col("declared_custom") != F.col("custom"), "tool_choice_violation")
        .when(F.col("selected_name").isNotNull()
              & ((F.col("selected_name") != F.col("name")) | (F.col("selected_custom") != F.col("custom"))),
              "tool_choice_violation"))
    per_call = judged.select("request_id", call_problem.alias("problem")).where("problem is not null")
    counts = calls.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    limit = F.least(F.col("max_calls"), F.when(~F.col("parallel"), 1))
    n = F.coalesce("n", F.lit(0))
    per_reply = requests.join(counts, "request_id", "left").where(
        (n > limit) | (F.col("required") & (n == 0))).select("request_id", F.lit("tool_choice_violation").alias("problem"))
    return per_call.unionByName(per_reply).distinct()
