"""Chunk streams in event time: what comes in disorder waits for the watermark, idle streams close by it.

Rows are (stream_id, seq, ts timestamp, samples array<double>, eos boolean). A chunk waits in state until the watermark
has passed its time; then chunks go to the stream's processor in order of (ts, seq), so that the outcome does not
depend on how deliveries cut or mix the stream. A chunk whose time the watermark has already passed when it comes is
late, one that waits already is repeated; both come out as rows that say so, so that counting them is an aggregate. A
stream ends at its end mark, or where its next chunk is more than ``idle`` later, or when the watermark is; its state
is dropped then. ``ts`` must be null nowhere; a row without stream_id is a heartbeat, which only moves the watermark.

A call to the store takes longer than a short chunk's work, so chunks and flows are kept packed, and many short streams
can share a key of state (``buckets``): the calls then grow with the buckets, not with streams times deliveries.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LATE, REPEATED, CLOSED = "late", "repeated", "closed"
#: Numbers (of 8 bytes) that a row of state holds; a longer chunk is a row of its own.
PACK = 8192
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession, empty_batches: bool = True, partitions: int | None = None):
    """Start event-time streams inside of this: timers and typed state need the RocksDB store.

    Without ``empty_batches`` a stream does not run a batch of its own when the watermark has moved, so timers wait for
    the next chunks or heartbeat. ``partitions`` says how many parts a new stream's state has (each starts a Python
    worker and a store in every batch); a stream that goes on keeps those of its checkpoint.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(empty_batches).lower()}
    if partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _columns(chunks: DataFrame, columns: str) -> tuple[str, list[str]]:
    kind = chunks.schema["stream_id"].dataType.simpleString()
    schema = f"stream_id {kind}, started timestamp, seq bigint, fate string, {columns}"
    return schema, [c.split()[0] for c in schema.split(", ")]


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Result rows (stream_id, started, seq, fate, ...): the processor's columns are null where there is a fate."""
    rest = (None,) * (len(names) - 4)
    out = pd.DataFrame([r if len(r) > 4 else r + rest for r in rows], columns=names)
    out["started"] = pd.to_datetime(out["started"], unit="us", utc=True)
    return out


def _packed(rows: list[tuple], size: Callable[[tuple], int]) -> list[tuple]:
    """Rows of state, each with as many of ``rows`` as have ``PACK`` numbers."""
    out, part, held = [], [], 0
    for r in rows:
        part.append(r)
        held += size(r)
        if held >= PACK:
            out.append((pickle.dumps(part),))
            part, held = [], 0
    return [*out, (pickle.dumps(part),)] if part else out


def _unpacked(state: Iterator[tuple]) -> list[tuple]:
    return [r for (part,) in state for r in pickle.loads(part)]


def _chunk_size(c: tuple) -> int:
    return 4 + len(c[3] or b"") // 8


def _flow_size(f: tuple) -> int:
    return 4 + len(f[-1]) // 8


class _Flow:
    """What a stream has said so far: when it began and last spoke, and its processor."""

    def __init__(self, make: Callable, idle_us: int, kept: tuple | None = None):
        self.make, self.idle_us = make, idle_us
        self.started, self.last, self.seq, memory = kept or (None, None, None, None)
        self.processor = make()
        if memory:
            vars(self.processor).update(pickle.loads(memory))

    def kept(self) -> tuple:
        memory = {k: v for k, v in vars(self.processor).items() if not callable(v)}
        return self.started, self.last, self.seq, pickle.dumps(memory)

    def close(self) -> list[tuple]:
        if self.started is None:
            return []
        out = [(self.started, self.seq, None, *r) for r in self.processor.finish()] + [(self.started, self.seq, CLOSED)]
        self.started, self.last, self.seq, self.processor = None, None, None, self.make()
        return out

    def hear(self, ts: int, seq: int, samples, eos: bool) -> list[tuple]:
        out = self.close() if self.last is not None and ts - self.last > self.idle_us else []
        if self.started is None:
            self.started = ts
        self.last, self.seq = ts, seq
        if samples is not None and len(samples):
            out += [(self.started, seq, None, *r) for r in self.processor.push(np.asarray(samples, np.float64))]
        return out + self.close() if eos else out

    def rest(self, now: int) -> list[tuple]:
        return self.close() if self.last is not None and now - self.last > self.idle_us else []


class _Ordered(StatefulProcessor):
    """State of the streams that share a key: the chunks that wait (stream_id, us, seq, samples as bytes, eos), and the
    flows of those that have begun (stream_id, started, last, seq, memory). Times in microseconds, timers in milliseconds.

    Both are lists of packed rows, so that a delivery costs a key a few calls to the store, however many chunks it has.
    """

    def __init__(self, make: Callable, names: list[str], idle_us: int):
        self.make, self.names, self.idle_us = make, names, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.woken = handle, set()
        self.waiting = handle.getListState("waiting", "chunks binary")
        self.flow = handle.getListState("flow", "flows binary")

    def _wake(self, us: int) -> None:
        """Come back when the watermark has passed this time."""
        self.handle.registerTimer(us // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        known = {c[:3] for c in _unpacked(self.waiting.get())}
        before = min((us for _, us, _ in known), default=None)
        refused, more = [], []
        for pdf in rows:
            for at in pdf[["stream_id", "us", "seq", "samples", "eos"]].itertuples(index=False, name=None):
                place, samples = at[:3], at[3]
                if at[1] < mark:
                    refused.append((at[0], None, at[2], LATE))
                elif place in known:
                    refused.append((at[0], None, at[2], REPEATED))
                else:
                    known.add(place)
                    more.append((*place, None if samples is None else np.asarray(samples, np.float64).tobytes(), bool(at[4])))
        if more:
            self.waiting.appendList(_packed(more, _chunk_size))
            least = min(c[1] for c in more)
            if before is None or least < before:
                self._wake(least)
        if refused:
            yield _frame(refused, self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key in self.woken:
            return  # another timer of the same key has done all in this batch
        self.woken.add(key)
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = _unpacked(self.waiting.get())
        kept = {f[0]: f for f in _unpacked(self.flow.get())}
        ready = sorted((c for c in held if c[1] < mark), key=lambda c: c[1:3])
        flows, out = {}, []

        def flow_of(stream) -> _Flow:
            if stream not in flows:
                flows[stream] = _Flow(self.make, self.idle_us, kept[stream][1:] if stream in kept else None)
            return flows[stream]

        for stream, us, seq, samples, eos in ready:
            out += [(stream, *r) for r in flow_of(stream).hear(us, seq, None if samples is None else np.frombuffer(samples).copy(), eos)]
        for stream in {**kept, **flows}:
            if stream in flows or mark - kept[stream][2] > self.idle_us:
                out += [(stream, *r) for r in flow_of(stream).rest(mark)]
        left = [c for c in held if c[1] >= mark] if ready else held
        if ready:
            self.waiting.put(_packed(left, _chunk_size)) if left else self.waiting.clear()
        if flows:
            kept |= {stream: (stream, *f.kept()) for stream, f in flows.items()}
            kept = {stream: f for stream, f in kept.items() if f[2] is not None}
            self.flow.put(_packed(list(kept.values()), _flow_size)) if kept else self.flow.clear()
        if left or kept:
            self._wake(min([c[1] for c in left] + [f[2] + self.idle_us for f in kept.values()]))
        if out:
            yield _frame(out, self.names)

    def close(self) -> None:
        pass


def timed(chunks: DataFrame, make: Callable[[], object], columns: str, delay: str, idle_seconds: float, buckets: int | None = None) -> DataFrame:
    """A stream of chunks through one processor for each stream, (stream_id, started, seq, fate, columns...).

    ``started`` is the time of the first chunk since the stream last ended, ``seq`` the number of the chunk that a row
    follows from, or that was refused; ``fate`` is null for a result, otherwise "late", "repeated" or "closed" (one row
    at each end of a stream). ``delay`` is how far the watermark stays behind the latest chunk. With ``buckets`` streams
    share that many keys of state, by the hash of their ids; a task then holds what waits in all streams of one bucket,
    so their number should follow that of the chunks, and it must stay the same for a checkpoint.
    """
    schema, names = _columns(chunks, columns)
    # Heartbeats go after the watermark has seen them: a filter without the time in it would move before it.
    spoken = F.unix_micros("ts") > F.when(F.col("stream_id").isNull(), F.lit(2**63 - 1)).otherwise(F.lit(-(2**63)))
    # The time goes on as a number: the engine then leaves late rows to us, who count them.
    known = chunks.withWatermark("ts", delay).filter(spoken).select("stream_id", "seq", F.unix_micros("ts").alias("us"), "samples", "eos")
    key = F.col("stream_id") if buckets is None else F.pmod(F.xxhash64("stream_id"), F.lit(buckets))
    return known.withColumn("__key", key).groupBy("__key").transformWithStateInPandas(_Ordered(make, names, int(idle_seconds * 1e6)), schema, "Append", "EventTime")


def settled(chunks: DataFrame, make: Callable[[], object], columns: str, idle_seconds: float) -> DataFrame:
    """Stored chunks through the same processors, with the results and ends that a stream gives that nothing comes late to.

    A stream is cut where it is idle or ends, so a task holds what lies between two ends, not a whole stream.
    """
    schema, names = _columns(chunks, columns)
    idle = int(idle_seconds * 1e6)
    w = Window.partitionBy("stream_id").orderBy("us", "seq")
    rows = chunks.filter("stream_id IS NOT NULL").select("stream_id", "seq", F.unix_micros("ts").alias("us"), "samples", "eos")
    first = rows.groupBy("stream_id", "us", "seq").agg(F.any_value("samples").alias("samples"), F.max("eos").alias("eos"))
    new = F.coalesce((F.col("us") - F.lag("us").over(w) > idle) | F.lag("eos").over(w), F.lit(True))
    parts = first.withColumn("new", new.cast("int")).withColumn("part", F.sum("new").over(w))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        flow, out = _Flow(make, idle), []
        for at in pdf.sort_values(["us", "seq"])[["us", "seq", "samples", "eos"]].itertuples(index=False):
            out += flow.hear(*at)
        return _frame([(key[0], *r) for r in out + flow.close()], names)

    return parts.groupBy("stream_id", "part").applyInPandas(work, schema)
