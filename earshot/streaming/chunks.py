"""Live audio in chunks: state by stream, the same processors for streams and for stored chunks.

Rows are (stream_id, seq, samples array<double>, eos boolean). Chunks of one micro-batch are put in order of seq;
a chunk whose seq is not above the last one seen is a duplicate or late and only counted (``late`` names a column that
shows the count). A processor keeps what it needs of the past, a few hops, never the whole stream; only ``Session``,
whose embedding needs all samples, keeps those of one session (``Folded`` keeps a summary instead).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Hops:
    """Frames of the previous and the new hop; the first hop of a stream only waits, what is left over of a chunk is dropped."""

    columns = "frame bigint, samples array<double>"

    def __init__(self, hop: int = 16):
        self.hop, self.frame, self.last = hop, 0, None

    def push(self, samples: np.ndarray) -> list[tuple]:
        out = []
        for k in range(len(samples) // self.hop):
            new = samples[k * self.hop : (k + 1) * self.hop]
            if self.last is not None:
                out.append((self.frame, np.r_[self.last, new]))
                self.frame += 1
            self.last = new
        return out

    def finish(self) -> list[tuple]:
        return []


class OverlapAdd:
    """Samples from frames that overlap: where two meet, their mean. What the next frame may still change waits."""

    columns = "start bigint, samples array<double>"

    def __init__(self, window: int = 32, hop: int = 16):
        self.window, self.hop, self.start, self.tail = window, hop, 0, None

    def push(self, frame: np.ndarray) -> list[tuple]:
        frame = np.array(frame)
        if self.tail is not None:
            shared = self.window - self.hop
            frame[:shared] = (frame[:shared] + self.tail) / 2
        self.tail = frame[self.hop :]
        out = (self.start, frame[: self.hop])
        self.start += self.hop
        return [out]

    def finish(self) -> list[tuple]:
        return [(self.start, self.tail)] if self.tail is not None else []


class Steps:
    """A user's step on every frame, with a state for frames and one for segments of ``segment`` frames.

    ``step(frame, fast, slow)`` returns (output, fast). After each segment ``turn(fast, slow)`` returns the new slow
    state, and the fast one starts anew.
    """

    columns = "frame bigint, samples array<double>"

    def __init__(self, step: Callable, turn: Callable, segment: int = 150):
        self.step, self.turn, self.segment = step, turn, segment
        self.frame, self.fast, self.slow = 0, None, None

    def push(self, frame: np.ndarray) -> list[tuple]:
        out, self.fast = self.step(frame, self.fast, self.slow)
        self.frame += 1
        if self.frame % self.segment == 0:
            self.slow, self.fast = self.turn(self.fast, self.slow), None
        return [(self.frame - 1, out)]

    def finish(self) -> list[tuple]:
        return []


class Smoothing:
    """Causal moving average of probabilities and its decision, place by place."""

    columns = "pos bigint, mean double, value int"

    def __init__(self, kernel: int, threshold: float):
        self.kernel, self.threshold, self.pos, self.past = kernel, threshold, 0, np.zeros(kernel - 1)

    def push(self, samples: np.ndarray) -> list[tuple]:
        whole = np.concatenate((self.past, samples))
        means = [float(np.add.reduce(whole[k : k + self.kernel])) / self.kernel for k in range(len(samples))]
        self.past = whole[len(whole) - self.kernel + 1 :] if self.kernel > 1 else whole[:0]
        out = [(self.pos + k, m, int(m > self.threshold)) for k, m in enumerate(means)]
        self.pos += len(samples)
        return out

    def finish(self) -> list[tuple]:
        return []


class Session:
    """One embedding for all chunks up to the end mark; a new session starts empty."""

    columns = "n bigint, dvec array<double>"

    def __init__(self, embed: Callable[[np.ndarray], np.ndarray]):
        self.embed, self.parts = embed, []

    def push(self, samples: np.ndarray) -> list[tuple]:
        self.parts.append(samples)
        return []

    def finish(self) -> list[tuple]:
        whole = np.concatenate(self.parts) if self.parts else np.empty(0)
        self.parts = []
        return [(len(whole), self.embed(whole))] if len(whole) else []


class Folded:
    """One embedding for all chunks up to the end mark from a running summary of fixed size: ``add(summary, samples)`` starts at ``zero()``.

    What a micro-batch writes back is the summary, not the session so far.
    """

    columns = "n bigint, dvec array<double>"

    def __init__(self, zero: Callable, add: Callable, finish: Callable[..., np.ndarray]):
        self.zero, self.add, self.embed, self.n, self.summary = zero, add, finish, 0, None

    def push(self, samples: np.ndarray) -> list[tuple]:
        self.summary = self.add(self.zero() if self.summary is None else self.summary, samples)
        self.n += len(samples)
        return []

    def finish(self) -> list[tuple]:
        out = [(self.n, np.asarray(self.embed(self.summary), np.float64))] if self.n else []
        self.n, self.summary = 0, None
        return out


def _advance(make, kept: tuple | None, pdf: pd.DataFrame, counted: bool = False) -> tuple[list[tuple], tuple | None]:
    """Rows that new chunks give, and (last seq, dropped, processor), or None after the end.

    If ``counted``, a row ends with the number of chunks that its session had dropped when the row was made.
    """
    tally = lambda found: [(*r, dropped) for r in found] if counted else found
    last, dropped, processor = kept or (None, 0, make())
    rows: list[tuple] = []
    for seq, samples, eos in pdf.sort_values("seq", kind="stable")[["seq", "samples", "eos"]].itertuples(index=False):
        if last is not None and seq <= last:
            dropped += 1
            kept = (last, dropped, processor)
            continue
        last = int(seq)
        if samples is not None and len(samples):
            rows += tally(processor.push(np.asarray(samples, np.float64)))
        if eos:
            rows += tally(processor.finish())
            last, dropped, processor = None, 0, make()
            kept = None
            continue
        kept = (last, dropped, processor)
    return rows, kept


def _packed(kept: tuple) -> bytes:
    """The state of a stream as bytes: what a processor remembers, without its functions."""
    last, dropped, processor = kept
    return pickle.dumps((last, dropped, {k: v for k, v in vars(processor).items() if not callable(v)}))


def _revived(make, data: bytes) -> tuple:
    last, dropped, memory = pickle.loads(data)
    processor = make()
    vars(processor).update(memory)
    return last, dropped, processor


def _frame(key, rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([(key, *r) for r in rows], columns=["stream_id", *names])


def _schema(chunks: DataFrame, columns: str, late: str | None) -> tuple[str, list[str]]:
    columns = f"{columns}, {late} bigint" if late else columns
    return f"stream_id {chunks.schema['stream_id'].dataType.simpleString()}, {columns}", [c.split()[0] for c in columns.split(", ")]


def streamed(chunks: DataFrame, make: Callable[[], object], columns: str, idle_ms: int | None = None, late: str | None = None) -> DataFrame:
    """A stream of chunks through one processor for each stream_id. With ``idle_ms`` a stream that stays silent so long is finished and forgotten.

    ``late`` names a column for the number of chunks that the session has dropped so far as late or duplicate.
    """
    schema, names = _schema(chunks, columns, late)

    def work(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState):
        kept = _revived(make, state.get[0]) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            found = kept[2].finish() if kept else []
            yield _frame(key[0], [(*r, kept[1]) for r in found] if late else found, names)
            return
        # A micro-batch of a stream may come in several frames, in any order.
        rows, kept = _advance(make, kept, pd.concat(list(pdfs)), bool(late))
        if kept is None:
            if state.exists:
                state.remove()
        else:
            state.update((_packed(kept),))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        if rows:
            yield _frame(key[0], rows, names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return chunks.groupBy("stream_id").applyInPandasWithState(work, schema, "kept binary", "append", timeout)


def batched(chunks: DataFrame, make: Callable[[], object], columns: str, late: str | None = None) -> DataFrame:
    """Stored chunks through the same processors.

    Chunks reach their task by stream and in order, and pass through it: it holds a batch of them and what the
    processor remembers, however long a stream is.
    """
    schema, names = _schema(chunks, columns, late)

    def work(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, None
        for pdf in pdfs:
            ids, none = pdf["stream_id"].to_numpy(), pdf["stream_id"].isna().to_numpy()
            ends = [*(np.flatnonzero((ids[1:] != ids[:-1]) & ~(none[1:] & none[:-1])) + 1).tolist(), len(pdf)]
            for a, b in zip([0, *ends], ends):
                if a == b:
                    continue
                key = (None if none[a] else ids[a],)
                if key != now:
                    now, kept = key, None
                rows, kept = _advance(make, kept, pdf.iloc[a:b], bool(late))
                if rows:
                    yield _frame(key[0], rows, names)

    dealt = chunks.select("stream_id", "seq", "samples", "eos").repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return dealt.mapInPandas(work, schema)
