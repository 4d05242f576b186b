"""WAV files as a data source: headers by ranged reads, long files in blocks, writes that are seen when they are whole.

``register(spark)`` makes the format "wav" known. Reading takes ``what="headers"`` (a few bytes of each file) or "blocks"
(the first channel, ``block`` samples a row); files are dealt to tasks by bytes, and a long file is read by several
tasks, each from its own place. Writing puts files into a hidden folder of the job; its commit moves them to their
names and its abort leaves nothing. Files are reached by the path's own file system (pyarrow), not by the driver's.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.datasource import DataSourceReader as Reader

from earshot.functions.waves import TINY, scaled
from earshot.sources.audio import FORMATS, encode, numbers

#: Bytes of a file that the first read of its header takes: all of a plain one.
HEAD = 64
#: Bytes that a task reads, and what opening a file counts as.
SPLIT, OPENING = 64 << 20, 1 << 16
#: Files that a task reads the headers of.
HEADERS = 2000
BLOCK = 160_000


@dataclass(frozen=True)
class Header:
    form: int
    channels: int
    rate: int
    bits: int
    start: int
    frames: int

    @property
    def frame(self) -> int:
        return self.channels * (self.bits // 8)


class Window:
    """Ranged reads of a file that count what they take; what the first one took is not read again."""

    def __init__(self, file, size: int):
        self.file, self.size, self.taken, self.head = file, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.head:
            self.head = self._range(0, HEAD)
        return self.head[at : at + n] if at + n <= len(self.head) else self._range(at, n)

    def _range(self, at: int, n: int) -> bytes:
        self.file.seek(min(at, self.size))
        data = self.file.read(min(n, max(self.size - at, 0)))
        self.taken += len(data)
        return data


def read_header(window: Window) -> Header:
    """What a RIFF file says of its samples; chunks between are stepped over, not read."""
    top = window.read(0, 12)
    if top[:4] != b"RIFF" or top[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, form = 12, None
    while at + 8 <= window.size:
        name, n = struct.unpack("<4sI", window.read(at, 8))
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", window.read(at + 8, 16))
            if form[0] == 0xFFFE and n >= 26:
                form = (*struct.unpack("<H", window.read(at + 32, 2)), *form[1:])
        if name == b"data" and form:
            kind, channels, rate, _, _, bits = form
            if (kind, bits) not in FORMATS or not channels:
                raise ValueError(f"no decoder for format {kind} with {bits} bits and {channels} channels")
            # A stream's length may be a mere mark: what the file holds counts.
            return Header(kind, channels, rate, bits, at + 8, min(n, window.size - at - 8) // (channels * (bits // 8)))
        at += 8 + n + n % 2
    raise ValueError("no samples in WAV file")


def samples(raw: bytes, head: Header) -> np.ndarray:
    """The first channel of whole frames as doubles in [-1, 1]."""
    return numbers(raw[: len(raw) // head.frame * head.frame], head.form, head.bits)[:: head.channels]


def uttid(path: str) -> str:
    """File name without its last extension, other dots as underscores."""
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0].replace(".", "_")


@dataclass
class Part(InputPartition):
    """(path, size, first byte, end) of the files that a task reads."""

    files: tuple


def planned(files: list[tuple[str, int]], split: int) -> list[Part]:
    """Tasks of about ``split`` bytes: long files in ranges, short ones together."""
    parts, now, load = [], [], 0
    for path, size in files:
        for a in range(0, max(size, 1), split):
            b = min(a + split, max(size, 1))
            if now and load + (b - a) + OPENING > split:
                parts.append(Part(tuple(now)))
                now, load = [], 0
            now.append((path, size, a, b))
            load += b - a + OPENING
    return parts + [Part(tuple(now))] if now else parts


class WavReader(Reader):
    def __init__(self, options: dict):
        self.path, self.what = options["path"], options.get("what", "blocks")
        self.block, self.split = int(options.get("block", BLOCK)), int(options.get("split", SPLIT))
        self.strict = options.get("mode", "failfast").lower() == "failfast"
        if self.what not in ("headers", "blocks"):
            raise ValueError(f"no such reading: {self.what}")

    def partitions(self) -> list[Part]:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        fs, root = FileSystem.from_uri(self.path)
        single = fs.get_file_info(root)
        found = [single] if single.type == FileType.File else fs.get_file_info(FileSelector(root, recursive=True))
        hidden = lambda f: any(p.startswith((".", "_")) for p in f.path[len(root) :].split("/"))
        files = sorted((f.path, f.size) for f in found if f.type == FileType.File and f.path.lower().endswith(".wav") and not hidden(f))
        if self.what == "headers":
            whole = [(p, n, 0, n) for p, n in files]
            return [Part(tuple(whole[k : k + HEADERS])) for k in range(0, len(whole), HEADERS)] or [Part(())]
        return planned(files, self.split) or [Part(())]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(self.path)
        rows, size = [], 0
        for path, n, a, b in partition.files:
            for row in self._rows(fs, path, n, a, b):
                rows.append(row)
                size += 100 + (0 if row[-1] is None else 8 * len(row[-1]))
                if size > 16 << 20:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _rows(self, fs, path: str, n: int, a: int, b: int):
        with fs.open_input_file(path) as file:
            window = Window(file, n)
            try:
                head = read_header(window)
            except (ValueError, struct.error) as e:
                if self.strict:
                    raise ValueError(f"{path}: {e}") from e
                if a == 0:
                    yield (uttid(path), path, None, None, None, str(e), None, None)
                return
            known = (uttid(path), path, head.rate, head.channels, head.frames, None)
            if self.what == "headers":
                yield (*known, None, None)
                return
            step = self.block * head.frame
            # The blocks that begin in this range; the first range has those that begin before it, too.
            first = 0 if a == 0 else max(-(-(a - head.start) // step), 0)
            for k in range(first, -(-head.frames // self.block)):
                at = head.start + k * step
                if at >= b and not (k == 0 and a == 0):
                    break
                if k == 0 and a > 0:
                    continue
                yield (*known, k, samples(window.read(at, min(step, head.start + head.frames * head.frame - at)), head))
            if a == 0 and not head.frames:
                yield (*known, None, None)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64())]
        names = ["uttid", "path", "sample_rate", "channels", "frames", "problem", "block", "samples"]
        keep = len(names) if self.what == "blocks" else 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in list(zip(zip(*rows), kinds))[:keep]], names[:keep])


@dataclass
class Written(WriterCommitMessage):
    """(staged, final) paths of the files of a task that is done."""

    files: tuple


class WavWriter(DataSourceWriter):
    """Rows (uttid, sample_rate, w) as one file each, in folders by the hash of their id."""

    def __init__(self, options: dict, schema):
        self.path, self.folders = options["path"].rstrip("/"), int(options.get("folders", 256))
        self.at = [schema.fieldNames().index(c) for c in ("uttid", "sample_rate", "w")]
        self.job = uuid.uuid4().hex

    def _system(self):
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(self.path)
        return fs, root, f"{root}/.wav-{self.job}"

    def write(self, iterator) -> Written:
        fs, root, stage = self._system()
        task, files, made = uuid.uuid4().hex, [], set()
        fs.create_dir(f"{stage}/{task}", recursive=True)
        for row in iterator:
            name, rate, w = (row[k] for k in self.at)
            if w is None:
                continue
            folder = f"{root}/{crc32(str(name).encode()) % self.folders}"
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            staged = f"{stage}/{task}/{len(files)}"
            with fs.open_output_stream(staged) as out:
                out.write(encode(np.asarray(w, np.float64), int(rate)))
            files.append((staged, f"{folder}/{str(name).replace('/', '%2F')}.wav"))
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        fs, _, stage = self._system()
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: fs.move(*f), [f for m in messages if m for f in m.files]))
        self._clean(fs, stage)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _, stage = self._system()
        self._clean(fs, stage)

    def _clean(self, fs, stage: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(stage).type == FileType.Directory:
            fs.delete_dir(stage)


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        known = "uttid string, path string, sample_rate int, channels int, frames bigint, problem string"
        return known if self.options.get("what") == "headers" else f"{known}, block bigint, samples array<double>"

    def reader(self, schema) -> Reader:
        return WavReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WavWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSource)


def headers(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(uttid, path, sample_rate, channels, frames, problem) of the .wav files below ``path``, by a few bytes of each.

    Unless ``strict``, a file that is no WAV file gives a row with its problem.
    """
    register(spark)
    return spark.read.format("wav").option("what", "headers").option("mode", "failfast" if strict else "permissive").load(path)


def recordings(spark: SparkSession, path: str, block: int = BLOCK, strict: bool = True, split: int = SPLIT) -> DataFrame:
    """The same with (block, samples): a row for each ``block`` samples of a file's first channel; a file without samples gives one without block."""
    register(spark)
    return spark.read.format("wav").option("block", block).option("split", split).option("mode", "failfast" if strict else "permissive").load(path)


def save(rows: DataFrame, path: str, folders: int = 256) -> None:
    """Rows (uttid, sample_rate, w) as .wav files below ``path``: all of them, or none if the job fails. Files of the same name are replaced; null waves give none."""
    register(rows.sparkSession)
    rows.select("uttid", "sample_rate", "w").write.format("wav").mode("append").option("folders", folders).save(path)


def leveled(rows: DataFrame, level: float) -> DataFrame:
    """Rows (path, block, samples) at a mean magnitude of ``level`` dB of their whole file, whose blocks are summed by path."""
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + F.abs(x))
    means = rows.filter("block IS NOT NULL").groupBy("path").agg((F.sum(total) / F.sum(F.size("samples"))).alias("__mean"))
    by = F.pow(F.lit(10.0), F.lit(float(level) / 20)) / (F.col("__mean") + F.lit(TINY))
    return rows.join(means, "path", "left").withColumn("samples", scaled(F.col("samples"), by)).drop("__mean")
