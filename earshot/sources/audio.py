"""WAV files: listing, headers, decoding, writing."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions.waves import rescaled
from earshot.operators.manifests import last_of_each
from earshot.sources.store import stored
from earshot.sources.text import write_manifests


def listing(spark: SparkSession, path: str, suffix: str = ".wav") -> DataFrame:
    """(path, bytes) of files below ``path`` whose names end in ``suffix``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    return files.select("path", F.col("length").alias("bytes"))


def utterance_id(path):
    """File name without its last extension, other dots as underscores."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"\.", "_")


def indexed_folder(spark: SparkSession, path: str) -> DataFrame:
    """(uttid, path) of the WAV files below ``path``; of equal ids the last path counts."""
    return last_of_each(listing(spark, path).select(utterance_id(F.col("path")).alias("uttid"), "path"), "uttid", "path")


def header(data: bytes) -> tuple[int, int, int, int, int, int]:
    """(format, channels, sample rate, bits, start of samples, bytes of samples) of a RIFF file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
            if form[0] == 0xFFFE:
                form = (struct.unpack("<H", data[at + 32 : at + 34])[0], *form[1:])
        if name == b"data" and form:
            return form[0], form[1], form[2], form[5], at + 8, size
        at += 8 + size + size % 2
    raise ValueError("no samples in WAV file")


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and samples (channels, n) as doubles in [-1, 1]: PCM of 8 (without sign), 16, 24 or 32 bits, floats of 32 or 64."""
    form, channels, rate, bits, start, size = header(data)
    if (form, bits) not in FORMATS:
        raise ValueError(f"no decoder for format {form} with {bits} bits")
    raw = data[start : start + size]
    raw = raw[: len(raw) // (channels * bits // 8) * (channels * bits // 8)]
    return rate, numbers(raw, form, bits).reshape(-1, channels).T


#: Fixed values: (format, bits) of what is decoded. 1 is whole numbers, 3 floats; 8 bits have no sign.
FORMATS = {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)}


def numbers(raw: bytes, form: int, bits: int) -> np.ndarray:
    """Samples of one of FORMATS as doubles."""
    if form == 3:
        return np.frombuffer(raw, f"<f{bits // 8}").astype(np.float64)
    if bits == 8:
        return (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    if bits == 24:
        three = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16) << 8 >> 8) / 2.0**23
    return np.frombuffer(raw, f"<i{bits // 8}") / 2.0 ** (bits - 1)


def encode(w: np.ndarray, rate: int) -> bytes:
    """A one-channel WAV file of 32-bit floats."""
    raw = np.asarray(w, "<f4").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, rate, rate * 4, 4, 32) + b"data" + struct.pack("<I", len(raw)) + raw


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, sample_rate, seconds, channels): seconds to hundredths; a few bytes of each file are read, wherever its samples start."""
    from earshot.sources import wav_source

    seconds = F.round(F.col("frames") / F.col("sample_rate"), 2).alias("seconds")
    return wav_source.headers(spark, path).select("path", "sample_rate", seconds, "channels")


def waves(spark: SparkSession, path: str, level: float | None = None) -> DataFrame:
    """(uttid, path, sample_rate, channels, w): the first channel of each file; at a mean magnitude of ``level`` dB, if given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path).select("path", utterance_id(F.col("path")).alias("uttid"), "content")

    def work(batches):
        for pdf in batches:
            for path, uttid, content in zip(pdf["path"], pdf["uttid"], pdf["content"]):
                rate, x = decode(bytes(content))
                yield pd.DataFrame({"uttid": [uttid], "path": [path], "sample_rate": [rate], "channels": [len(x)], "w": [x[0]]})

    rows = files.mapInPandas(work, "uttid string, path string, sample_rate int, channels int, w array<double>")
    return rows if level is None else rows.withColumn("w", rescaled(F.col("w"), level, "avg", "dB"))


def write_waves(rows: DataFrame, path: str) -> None:
    """Rows (uttid, sample_rate, w) as Parquet with the WAV bytes beside the id: one table in place of very many small files."""

    def work(batches):
        for pdf in batches:
            yield pd.DataFrame({"uttid": pdf["uttid"], "wav": [encode(np.asarray(w), int(r)) for w, r in zip(pdf["w"], pdf["sample_rate"])]})

    rows.select("uttid", "sample_rate", "w").mapInPandas(work, "uttid string, wav binary").write.mode("overwrite").parquet(path)


def write_wave_files(rows: DataFrame, path: str, folders: int = 256) -> DataFrame:
    """(uttid, path) of the .wav files written for rows (uttid, sample_rate, w), for manifests to point at.

    A file's folder below ``path`` (shared by all executors) follows from its id, and a file is moved into place when
    it is whole, so a task that runs again writes the same files. Slashes in ids become "%2F"; of equal ids one stays.
    """

    def work(batches):
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(path)
        for pdf in batches:
            made = []
            for uttid, folder, rate, w in zip(pdf["uttid"], pdf["folder"], pdf["sample_rate"], pdf["w"]):
                name = f"{folder}/{str(uttid).replace('/', '%2F')}.wav"
                fs.create_dir(f"{root}/{folder}", recursive=True)
                part = f"{root}/{folder}/.{uuid.uuid4().hex}"
                try:
                    with fs.open_output_stream(part) as out:
                        out.write(encode(np.asarray(w), int(rate)))
                    fs.move(part, f"{root}/{name}")
                except BaseException:
                    # A task that is stopped leaves no part behind.
                    if fs.get_file_info(part).is_file:
                        fs.delete_file(part)
                    raise
                made.append(f"{path}/{name}")
            yield pd.DataFrame({"uttid": pdf["uttid"].astype(str), "path": made})

    placed = rows.select("uttid", F.pmod(F.xxhash64("uttid"), F.lit(folders)).alias("folder"), "sample_rate", "w")
    return stored(placed.mapInPandas(work, "uttid string, path string"), "wave_files")


def write_activity(labels: DataFrame, path: str, sample_rate: int = 16000) -> DataFrame:
    """Voice activity labels (key, pos, label) as one .wav of zeros and ones for each key, and a manifest ``ref2vad`` of their paths."""
    order = F.sort_array(F.collect_list(F.struct("pos", F.col("label").cast("double").alias("label"))))
    rows = labels.groupBy("key").agg(F.transform(order, lambda x: x["label"]).alias("w"))
    files = write_wave_files(rows.select(F.col("key").cast("string").alias("uttid"), F.lit(sample_rate).alias("sample_rate"), "w"), f"{path}/vad")
    write_manifests(files, path, {"ref2vad": "path"}, key="uttid")
    return files


def read_waves(spark: SparkSession, path: str) -> DataFrame:
    """(uttid, sample_rate, w) of what ``write_waves`` wrote."""

    def work(batches):
        for pdf in batches:
            rows = [decode(bytes(b)) for b in pdf["wav"]]
            yield pd.DataFrame({"uttid": pdf["uttid"], "sample_rate": [r for r, _ in rows], "w": [x[0] for _, x in rows]})

    return spark.read.parquet(path).mapInPandas(work, "uttid string, sample_rate int, w array<double>")


def wave_sink(path: str, sample_rate: int = 16000):
    """A ``foreachBatch`` function for results of event-time streams (stream_id, started, fate, start, samples): the final .wav of each stream.

    A micro-batch leaves its samples in a folder of its own number, and streams that end in it get their file from all
    their batches; the same batch again overwrites the same folder and the same files. Files of streams are found by
    the day that they began, so that an ending does not read all that was ever heard. A stream's file is one row.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        day = F.to_date("started").cast("string").alias("day")
        batch.filter("fate IS NULL AND samples IS NOT NULL").select("stream_id", "started", "start", "samples", day).write.mode("overwrite").partitionBy("day").parquet(f"{path}/parts/batch={number}")
        ended = batch.filter("fate = 'closed'").select("stream_id", "started", day).distinct()
        days = [r["day"] for r in ended.select("day").distinct().collect()]
        if days:
            schema = f"stream_id {batch.schema['stream_id'].dataType.simpleString()}, started timestamp, start bigint, samples array<double>, batch bigint, day string"
            heard = spark.read.schema(schema).parquet(f"{path}/parts").filter((F.col("batch") <= number) & F.col("day").isin(days))
            order = F.sort_array(F.collect_list(F.struct("start", "samples")))
            rows = heard.join(ended, ["stream_id", "started", "day"]).groupBy("stream_id", "started").agg(F.flatten(F.transform(order, lambda x: x["samples"])).alias("w"))
            name = F.concat_ws("_", F.col("stream_id").cast("string"), F.unix_micros("started").cast("string"))
            write_wave_files(rows.select(name.alias("uttid"), F.lit(sample_rate).alias("sample_rate"), "w"), f"{path}/waves")
        batch.unpersist()

    return write
