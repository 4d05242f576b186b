"""Numpy kernels over array columns, a record batch at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a task's batch of waveforms: half a minute of audio is megabytes.
ROWS_PER_BATCH = 128


def by_row(rows: DataFrame, kernel: Callable[..., dict], schema: str, columns: list[str]) -> DataFrame:
    """``rows`` with more columns (``schema``), made by ``kernel`` from the values of ``columns``: arrays come as numpy, nulls as None.

    The kernel returns a value for each new column. Rows with a null among the arguments get nulls.
    """
    kept = rows.columns
    new = [c.split()[0] for c in schema.split(", ")]
    kinds = rows.limit(0).select(*(F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in schema.split(", "))).schema

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(kinds)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_PER_BATCH):
                batch = whole.slice(start, ROWS_PER_BATCH)
                args = [[None if not x.is_valid else (x.values.to_numpy(zero_copy_only=False) if isinstance(x, pa.ListScalar) else x.as_py()) for x in batch.column(c)] for c in columns]
                made = [None if any(a is None for a in row) else kernel(*row) for row in zip(*args)]
                out = [pa.array([None if m is None else _plain(m[c]) for m in made], wanted.field(c).type) for c in new]
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*kept, *new])

    return rows.mapInArrow(work, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), schema]))


def _plain(x):
    return [_plain(v) for v in x] if isinstance(x, (np.ndarray, list)) and getattr(x, "ndim", 1) > 1 else (np.asarray(x, np.float64) if isinstance(x, np.ndarray) else x)


def spectra(rows: DataFrame, n_fft: int, hop: int, w: str = "w", scale: str = "no", bins: int | None = None, sample_rate: int = 16000, least: float = 50.0, most: float = 6000.0) -> DataFrame:
    """(key, frame, re, im): one row per frame of each waveform (key, w); null waveforms give none.

    Bins are those of a DFT, or with ``scale`` "linear" or "log" ``bins`` of them spread from ``least`` to ``most`` hertz.
    """
    from earshot.functions.kernels import fourier_kernels, frames, hann, stft

    cos, sin = (None, None) if scale == "no" else fourier_kernels(n_fft, sample_rate, scale, least, most, bins)

    def transform(x):
        if cos is None:
            return stft(x, n_fft, hop)
        cut = frames(x, n_fft, hop) * hann(n_fft)
        return cut @ cos.T, -(cut @ sin.T)

    def work(batches):
        for pdf in batches:
            for key, x in zip(pdf["key"], pdf["w"]):
                if x is None:
                    continue
                re, im = transform(np.asarray(x, np.float64))
                if len(re):
                    yield pd.DataFrame({"key": [key] * len(re), "frame": range(len(re)), "re": list(re), "im": list(im)})

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", F.col(w).alias("w")).mapInPandas(work, f"key {kind}, frame int, re array<double>, im array<double>")


def waveforms(frames: DataFrame, n_fft: int, hop: int) -> DataFrame:
    """(key, w) from spectra (key, frame, re, im), by one group per waveform."""
    from earshot.functions.kernels import istft

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "w": [istft(np.stack(pdf["re"].to_numpy()), np.stack(pdf["im"].to_numpy()), n_fft, hop)]})

    kind = frames.schema["key"].dataType.simpleString()
    return frames.groupBy("key").applyInPandas(whole, f"key {kind}, w array<double>")


def mels(rows: DataFrame, sample_rate: int, n_fft: int, hop: int, n_mels: int, power: int = 2, w: str = "w", phase: bool = False) -> DataFrame:
    """``rows`` with ``mel``, an array of frames of mel bands; with ``phase`` the phases of the spectrum too, one array per frame."""
    from earshot.functions.kernels import mel_spectrogram, stft

    def bands(x):
        x = np.asarray(x, np.float64)
        out = {"mel": mel_spectrogram(x, sample_rate, n_fft, hop, n_mels, power)}
        if phase:
            re, im = stft(x, n_fft, hop)
            out["phase"] = np.arctan2(im, re)
        return out

    return by_row(rows, bands, "mel array<array<double>>" + (", phase array<array<double>>" if phase else ""), [w])


def from_mels(rows: DataFrame, sample_rate: int, n_fft: int, hop: int, power: int = 2) -> DataFrame:
    """``rows`` (mel, phase, as of ``mels``) with ``back``, the waveform through the pseudo-inverse of the filters; empty where there is no frame."""
    from earshot.functions.kernels import from_mel_spectrogram

    def wave(mel, phase):
        if not len(mel):
            return {"back": np.empty(0)}
        return {"back": from_mel_spectrogram(np.stack(mel), np.stack(phase), sample_rate, n_fft, hop, power)}

    return by_row(rows, wave, "back array<double>", ["mel", "phase"])


def causal_filtered(rows: DataFrame, w: str = "w", h: str = "h") -> DataFrame:
    """``rows`` with ``x``: ``w`` convolved with the taps ``h``, looking back only, at the size of ``w``; without taps all zeros."""
    from earshot.functions.kernels import causal

    return by_row(rows, lambda a, b: {"x": causal(np.asarray(a, np.float64), np.asarray(b, np.float64)) if len(a) and len(b) else np.zeros(len(a))}, "x array<double>", [w, h])


def band_filtered(rows: DataFrame, sample_rate: int, kind: str, low: str | None = None, high: str | None = None, taps: int = 513, w: str = "w") -> DataFrame:
    """``rows`` with ``x``: ``w`` with what lies below ``high`` hertz only (kind "low"), or from ``low`` to ``high`` ("band"), at its own size; ``low`` and ``high`` name columns."""
    from earshot.functions.kernels import convolve, pass_band

    if kind not in ("low", "band"):
        raise ValueError(f"no such band: {kind}")

    def work(x, *edges):
        a, b = (0.0, *edges) if kind == "low" else edges
        if not 0 <= a < b <= sample_rate / 2:
            raise ValueError("the band lies outside of the spectrum")
        x = np.asarray(x, np.float64)
        return {"x": convolve(x, pass_band(a / sample_rate, b / sample_rate, taps // 2), "same") if len(x) else x}

    return by_row(rows, work, "x array<double>", [w, high] if kind == "low" else [w, low, high])


def normalized(rows: DataFrame, x: str, by: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: ``x`` at zero mean and unit variance (biased, 1e-8 under the root) among the rows that agree in ``by``.

    By (key), (key, frame) or (key, bin) for the usual three. The statistics are summed in part before the shuffle and
    joined back, so that a long group is never in one task; rows with a null in ``by`` get null.
    """
    stats = rows.groupBy(*by).agg(F.avg(x).alias("__mean"), F.sqrt(F.var_pop(x) + F.lit(1e-8)).alias("__spread"))
    return rows.join(stats, by, "left").withColumn(name, (F.col(x) - F.col("__mean")) / F.col("__spread")).drop("__mean", "__spread")


def resampled(rows: DataFrame, rate: int, columns: list[str], from_rate: str = "sample_rate") -> DataFrame:
    """``rows`` with the waveforms in ``columns`` brought from the rate in column ``from_rate`` to ``rate``; the column says ``rate`` then. A null rate counts as ``rate``."""
    from earshot.functions.kernels import resample

    def change(frm, *waves):
        return {f"__{c}": None if w is None or not len(w) else resample(np.asarray(w, np.float64), frm, rate) for c, w in zip(columns, waves)}

    none = F.array().cast("array<double>")
    args = rows.withColumns({"__rate": F.coalesce(from_rate, F.lit(rate))} | {f"__in_{c}": F.coalesce(c, none) for c in columns})
    made = by_row(args, change, ", ".join(f"__{c} array<double>" for c in columns), ["__rate", *(f"__in_{c}" for c in columns)])
    done = made.withColumns({c: F.when(F.size(c) > 0, F.col(f"__{c}")).otherwise(F.col(c).cast("array<double>")) for c in columns} | {from_rate: F.lit(rate)})
    return done.drop("__rate", *(f"__in_{c}" for c in columns), *(f"__{c}" for c in columns))
