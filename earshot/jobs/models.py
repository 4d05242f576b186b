"""A user's model over all rows. No model is shipped."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.functions.signal import by_row
from earshot.functions.waves import rescaled
from earshot.sources import wav_source


def enhanced(rows: DataFrame, model: Callable[..., np.ndarray], columns: list[str] | None = None) -> DataFrame:
    """``rows`` with ``enh``, the model's output for the waveforms in ``columns`` (by default w)."""
    return by_row(rows, lambda *a: {"enh": np.asarray(model(*a), np.float64)}, "enh array<double>", columns or ["w"])


def extracted(mixtures: DataFrame, clips: DataFrame, model: Callable[[np.ndarray, np.ndarray], np.ndarray], level_db: float = -28.0) -> DataFrame:
    """Target-speaker extraction: each mixture (key, w) with all its enrollment clips (key, pos, w), each at a level, one after another."""
    order = F.sort_array(F.collect_list(F.struct("pos", "w")))
    joined = clips.withColumn("w", rescaled(F.col("w"), level_db, "avg", "dB")).groupBy("key").agg(F.flatten(F.transform(order, lambda c: c["w"])).alias("enroll"))
    return enhanced(mixtures.join(joined, "key"), model, ["w", "enroll"])


def conditioned(mixtures: DataFrame, vectors: DataFrame, model: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Target-speaker extraction from vectors: each mixture (key, w) with its speaker's vector (key, dvec); a mixture without one gets null."""
    return enhanced(mixtures.join(vectors.select("key", "dvec"), "key", "left"), model, ["w", "dvec"])


def embeddings(clips: DataFrame, model: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(uttid, spk, dvec) from (uttid, spk, w)."""
    return by_row(clips.select("uttid", "spk", "w"), lambda w: {"dvec": np.asarray(model(w), np.float64)}, "dvec array<double>", ["w"]).drop("w")


def enhanced_files(rows: DataFrame, model: Callable[[np.ndarray], np.ndarray], path: str, sample_rate: int = 16000) -> DataFrame:
    """Rows (key, w) through a model, one .wav file each below ``path``; returns (uttid, path, sample_rate, channels, frames, problem) of what is there then."""
    made = enhanced(rows, model)
    wav_source.save(made.select(F.col("key").cast("string").alias("uttid"), F.lit(sample_rate).alias("sample_rate"), F.col("enh").alias("w")), path)
    return wav_source.headers(rows.sparkSession, path)
