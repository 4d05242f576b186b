"""Spectral losses of enhanced audio against references. Rows are (key, enh, clean) with arrays of samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.functions import kernels
from earshot.functions.signal import by_row


def spectral_losses(pairs: DataFrame, x: str = "enh", y: str = "clean") -> DataFrame:
    """``pairs`` with, for each waveform, multi-resolution loss, over-suppression, and the squared norms of the first resolution.

    Waveforms are cut to the shorter of both. Those with fewer samples than half the longest transform get nulls.
    """

    def score(a, b):
        n = min(len(a), len(b))
        a, b = np.array(a[:n], np.float64), np.array(b[:n], np.float64)
        if n <= max(r[0] for r in kernels.RESOLUTIONS) // 2:
            return {"stft_loss": None, "over_suppression": None, "off": None, "whole": None}
        off, whole, _ = kernels.spectral_terms(a, b, *kernels.RESOLUTIONS[0])
        return {"stft_loss": kernels.spectral_loss(a, b), "over_suppression": kernels.over_suppression(a, b), "off": off, "whole": whole}

    return by_row(pairs, score, "stft_loss double, over_suppression double, off double, whole double", [x, y])


def corpus_convergence(scored: DataFrame) -> DataFrame:
    """(convergence, stft_loss, over_suppression, n): spectral convergence over all waveforms together, and means by waveform."""
    return scored.agg(F.sqrt(F.sum("off") / F.sum("whole")).alias("convergence"), F.avg("stft_loss").alias("stft_loss"), F.avg("over_suppression").alias("over_suppression"), F.count("stft_loss").alias("n"))
