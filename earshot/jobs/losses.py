"""Losses by name: functions from a table of rows to a one-row table (loss)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.operators import embeddings, scores, spectral

Loss = Callable[[DataFrame], DataFrame]


def _spectral(rows: DataFrame, column: str) -> DataFrame:
    return spectral.spectral_losses(rows).agg(F.avg(column).alias("loss"))


#: Rows of signal losses are (key, enh, clean), of "f1" (label, p), of speaker losses (uttid, spk, dvec), of "triplet" (anchor, positive, negative).
LOSSES: dict[str, Loss] = (
    {k: partial(scores.sdr_loss, kind=k) for k in scores.FAMILY}
    | {"stft": partial(_spectral, column="stft_loss"), "ov": partial(_spectral, column="over_suppression")}
    | {"f1": scores.soft_f1_loss, "ge2e": embeddings.ge2e_loss, "triplet": partial(embeddings.triplet_loss, margin=0.3, distance="cosine")}
)
#: Names of sums.
SUMS = {"stft_ov": "stft+ov", "sisnr_stft": "sisnr+stft", "sisnr_ov": "sisnr+ov"}


def by_rows(f: Callable[[Column, Column, Column], Column], inactive: str | None = None) -> Loss:
    """A user's loss of (enh, ref, inactive) as columns, the mean over rows; without a flag no row is inactive."""
    return lambda rows: rows.agg(F.avg(f(F.col("enh"), F.col("clean"), F.col(inactive) if inactive else F.lit(False))).alias("loss"))


def loss(name: str, user: dict[str, Loss] | None = None, classes: DataFrame | None = None) -> Loss:
    """The loss of a name, or of names joined by "+" (their sum; null if one of them is). Names in ``user`` come first; "aamsoftmax" takes the weights (spk, weight) of ``classes``."""
    known = LOSSES | (user or {})
    if classes is not None:
        known.setdefault("aamsoftmax", lambda rows: embeddings.aam_softmax_loss(rows, classes))
    name = name.strip()
    parts = [known[n.strip()] for n in (name if name in known else SUMS.get(name, name)).split("+")]

    def added(rows: DataFrame) -> DataFrame:
        each = reduce(DataFrame.unionByName, (f(rows) for f in parts))
        return each.agg(F.when(F.count("loss") == len(parts), F.sum("loss")).alias("loss"))

    return added
