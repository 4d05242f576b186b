"""Augmentation of a corpus: first a plan of all draws as columns, then one pass over the waveforms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions import kernels, waves
from earshot.functions.draws import normal, uniform, whole
from earshot.functions.signal import by_row


@dataclass(frozen=True)
class Chances:
    """Probabilities of the steps and the ranges of their parameters."""

    speed: float = 0.5
    rir: float = 0.8
    noise: float = 0.8
    response: float = 0.8
    speeds: tuple[float, float] = (0.9, 1.1)
    snrs: tuple[float, float] = (-5.0, 15.0)
    volumes: tuple[float, float] | None = None


TSE = Chances(snrs=(5.0, 15.0))
ENROLLMENT = Chances(speed=0.0, rir=0.5, noise=0.5, snrs=(5.0, 15.0))


def plan(rows: DataFrame, chances: Chances = Chances(), seed: int = 0, key: str = "key") -> DataFrame:
    """``rows`` with speed, use_rir, use_noise, snr, noise_at (a share), a1, a2, b1, b2 and volume; null where a step is left out."""
    k = F.col(key)
    drawn = lambda salt, chance, low, high: F.when(uniform(k, f"{salt}?", seed) < chance, uniform(k, salt, seed, low, high))
    turned = uniform(k, "response?", seed) < chances.response
    out = rows.withColumns(
        {
            "speed": drawn("speed", chances.speed, *chances.speeds),
            "use_rir": uniform(k, "rir?", seed) < chances.rir,
            "use_noise": uniform(k, "noise?", seed) < chances.noise,
            "snr": drawn("noise", chances.noise, *chances.snrs),
            "noise_at": uniform(k, "noise_at", seed),
        }
        | {c: F.when(turned, uniform(k, c, seed, -3 / 8, 3 / 8)) for c in ("a1", "a2", "b1", "b2")}
    )
    return out.withColumn("volume", uniform(k, "volume", seed, *chances.volumes) if chances.volumes else F.lit(1.0))


def paired_offset(ref: Column, n: int, key: Column, tries: int = 8, seed: int = 0) -> Column:
    """An offset for cutting ``n`` samples: the first of ``tries`` draws where the reference is not silent.

    If none is, the cut is drawn around a drawn sample that is not zero; only where every sample is, the last draw stays.
    Without ``tries`` the first draw stays, heard or not.
    """
    if not tries:
        return whole(key, "crop.0", waves.room(ref, n), seed)
    last = waves.room(ref, n)
    drawn = [whole(key, f"crop.{k}", last, seed) for k in range(tries)]
    heard = [F.when(~waves.silent(waves.cut(ref, d, n)), d) for d in drawn]
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ref) - 1, F.lit(0))), lambda i: F.coalesce(F.get(ref, i), F.lit(0.0)) != 0)
    place = F.get(places, whole(key, "crop.place", F.size(places), seed).cast("int"))
    low, high = F.greatest(place - n + 1, F.lit(0)), F.least(place, last - 1)
    around = F.when(F.size(places) > 0, low + whole(key, "crop.around", high - low + 1, seed))
    return F.coalesce(*heard, around, drawn[-1])


def _augmented(w, clean, noise, rir, speed, use_rir, use_noise, snr, noise_at, a1, a2, b1, b2, volume, sample_rate: int, target: str, mode: str):
    x, y = np.array(w, np.float64), np.array(clean, np.float64)
    if speed == speed:
        x, y = kernels.changed_speed(x, speed), kernels.changed_speed(y, speed)
    if use_rir and len(rir):
        x, y = kernels.reverberated(x, rir, sample_rate), kernels.reverberated(y, rir, sample_rate, target)
    if use_noise and len(noise):
        n = len(x)
        if len(noise) >= n:
            at = int(noise_at * (len(noise) - n + 1))
            added = noise[at : at + n]
        else:
            added = np.tile(noise, -(-n // len(noise)) + 1)[:n]
        a, b = (x * x).sum(), (added * added).sum()
        if mode == "reference":
            a, b = np.sqrt(a), np.sqrt(b)
        x = x + np.sqrt(a / (10 ** (snr / 10) * b + 1e-8)) * added
    if a1 == a1:
        x, y = kernels.biquad(x, (a1, a2), (b1, b2)), kernels.biquad(y, (a1, a2), (b1, b2))
    if volume != 1.0:
        x, y = np.clip(x * volume, -1, 1), np.clip(y * volume, -1, 1)
    whole_ = np.isfinite(x).all() and np.isfinite(y).all()
    return {"process_wav": x if whole_ else np.array(w, np.float64), "clean_wav": y if whole_ else np.array(clean, np.float64), "augmented": bool(whole_)}


def augmented(planned: DataFrame, sample_rate: int = 16000, target: str = "image", mode: str = "reference") -> DataFrame:
    """Planned rows (w, clean, noise, rir, plan) with process_wav and clean_wav, without noise and rir.

    Order: speed, room, noise, response, volume. The clean side replays speed, room (with the part of the response
    that ``target`` names), response and volume. If a sample comes out as no number, both sides stay as they were,
    ``augmented`` is false and the plan's parameters are null.
    """
    columns = ["w", "clean", "noise", "rir", "speed", "use_rir", "use_noise", "snr", "noise_at", "a1", "a2", "b1", "b2", "volume"]
    nan, none = F.lit(float("nan")), F.array().cast("array<double>")
    args = planned.withColumns({f"__{c}": F.coalesce(c, nan) for c in ("speed", "snr", "a1", "a2", "b1", "b2")} | {f"__{c}": F.coalesce(c, none) for c in ("noise", "rir")})
    names = [f"__{c}" if f"__{c}" in args.columns else c for c in columns]
    made = by_row(args, lambda *a: _augmented(*a, sample_rate, target, mode), "process_wav array<double>, clean_wav array<double>, augmented boolean", names)
    made = made.drop(*(c for c in args.columns if c.startswith("__")), "noise", "rir")
    return made.withColumns({c: F.when(F.col("augmented"), F.col(c)) for c in ("speed", "snr", "a1", "a2", "b1", "b2")})


def replayed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``augmented`` rows with the waveforms in ``columns`` at the rows' speed and volume; where augmentation failed they stay."""

    def change(speed, volume, ok, *of):
        out = {}
        for c, w in zip(columns, of):
            x = np.array(w, np.float64)
            if ok and speed == speed:
                x = kernels.changed_speed(x, speed)
            out[f"__{c}"] = np.clip(x * volume, -1, 1) if ok and volume != 1.0 else x
        return out

    args = rows.withColumn("__speed", F.coalesce("speed", F.lit(float("nan"))))
    made = by_row(args, change, ", ".join(f"__{c} array<double>" for c in columns), ["__speed", "volume", "augmented", *columns])
    return made.withColumns({c: F.col(f"__{c}") for c in columns}).drop("__speed", *(f"__{c}" for c in columns))


def with_white_noise(rows: DataFrame, snr_db: float, seed: int = 0, key: str = "key", w: str = "w") -> DataFrame:
    """``rows`` with ``x``: ``w`` and Gaussian noise at a ratio to its power; the noise depends on the key alone."""
    drawn = rows.withColumn("__seed", whole(F.col(key), "white", 2**31, seed))
    made = by_row(drawn, lambda a, s: {"x": np.asarray(a, np.float64) + kernels.white_noise(np.asarray(a, np.float64), snr_db, s)}, "x array<double>", [w, "__seed"])
    return made.drop("__seed")


#: Speed and volume that always change, as one preset.
SPEED_AND_VOLUME = Chances(speed=1.0, rir=0.0, noise=0.0, response=0.0, speeds=(0.8, 1.2), volumes=(0.125, 2.0))


def enrollment_level(key: Column, seed: int = 0) -> Column:
    """Level of an enrollment clip in dB: normal around -28 with variance 10, to tenths."""
    return F.round(F.lit(-28.0) + F.sqrt(F.lit(10.0)) * normal(key, "level", seed), 1)
