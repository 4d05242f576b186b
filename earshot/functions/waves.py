"""Signal arithmetic on array columns with built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions.draws import uniform

TINY = 1e-14


def let(value: Column, f) -> Column:
    """f(value) with ``value`` computed once: inside a lambda over an array an outer expression would be computed for every place."""
    return F.transform(F.array(value), f)[0]


def total(w: Column, f=lambda x: x) -> Column:
    """Sum of f(x) over an array of doubles."""
    return F.aggregate(w, F.lit(0.0), lambda acc, x: acc + f(x))


def dot(a: Column, b: Column) -> Column:
    """Inner product of equally long arrays."""
    return total(F.zip_with(a, b, lambda x, y: x * y))


def mean_abs(w: Column) -> Column:
    return total(w, F.abs) / F.size(w)


def peak_abs(w: Column) -> Column:
    return F.array_max(F.transform(w, F.abs))


def scaled(w: Column, by: Column) -> Column:
    return let(by, lambda v: F.transform(w, lambda x: x * v))


def normalized(w: Column, kind: str = "avg") -> Column:
    """Divide by the mean ("avg") or largest ("peak") magnitude."""
    if kind not in ("avg", "peak"):
        raise ValueError(f"no such level: {kind}")
    level = (mean_abs(w) if kind == "avg" else peak_abs(w)) + F.lit(TINY)
    return let(level, lambda v: F.transform(w, lambda x: x / v))


def rescaled(w: Column, level: Column | float, kind: str = "avg", scale: str = "linear") -> Column:
    """Bring to a level, given as a factor ("linear") or in decibels ("dB")."""
    if scale not in ("linear", "dB"):
        raise ValueError(f"no such scale: {scale}")
    level = level if isinstance(level, Column) else F.lit(float(level))
    by = F.pow(F.lit(10.0), level / 20) if scale == "dB" else level
    size = (mean_abs(w) if kind == "avg" else peak_abs(w)) + F.lit(TINY)
    return let(F.struct(by.alias("by"), size.alias("size")), lambda v: F.transform(w, lambda x: v["by"] * (x / v["size"])))


def clamped(w: Column, least: float = -1.0, most: float = 1.0) -> Column:
    return F.transform(w, lambda x: F.greatest(F.lit(least), F.least(F.lit(most), x)))


def padded(w: Column, n: Column | int) -> Column:
    """Zeros on the right up to ``n`` samples; a longer array stays."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.concat(w, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(w), F.lit(0)).cast("int")))


def cut(w: Column, offset: Column, n: Column | int, pad: bool = True) -> Column:
    """``n`` samples from ``offset`` on; an array that is not longer than ``n`` is kept from its start, with zeros after it if ``pad``."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(F.size(w) > n, F.slice(w, (offset + 1).cast("int"), n.cast("int"))).otherwise(padded(w, n) if pad else w)


def room(w: Column, n: Column | int) -> Column:
    """How many offsets a cut of ``n`` samples can have."""
    return F.greatest(F.size(w) - n + 1, F.lit(1))


def dropped(w: Column, start: Column | float, width: Column | float) -> Column:
    """Zero a stretch given by start and width as shares of the length; a width that runs over the end is cut."""
    start, width = (x if isinstance(x, Column) else F.lit(float(x)) for x in (start, width))
    width = F.when(start + width > 1, 1 - start).otherwise(width)
    a = F.floor(start * F.size(w))
    ends = F.struct(a.alias("a"), (a + F.floor(width * F.size(w))).alias("b"))
    return let(ends, lambda e: F.transform(w, lambda x, i: F.when((i >= e["a"]) & (i < e["b"]), 0.0).otherwise(x)))


def one_hot(y: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == y, 1.0).otherwise(0.0))


def length_mask(length: Column, longest: Column | int) -> Column:
    """1 up to ``length``, 0 after it."""
    longest = longest if isinstance(longest, Column) else F.lit(longest)
    return F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.when(i < length, 1.0).otherwise(0.0))


def aligned(ref: Column, w: Column) -> Column:
    """``ref`` at the length of ``w``: its tail is cut, or zeros come before it."""
    gap = F.greatest(F.size(w) - F.size(ref), F.lit(0)).cast("int")
    return F.when(F.size(ref) >= F.size(w), F.slice(ref, F.lit(1), F.size(w))).otherwise(F.concat(F.array_repeat(F.lit(0.0), gap), ref))


def silent(w: Column) -> Column:
    """The samples sum to zero."""
    return total(w) == 0


def broken(w: Column) -> Column:
    """Any sample is not a number."""
    return F.exists(w, F.isnan)


def fitted_noise(noise: Column, n: Column, offset: Column) -> Column:
    """``n`` samples of noise: a crop from ``offset`` on if there are enough, else the noise again and again."""
    again = F.flatten(F.array_repeat(noise, (F.ceil(n / F.size(noise)) + 1).cast("int")))
    return F.when(F.size(noise) >= n, F.slice(noise, (offset + 1).cast("int"), n)).otherwise(F.slice(again, F.lit(1), n))


def noisy(w: Column, noise: Column, snr_db: Column, mode: str = "reference") -> Column:
    """Add fitted noise. In mode "reference" the scale compares norms, in mode "power" their squares, which gives the ratio asked for."""
    if mode not in ("reference", "power"):
        raise ValueError(f"no such mode: {mode}")
    a, b = dot(w, w), dot(noise, noise)
    if mode == "reference":
        a, b = F.sqrt(a), F.sqrt(b)
    by = F.sqrt(a / (F.pow(F.lit(10.0), snr_db / 10) * b + F.lit(1e-8)))
    return let(by, lambda v: F.zip_with(w, noise, lambda x, y: x + v * y))


def masked_band(w: Column, start: Column, width: Column, fill: float = 0.0) -> Column:
    """Set places from start to start + width (exclusive) to a value: one axis of a spectrogram mask."""
    ends = F.struct(start.alias("a"), (start + width).alias("b"))
    return let(ends, lambda e: F.transform(w, lambda x, i: F.when((i >= e["a"]) & (i < e["b"]), F.lit(fill)).otherwise(x)))


def masked_spectrogram(frames: Column, key: Column, in_time: tuple[int, int] = (1, 20), in_frequency: tuple[int, int] = (1, 10), fill: float = 0.0, seed: int = 0) -> Column:
    """An array of frames with masks over both axes: for each axis so many stretches, each of a drawn width below the one given and at a drawn place.

    A stretch is one of frames (time) or of bins in every frame (frequency); widths are cut to the axis.
    """
    def spans(n: Column, axis: str, many: int, widest: int) -> list[Column]:
        out = []
        for k in range(many):
            width = F.least(F.floor(uniform(key, f"mask.{axis}.{k}.n", seed) * widest), n)
            start = F.floor(uniform(key, f"mask.{axis}.{k}.at", seed) * (n - width + 1))
            out.append(F.struct(start.alias("a"), (start + width).alias("b")))
        return out

    def hit(i: Column, found: Column) -> Column:
        return F.exists(found, lambda s: (i >= s["a"]) & (i < s["b"]))

    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    times, bins = spans(F.size(frames), "time", *in_time), spans(F.size(F.get(frames, F.lit(0))), "frequency", *in_frequency)
    masks = F.struct(*(F.array(*s).cast("array<struct<a:bigint,b:bigint>>").alias(n) if s else none.alias(n) for n, s in (("t", times), ("f", bins))))
    return let(masks, lambda m: F.transform(frames, lambda row, t: F.transform(row, lambda x, f: F.when(hit(t, m["t"]) | hit(f, m["f"]), F.lit(float(fill))).otherwise(x))))


def mel(hz: Column) -> Column:
    """Hertz to mel: linear below 1000 Hz, logarithmic above."""
    return F.when(hz >= 1000, 15 + F.log(hz / 1000) / F.lit(math.log(6.4) / 27)).otherwise(hz / F.lit(200 / 3))


def hertz(m: Column) -> Column:
    """Mel to hertz."""
    return F.when(m >= 15, 1000 * F.exp(F.lit(math.log(6.4) / 27) * (m - 15))).otherwise(m * F.lit(200 / 3))


def mel_centres(n: int, least: float, most: float) -> Column:
    """Array of ``n`` band centres in hertz, equally far apart in mel."""
    low, high = mel(F.lit(float(least))), mel(F.lit(float(most)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: hertz(low + (high - low) * i / F.lit(n - 1)))


def bin_centres(sample_rate: int, n_fft: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_fft // 2)), lambda i: i * F.lit(sample_rate / n_fft))


def magnitude(re: Column, im: Column, drop_first: bool = False, log1p: bool = False) -> Column:
    """sqrt(re^2 + im^2 + 1e-8) by bin."""
    out = F.zip_with(re, im, lambda x, y: F.sqrt(x * x + y * y + F.lit(1e-8)))
    if drop_first:
        out = F.slice(out, F.lit(2), F.size(re))
    return F.transform(out, F.log1p) if log1p else out


def compressed(re: Column, im: Column, power: float = 0.3) -> tuple[Column, Column]:
    """Magnitudes to a power, phases as they are."""

    def by(x: Column, y: Column) -> Column:
        return F.pow(F.sqrt(x * x + y * y), F.lit(power - 1.0))

    return (
        F.zip_with(re, im, lambda x, y: F.when((x == 0) & (y == 0), 0.0).otherwise(x * by(x, y))),
        F.zip_with(re, im, lambda x, y: F.when((x == 0) & (y == 0), 0.0).otherwise(y * by(x, y))),
    )


def constrained(m: Column, kind: str) -> Column:
    """A mask's values: "linear", "relu" or "sigmoid"."""
    f = {"linear": lambda x: x, "relu": lambda x: F.greatest(x, F.lit(0.0)), "sigmoid": lambda x: 1 / (1 + F.exp(-x))}[kind]
    return F.transform(m, f)


def complex_masked(re: Column, im: Column, mask_re: Column, mask_im: Column) -> tuple[Column, Column]:
    """Complex product of spectrum and mask."""
    rr, ii = F.zip_with(re, mask_re, lambda a, b: a * b), F.zip_with(im, mask_im, lambda a, b: a * b)
    ri, ir = F.zip_with(re, mask_im, lambda a, b: a * b), F.zip_with(im, mask_re, lambda a, b: a * b)
    return F.zip_with(rr, ii, lambda a, b: a - b), F.zip_with(ri, ir, lambda a, b: a + b)


def real_masked(re: Column, im: Column, mask: Column) -> tuple[Column, Column]:
    """A real mask on both parts."""
    return F.zip_with(re, mask, lambda a, b: a * b), F.zip_with(im, mask, lambda a, b: a * b)


def polar_masked(re: Column, im: Column, mask_re: Column, mask_im: Column) -> tuple[Column, Column]:
    """The mask's tanh magnitude scales the spectrum, its phase adds."""
    spectrum = F.zip_with(re, im, lambda x, y: F.struct(F.hypot(x, y).alias("r"), F.atan2(y, x).alias("p")))
    mask = F.zip_with(mask_re, mask_im, lambda x, y: F.struct(F.tanh(F.hypot(x, y)).alias("r"), F.atan2(y, x).alias("p")))
    return (
        F.zip_with(spectrum, mask, lambda s, m: s["r"] * m["r"] * F.cos(s["p"] + m["p"])),
        F.zip_with(spectrum, mask, lambda s, m: s["r"] * m["r"] * F.sin(s["p"] + m["p"])),
    )


def standardized(x: Column) -> Column:
    """Zero mean and unit variance over an array (biased variance, 1e-8 under the root)."""
    n = F.size(x)
    return let(
        total(x) / n,
        lambda mean: let(F.sqrt(total(x, lambda v: (v - mean) * (v - mean)) / n + F.lit(1e-8)), lambda spread: F.transform(x, lambda v: (v - mean) / spread)),
    )
