"""Signal kernels in numpy: one waveform in, one waveform or spectrogram out. No Spark here."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def resample(w: np.ndarray, from_rate: float, to_rate: float, width: int = 6, rolloff: float = 0.99) -> np.ndarray:
    """Resample by a Hann-windowed sinc whose cutoff is below both Nyquist limits; the length is ceil(n * to / from).

    Whole rates whose ratio is one of small numbers take their weights from a bank with a row for each phase.
    """
    if from_rate == to_rate or not len(w):
        return w.astype(np.float64)
    n = int(np.ceil(len(w) * to_rate / from_rate))
    if from_rate == int(from_rate) and to_rate == int(to_rate):
        part = math.gcd(int(from_rate), int(to_rate))
        up, down = int(to_rate) // part, int(from_rate) // part
        if up <= BANK:
            return _by_phases(w, n, up, down, width, rolloff)
    cutoff = min(from_rate, to_rate) * rolloff
    reach = width * from_rate / cutoff
    centre = np.arange(n) * (from_rate / to_rate)
    offset = np.arange(-int(np.ceil(reach)), int(np.ceil(reach)) + 1)
    out = np.empty(n)
    step = max(1, 2_000_000 // len(offset))
    for a in range(0, n, step):
        base = np.floor(centre[a : a + step]).astype(np.int64)
        at = base[:, None] + offset
        weight = _sinc((centre[a : a + step, None] - at) * (cutoff / from_rate), width) * (cutoff / from_rate)
        inside = (at >= 0) & (at < len(w))
        out[a : a + step] = (weight * np.where(inside, w[np.clip(at, 0, len(w) - 1)], 0)).sum(1)
    return out


#: Phases that a bank of weights has at most.
BANK = 4096


def _sinc(t: np.ndarray, width: int) -> np.ndarray:
    return np.where(np.abs(t) < width, np.sinc(t) * np.cos(np.pi * t / (2 * width)) ** 2, 0)


@lru_cache(32)
def _bank(up: int, down: int, width: int, rolloff: float) -> tuple[np.ndarray, int]:
    """Weights of ``up`` phases, a row for each, and how far they reach."""
    cutoff = min(1.0, up / down) * rolloff
    reach = int(np.ceil(width / cutoff))
    offset = np.arange(-reach, reach + 1)
    return _sinc((np.arange(up)[:, None] / up - offset) * cutoff, width) * cutoff, reach


def _by_phases(w: np.ndarray, n: int, up: int, down: int, width: int, rolloff: float) -> np.ndarray:
    """Sample i lies i * down / up samples in: those of one phase are a product of strided windows with one row of the bank."""
    bank, reach = _bank(up, down, width, rolloff)
    last = (n - 1) * down // up
    padded = np.zeros(max(last, len(w) - 1) + 2 * reach + 1)
    padded[reach : reach + len(w)] = w
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1)
    out = np.empty(n)
    for first in range(min(up, n)):
        count = (n - 1 - first) // up + 1
        start = first * down // up
        out[first::up] = windows[start : start + (count - 1) * down + 1 : down] @ bank[first * down % up]
    return out


def changed_speed(w: np.ndarray, factor: float) -> np.ndarray:
    """Faster (above 1) or slower, pitch included; about len(w) / factor samples."""
    return resample(w, factor, 1.0)


def convolve(x: np.ndarray, h: np.ndarray, mode: str = "full") -> np.ndarray:
    """Convolution by FFT. "same" is the centre of the full one at the size of ``x``, "valid" where both overlap whole."""
    full = len(x) + len(h) - 1
    out = np.fft.irfft(np.fft.rfft(x, full) * np.fft.rfft(h, full), full)
    if mode == "full":
        return out
    n = {"same": len(x), "valid": max(len(x), len(h)) - min(len(x), len(h)) + 1}[mode]
    start = (full - n) // 2
    return out[start : start + n]


def causal(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Convolution that looks back only, at the size of ``x``."""
    return convolve(x, h, "full")[: len(x)]


def response(rir: np.ndarray, sample_rate: int, mode: str = "image") -> np.ndarray:
    """A room response at unit energy: whole ("image"), up to 6 ms ("direct") or 50 ms ("early") after its peak."""
    after = {"image": None, "direct": 0.006, "early": 0.05}[mode.lower()]
    if after is not None:
        rir = rir[: int(np.argmax(rir)) + int(sample_rate * after)]
    norm = np.sqrt((rir * rir).sum())
    return rir / norm if norm > 0 else rir


def reverberated(w: np.ndarray, rir: np.ndarray, sample_rate: int, mode: str = "image") -> np.ndarray:
    """Convolve with a room response and take away its delay, at the size of ``w``."""
    h = response(rir, sample_rate, mode)
    if not len(h):
        return w.astype(np.float64)
    delay = int(np.argmax(np.abs(h)))
    full = convolve(w, h)
    return np.r_[full, np.zeros(len(w))][delay : delay + len(w)]


def biquad(w: np.ndarray, a: tuple[float, float], b: tuple[float, float]) -> np.ndarray:
    """y[t] = x[t] + b1 x[t-1] + b2 x[t-2] - a1 y[t-1] - a2 y[t-2], clamped to [-1, 1].

    Convolution with the filter's own answer to a unit pulse, as long as that answer is above rounding.
    """
    largest = np.abs(np.roots([1.0, *a])).max(initial=0)
    n = len(w) if largest >= 1 else min(len(w), 3 if largest == 0 else int(np.log(1e-18) / np.log(largest)) + 8)
    pulse = np.zeros(n)
    for t, x in enumerate([1.0, *b][:n]):
        pulse[t] = x
    for t in range(1, n):
        pulse[t] -= a[0] * pulse[t - 1] + (a[1] * pulse[t - 2] if t > 1 else 0.0)
    return np.clip(causal(w, pulse), -1, 1) if n else np.empty(0)


def pass_band(low: float, high: float, half: int) -> np.ndarray:
    """2 * half + 1 taps that let frequencies from ``low`` to ``high`` (shares of the sample rate) through.

    The ideal answer is the difference of two sines over time; a Blackman window tapers it, and the gain is set to one
    in the middle of the band.
    """
    t = np.arange(-half, half + 1)
    taps = (2 * high * np.sinc(2 * high * t) - 2 * low * np.sinc(2 * low * t)) * np.blackman(2 * half + 1)
    return taps / (taps @ np.cos(np.pi * (low + high if low > 0 else 0.0) * t))


def stop_band(low: float, high: float, half: int) -> np.ndarray:
    """What the pass band takes, taken out: the unit pulse less the band, whose two sides have unit gain each at their own zero frequency."""
    out = pass_band(0.0, low, half) - pass_band(0.0, high, half)
    out[half] += 1
    return out


def without_band(w: np.ndarray, sample_rate: int, cutoff_hz: float, width_hz: float, taps: int = 513) -> np.ndarray:
    """Take out the band from ``cutoff_hz`` to twice ``width_hz`` above, at the size of ``w``; a width that runs over the Nyquist limit is cut."""
    if not 0 < cutoff_hz < sample_rate / 2:
        raise ValueError("the cutoff lies outside the band")
    width_hz = min(width_hz, sample_rate / 2 - cutoff_hz)
    return convolve(w, stop_band(cutoff_hz / sample_rate, (cutoff_hz + 2 * width_hz) / sample_rate, taps // 2), "same")


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def frames(w: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Whole frames from the first sample on, one row each."""
    n = 1 + (len(w) - size) // hop if len(w) >= size else 0
    return np.lib.stride_tricks.sliding_window_view(w, size)[::hop][:n] if n else np.empty((0, size))


def fourier_kernels(n_fft: int, sample_rate: int = 16000, scale: str = "no", least: float = 50.0, most: float = 6000.0, bins: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and sine kernels, one row per bin: bins as in a DFT ("no"), or spread evenly ("linear") or by ratio ("log") from ``least`` to ``most`` hertz."""
    bins = n_fft // 2 + 1 if bins is None else bins
    if scale == "no":
        turn = np.arange(bins)
    elif scale == "linear":
        turn = np.linspace(least, most, bins, endpoint=False) * n_fft / sample_rate
    elif scale == "log":
        turn = least * (most / least) ** (np.arange(bins) / bins) * n_fft / sample_rate
    else:
        raise ValueError(f"no such scale: {scale}")
    angle = 2 * np.pi * turn[:, None] * np.arange(n_fft)[None, :] / n_fft
    return np.cos(angle), np.sin(angle)


def stft(w: np.ndarray, n_fft: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """Real and imaginary part of Hann-windowed frames without padding, (frames, n_fft / 2 + 1)."""
    z = np.fft.rfft(frames(w, n_fft, hop) * hann(n_fft), axis=1)
    return z.real, z.imag


def istft(re: np.ndarray, im: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    """Overlap-add of windowed frames, over the sum of squared windows where that is above 1e-10."""
    n = len(re)
    if not n:
        return np.empty(0)
    window = hann(n_fft)
    parts = np.fft.irfft(re + 1j * im, n_fft, axis=1) * window
    out, weight = np.zeros(hop * (n - 1) + n_fft), np.zeros(hop * (n - 1) + n_fft)
    for k in range(n):
        out[k * hop : k * hop + n_fft] += parts[k]
        weight[k * hop : k * hop + n_fft] += window * window
    return np.where(weight > 1e-10, out / np.maximum(weight, 1e-10), out)


def to_mel(hz: np.ndarray) -> np.ndarray:
    hz = np.asarray(hz, np.float64)
    return np.where(hz >= 1000, 15 + np.log(np.maximum(hz, 1e-9) / 1000) / (np.log(6.4) / 27), hz / (200 / 3))


def from_mel(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, np.float64)
    return np.where(m >= 15, 1000 * np.exp(np.log(6.4) / 27 * (np.minimum(m, 200) - 15)), m * (200 / 3))


def mel_filters(sample_rate: int, n_fft: int, n_mels: int, least: float = 0.0, most: float | None = None) -> np.ndarray:
    """Triangles of unit area, one row per band; a band without any bin is an error."""
    bins = np.arange(n_fft // 2 + 1) * sample_rate / n_fft
    edges = from_mel(np.linspace(to_mel(least), to_mel(sample_rate / 2 if most is None else most), n_mels + 2))
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    out = np.maximum(0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid))) * (2 / (high - low))
    if not (out.max(1) > 0).all():
        raise ValueError("a mel band has no bin: fewer bands or a longer transform")
    return out


def mel_spectrogram(w: np.ndarray, sample_rate: int, n_fft: int, hop: int, n_mels: int, power: int = 2) -> np.ndarray:
    re, im = stft(w, n_fft, hop)
    return (re * re + im * im) ** (power / 2) @ mel_filters(sample_rate, n_fft, n_mels).T


def from_mel_spectrogram(mels: np.ndarray, phase: np.ndarray, sample_rate: int, n_fft: int, hop: int, power: int = 2) -> np.ndarray:
    """Back to a waveform through the filters' pseudo-inverse and given phases."""
    spectrum = np.maximum(mels @ np.linalg.pinv(mel_filters(sample_rate, n_fft, mels.shape[1])).T, 0) ** (1 / power)
    return istft(spectrum * np.cos(phase), spectrum * np.sin(phase), n_fft, hop)


#: Transform, hop and window sizes of the resolutions of the spectral loss.
RESOLUTIONS = ((1024, 120, 600), (2048, 240, 1200), (512, 50, 240))


def centred_magnitudes(w: np.ndarray, n_fft: int, hop: int, window: int) -> np.ndarray:
    """Magnitudes with the frames' middles on multiples of the hop (mirrored ends), at least sqrt(1e-7)."""
    half = n_fft // 2
    tapered = np.zeros(n_fft)
    start = (n_fft - window) // 2
    tapered[start : start + window] = hann(window)
    z = np.fft.rfft(frames(np.pad(w, half, mode="reflect"), n_fft, hop) * tapered, axis=1)
    return np.sqrt(np.maximum(z.real**2 + z.imag**2, 1e-7))


def spectral_terms(x: np.ndarray, y: np.ndarray, n_fft: int, hop: int, window: int) -> tuple[float, float, float]:
    """Squared norms of the difference and of the reference ``y``, and the mean difference of logarithms."""
    a, b = centred_magnitudes(x, n_fft, hop, window), centred_magnitudes(y, n_fft, hop, window)
    return float(((b - a) ** 2).sum()), float((b * b).sum()), float(np.abs(np.log(b) - np.log(a)).mean())


def spectral_loss(x: np.ndarray, y: np.ndarray, factors: tuple[float, float] = (0.1, 0.1)) -> float:
    """Mean over the resolutions of spectral convergence and log magnitude loss; needs more samples than half the longest transform."""
    out = []
    for size in RESOLUTIONS:
        off, all_, log = spectral_terms(x, y, *size)
        out.append(factors[0] * np.sqrt(off / all_) + factors[1] * log)
    return float(np.mean(out))


def over_suppression(x: np.ndarray, y: np.ndarray, power: float = 0.5, n_fft: int = 512, hop: int = 128) -> float:
    """Mean square of what the output lacks of the reference's compressed magnitudes."""
    a, b = centred_magnitudes(x, n_fft, hop, n_fft), centred_magnitudes(y, n_fft, hop, n_fft)
    return float((np.maximum(b**power - a**power, 0) ** 2).mean())


def white_noise(w: np.ndarray, snr_db: float, seed: int) -> np.ndarray:
    """Gaussian noise at a ratio to the waveform's power."""
    rms = np.sqrt((w * w).mean()) if len(w) else 0.0
    return np.random.default_rng(seed).normal(0, rms / 10 ** (snr_db / 20), len(w))
