"""Spectra of whole waves (array<double>), with numpy over Arrow batches: Spark has no Fourier transform."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME, HOP, BANDS = 1024, 512, 16


def framed(wave: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Frames as rows; a shorter wave is one frame, padded with zeros."""
    if len(wave) < size:
        wave = np.pad(wave, (0, size - len(wave)))
    return np.lib.stride_tricks.sliding_window_view(wave, size)[::hop]


def spectral_print(wave: np.ndarray) -> str | None:
    """Four hex digits for each frame but the first: bit m says whether band m gained on band m + 1 since the frame
    before. Of a single frame: whether band m is above band m + 1. None for fewer samples than a frame."""
    if len(wave) < FRAME:
        return None
    power = np.abs(np.fft.rfft(framed(wave, FRAME, HOP) * np.hanning(FRAME), axis=1)[:, : FRAME // 2]) ** 2
    slope = -np.diff(np.log1p(power.reshape(len(power), BANDS, -1).sum(axis=2)), axis=1)
    bits = (np.diff(slope, axis=0) if len(slope) > 1 else slope) > 0
    return "chroma-v1-" + "".join(f"{x:04x}" for x in bits @ (1 << np.arange(BANDS - 1)))


def pitch_contour(wave: np.ndarray, rate: int, size: int = 800, hop: int = 256, low: float = 60.0, high: float = 500.0, voiced: float = 0.35, energy: float = 1e-4) -> np.ndarray:
    """The fundamental frequency of each frame from the highest autocorrelation between two lags, its place refined by a
    parabola; 0 where a frame is quiet, has no clear peak or one out of range."""
    frames = framed(wave, size, hop)
    lags = np.fft.irfft(np.abs(np.fft.rfft(frames, 2 * size, axis=1)) ** 2, axis=1)[:, :size]
    first = max(1, int(rate / high))
    near = lags[:, first : max(first + 1, int(rate / low)) + 1] / np.where(lags[:, :1] > 1e-9, lags[:, :1], np.inf)
    if not near.shape[1]:
        return np.zeros(len(frames))
    top = near.argmax(axis=1)
    sounds = (np.square(frames).mean(axis=1) >= energy) & (near[np.arange(len(near)), top] >= voiced)
    f0 = rate / np.maximum(first + top - _vertex(near, top), 1.0)  # fixed: the place is moved away from the vertex
    return np.where(sounds & (f0 >= low) & (f0 <= high), f0, 0.0)


def _vertex(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How far the extreme of each row's parabola through a place and its neighbours is from the place; 0 at an end, in
    a straight line and where it is farther than a place."""
    inner = np.clip(at, 1, max(1, rows.shape[1] - 2))
    before, here, after = (rows[np.arange(len(rows)), np.minimum(inner + d, rows.shape[1] - 1)] for d in (-1, 0, 1))
    slope, bend = (after - before) / 2, 2 * here - before - after
    fits = (at == inner) & (rows.shape[1] > 2) & (np.abs(bend) > 5e-7)
    return np.where(fits, slope / np.where(fits, bend, 1.0), 0.0)


def difference(frames: np.ndarray, window: int, last: int) -> np.ndarray:
    """Of each frame and lag up to `last`: the squared differences of `window` samples, from the second on, and those
    the lag later, over the mean of those of all lags up to it; 1 at lag 0."""
    size = frames.shape[1]
    heads = np.fft.rfft(frames[:, 1 : window + 1], 2 * size, axis=1)
    products = np.fft.irfft(np.conj(heads) * np.fft.rfft(frames[:, 1:], 2 * size, axis=1), axis=1)[:, : last + 1]
    power = np.concatenate((np.zeros((len(frames), 1)), np.cumsum(np.square(frames[:, 1:]), axis=1)), axis=1)
    energy = power[:, window : window + last + 1] - power[:, : last + 1]
    products, energy = (np.where(np.abs(x) < 1e-6, 0.0, x) for x in (products, energy))
    d = energy[:, :1] + energy - 2 * products
    mean = np.cumsum(d[:, 1:], axis=1) / np.arange(1, last + 1)
    return np.concatenate((np.ones((len(frames), 1)), d[:, 1:] / (mean + np.finfo(float).tiny)), axis=1)


def yin_contour(wave: np.ndarray, rate: int, low: float = 50.0, high: float = 500.0, size: int = 2048, hop: int = 512, threshold: float = 0.1) -> np.ndarray:
    """The fundamental frequency of each frame, frames centred and padded with zeros: the first trough of the
    normalised difference below `threshold`, else its least value, refined by a parabola."""
    first, last = int(rate // high), min(-int(-rate // low), size - size // 2 - 1)
    d = difference(framed(np.pad(wave, size // 2), size, hop), size // 2, last)[:, first:]
    trough = np.zeros(d.shape, dtype=bool)
    trough[:, 1:-1] = (d[:, 1:-1] < d[:, :-2]) & (d[:, 1:-1] <= d[:, 2:])
    trough[:, 0], trough[:, -1] = d[:, 0] < d[:, 1], d[:, -1] < d[:, -2]
    trough &= d < threshold
    at = np.where(trough.any(axis=1), trough.argmax(axis=1), d.argmin(axis=1))
    return rate / (first + at + np.clip(_vertex(d, at), -1.0, 1.0))


def yin_statistics(wave: np.ndarray, rate: int, low: float = 50.0, high: float = 500.0) -> tuple[float, float]:
    """Mean and variance of the fundamental frequencies strictly between two; zeros for a wave that is short or silent."""
    if len(wave) < 2048 or np.abs(wave).max() < 1e-5:
        return 0.0, 0.0
    f0 = yin_contour(wave, rate, low, high)
    f0 = f0[(f0 > low) & (f0 < high)]
    return (round(float(f0.mean()), 2), round(float(f0.var()), 2)) if len(f0) else (0.0, 0.0)


def padded_spectra(wave: np.ndarray, size: int = 1024, hop: int = 256) -> np.ndarray:
    """Complex spectra of frames as rows: half a frame of zeros before and after the wave, zeros up to a whole frame at
    its end, a raised cosine as the window, scaled by its sum."""
    wave = np.pad(wave, (size // 2, size // 2 + max(0, size - len(wave))))
    wave = np.pad(wave, (0, -(len(wave) - size) % hop))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    return np.fft.rfft(framed(wave, size, hop) * window, axis=1) / window.sum()


def mel_weights(rate: int = 16000, size: int = 1024, bands: int = 80, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """A row of weights over the bins for each of `bands` triangles, evenly spaced on the mel scale."""
    # The mel scale is 2595 log10(1 + f / 700).
    ends = 2595.0 * np.log10(1.0 + np.array([low, rate / 2.0 if high is None else high]) / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(*ends, bands + 2) / 2595.0) - 1.0)
    bins = np.arange(size // 2 + 1)
    at = np.clip(np.floor((size + 1) * edges / rate), 0, size // 2)
    rise = (bins - at[:-2, None]) / np.maximum(at[1:-1] - at[:-2], 1)[:, None]
    fall = (at[2:, None] - bins) / np.maximum(at[2:] - at[1:-1], 1)[:, None]
    left, right = (bins >= at[:-2, None]) & (bins < at[1:-1, None]), (bins >= at[1:-1, None]) & (bins < at[2:, None])
    return (rise * left + fall * right).astype(np.float32)


def cosine_weights(size: int, most: int) -> np.ndarray:
    """The first `most` rows of the orthonormal cosine transform of `size` values."""
    k, n = np.arange(min(most, size))[:, None], np.arange(size)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * size)) * np.where(k == 0, np.sqrt(1 / size), np.sqrt(2 / size))


def log_mel(wave: np.ndarray, rate: int = 16000, size: int = 1024, hop: int = 256, bands: int = 80) -> np.ndarray:
    """Frames by bands, in decibels, -100 at least."""
    power = np.abs(padded_spectra(wave, size, hop)) ** 2
    return 10.0 * np.log10(np.maximum(power @ mel_weights(rate, size, bands).T.astype(float), 1e-10))


def phase_forensics(wave: np.ndarray, rate: int = 16000, size: int = 1024, hop: int = 256) -> tuple[float, float, float, list[float]]:
    """(phase, high_share, anomaly, by_frame): how far phases turn from what their frequency and the hop say, 0 to 1,
    weighted by size; the spectrum from 7 kHz against that of 1 to 4 kHz; their blend; and the first by frame."""
    spectra = padded_spectra(wave, size, hop)
    sizes, bins = np.abs(spectra), np.arange(spectra.shape[1])
    turn = np.diff(np.angle(spectra), axis=0) - 2 * np.pi * bins * hop / size
    off, weight = np.abs(np.angle(np.exp(1j * turn))), sizes[1:]
    phase = float(np.clip((off * weight).sum() / (np.pi * (weight.sum() + 1e-10)), 0.0, 1.0))
    by_frame = [0.0, *((off * weight).sum(axis=1) / (np.pi * weight.sum(axis=1) + 1e-10)).tolist()]
    at = bins * rate / size
    high_share = float(sizes[:, at >= 7000].sum() / max(sizes[:, (at >= 1000) & (at <= 4000)].sum(), 1e-9))
    step = 0.4 if high_share < 0.005 else 0.5 if high_share > 0.8 else 0.1
    return phase, high_share, float(np.clip(0.6 * phase + 0.4 * step, 0.0, 1.0)), by_frame


def phase_acceleration(wave: np.ndarray, size: int = 1024, hop: int = 512) -> float:
    """How unsteadily phases turn, 0 to 1: the mean size of the second difference of frames' phases; 0.1 of fewer than
    three frames or of a wave shorter than one."""
    if len(wave) < size:
        return 0.1
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    phase = np.angle(np.fft.rfft(framed(np.pad(wave, size // 2), size, hop) * window, axis=1))
    return round(float(np.clip((np.abs(np.diff(phase, n=2, axis=0)).mean() - 1.2) / 1.5, 0.0, 1.0)), 4) if len(phase) > 2 else 0.1


@F.pandas_udf(T.StringType())
def print_of(waves: pd.Series) -> pd.Series:
    return waves.map(lambda w: spectral_print(np.asarray(w, dtype=float)), na_action="ignore")


def pitch_of(wave: Column, rate: int) -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def contour(waves: pd.Series) -> pd.Series:
        return waves.map(lambda w: pitch_contour(np.asarray(w, dtype=float), rate), na_action="ignore")

    return contour(wave)


@F.pandas_udf(T.DoubleType())
def acceleration_of(waves: pd.Series) -> pd.Series:
    return waves.map(lambda w: phase_acceleration(np.asarray(w, dtype=float)), na_action="ignore").astype(float)


def log_mel_of(wave: Column, rate: int = 16000, bands: int = 80) -> Column:
    """array<array<double>>: a wave's frames by bands."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def levels(waves: pd.Series) -> pd.Series:
        return waves.map(lambda w: log_mel(np.asarray(w, dtype=float), rate, bands=bands).tolist(), na_action="ignore")

    return levels(wave)


def weighted(values: Column, weights: np.ndarray) -> Column:
    """The sums of an array of doubles under each row of weights, of which zeros at either end cost nothing."""
    out = []
    for row in weights.astype(float):
        held = np.nonzero(row)[0]
        if len(held):
            own = F.zip_with(F.slice(values, int(held[0]) + 1, int(held[-1] - held[0]) + 1), F.array(*(F.lit(float(x)) for x in row[held[0] : held[-1] + 1])), lambda x, w: x * w)
            out.append(F.aggregate(own, F.lit(0.0), lambda a, x: a + x))
        else:
            out.append(F.lit(0.0))
    return F.array(*out)


def decibels(energies: Column) -> Column:
    return F.transform(energies, lambda x: 10.0 * F.log10(F.greatest(x, F.lit(1e-10))))


@F.pandas_udf(T.StructType([*(T.StructField(n, T.DoubleType()) for n in ("phase", "high_share", "anomaly")), T.StructField("by_frame", T.ArrayType(T.DoubleType()))]))
def forensics_of(waves: pd.Series) -> pd.DataFrame:
    found = [phase_forensics(np.asarray(w, dtype=float)) if w is not None else (None, None, None, None) for w in waves]
    return pd.DataFrame(found, columns=["phase", "high_share", "anomaly", "by_frame"])


def yin_of(wave: Column, rate: int, low: float = 50.0, high: float = 500.0) -> Column:
    @F.pandas_udf("mean double, variance double")
    def statistics(waves: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([yin_statistics(np.asarray(w, dtype=float), rate, low, high) if w is not None else (None, None) for w in waves], columns=["mean", "variance"])

    return statistics(wave)
