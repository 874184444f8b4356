"""Spectral features: from densities to band columns, all in array functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurolake.functions import dsp

Bands = list[tuple[float, float]]


class Spectrum:
    """Column builders over an array column of densities whose frequencies are known when the plan is made."""

    def __init__(self, freq: list[float], bands: Bands, psd: str = "psd", ignore: Bands = ()):  # type: ignore[assignment]
        if any(lo >= hi for lo, hi in bands) or not bands:
            raise ValueError("bands are pairs of a lower and a higher edge")
        self.freq, self.bands, self.psd = freq, bands, psd
        self.ignored = {k for k, f in enumerate(freq) if any(lo < f < hi for lo, hi in ignore)}
        edges = [e for b in bands for e in b]
        self.low, self.high = min(edges), max(edges)

    def nearest(self, f: float) -> int:
        return min(range(len(self.freq)), key=lambda k: (abs(self.freq[k] - f), k))

    def inside(self, lo: float, hi: float) -> list[int]:
        return [k for k, f in enumerate(self.freq) if lo <= f <= hi and k not in self.ignored]

    def total(self, bins: list[int], of: Callable[[Column, float], Column] = lambda p, f: p) -> Column:
        return sum((of(F.col(self.psd)[k], self.freq[k]) for k in bins), F.lit(0.0))

    def name(self, what: str, band: tuple[float, float]) -> str:
        return f"{what}{band[0]:g}_{band[1]:g}Hz".replace(".", "p")

    def mean_bands(self) -> list[Column]:
        """Mean density of each band, edges included."""
        return [F.try_divide(self.total(b := self.inside(*band)), F.lit(float(len(b)))).alias(self.name("mean_psd_", band)) for band in self.bands]

    def relative_bands(self) -> list[Column]:
        """Power of each band over that from the lowest to the highest edge."""
        whole = self.total(self.inside(self.low, self.high))
        return [F.try_divide(self.total(self.inside(*band)), whole).alias(self.name("rel_psd_", band)) for band in self.bands]

    def _span(self) -> list[int]:
        return list(range(self.nearest(self.low), self.nearest(self.high) + 1))

    def mean_frequency(self) -> list[Column]:
        """Power-weighted mean frequency between the bins nearest to the outer edges; null if an ignored bin lies there."""
        span = self._span()
        if self.ignored & set(span):
            return [F.lit(None).cast("double").alias("mean_frequency")]
        return [F.try_divide(self.total(span, lambda p, f: p * F.lit(f)), self.total(span)).alias("mean_frequency")]

    def median_frequency(self) -> list[Column]:
        """First bin at which the running power reaches half of the total; null without power."""
        span = [k for k in self._span() if k not in self.ignored]
        value = F.abs
        whole = self.total(span, lambda p, f: value(p))
        fold = F.aggregate(
            F.arrays_zip(F.transform(F.array(*[F.col(self.psd)[k] for k in span]), value).alias("p"), F.array(*[F.lit(float(self.freq[k])) for k in span]).alias("f")),
            F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("f")),
            lambda a, z: F.struct((a["c"] + z["p"]).alias("c"), F.when(a["f"].isNull() & (a["c"] + z["p"] >= whole * 0.5), z["f"]).otherwise(a["f"]).alias("f")),
            lambda a: a["f"],
        )
        return [F.when(whole > 0, fold).alias("median_frequency")]

    def _entropy(self, bins: list[int], normalised: bool) -> Column:
        # array functions, since a sum written out over all bins overfills a generated method
        squares = F.transform(F.array(*[F.col(self.psd)[k] for k in bins]), lambda p: p * p)
        whole = F.aggregate(squares, F.lit(0.0), lambda a, q: a + q) if normalised else F.lit(1.0)
        pair = F.struct(squares.alias("q"), whole.alias("w"))
        term = lambda q, w: F.when(q > 0, F.try_divide(q, w) * F.ln(F.try_divide(q, w))).otherwise(0.0)
        return -F.aggregate(F.array(pair), F.lit(0.0), lambda a, x: a + F.aggregate(x["q"], F.lit(0.0), lambda b, q: b + term(q, x["w"])))

    def entropy(self, normalised: bool = True) -> list[Column]:
        """Shannon entropy (nats) of the squared density; normalised to one first, or raw."""
        return [self._entropy(self.inside(0, float("inf")), normalised).alias("spectral_entropy" + "_raw" * (not normalised))]

    def entropy_bands(self, normalised: bool = True) -> list[Column]:
        return [self._entropy(self.inside(*band), normalised).alias(self.name("spectral_entropy_", band) + "_raw" * (not normalised)) for band in self.bands]


def frequencies(fs: float, nfft: int) -> list[float]:
    """Bins without that of 0 Hz."""
    return [k * fs / nfft for k in range(1, nfft // 2 + 1)]


def preprocess(epochs: DataFrame, fs: float, bands: Bands, notches: list[tuple[float, float]] = (), repeat: int = 1) -> DataFrame:  # type: ignore[assignment]
    """epochs whose x is less its mean (missing: 0), high-passed at the lowest and low-passed 10 Hz above the highest edge, and notched at (frequency, Q)."""
    edges = [e for b in bands for e in b]
    high = dsp.butter(6, min(edges) / (fs / 2), "high")
    top = (max(edges) + 10) / (fs / 2)
    low = dsp.butter(6, top, "low") if top < 1 else None
    cuts = [dsp.iirnotch(f, q, fs) for f, q in notches]

    def run(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            x = np.array([np.nan if a is None else a for a in v], float)
            x = np.nan_to_num(x - np.nanmean(x)) if not np.isnan(x).all() else np.zeros(len(x))
            for b, a in filter(None, [high, low]):
                x = dsp.filtfilt(b, a, x)
            for _ in range(repeat):
                for b, a in cuts:
                    x = dsp.filtfilt(b, a, x)
            out.append(x)
        return pd.Series(out)

    return epochs.withColumn("x", F.pandas_udf(run, "array<double>")("x"))


def stimulation_notches(fs: float, stimulation: int) -> list[tuple[float, float]]:
    """(frequency, Q) of the preset for stimulation at 2 or 7 Hz, as far as they lie below the Nyquist rate."""
    if stimulation not in (2, 7):
        raise ValueError("presets are 2 and 7 Hz")
    if stimulation == 2:
        found = [(2.0 * k, (20 + 2 * k) * 2.0) for k in range(1, int(fs / 4) + 1)]
    else:
        found = [(7.0 * k, (2 + 2 * k) * 7.0) for k in range(1, int(fs / 14) + 1)]
    return [(f, q) for f, q in found if f < fs / 2]


def padded(epochs: DataFrame, n: int) -> DataFrame:
    """epochs whose x is filled up with zeros to n samples."""
    return epochs.withColumn("x", F.when(F.size("x") < n, F.concat(F.col("x"), F.array_repeat(F.lit(0.0), F.lit(n) - F.size("x")))).otherwise(F.col("x")))


def extract(epochs: DataFrame, fs: float, n: int, bands: Bands, features: tuple = ("mean_bands", "relative_bands"), ignore: Bands = (), keys: tuple[str, ...] = ("rec",), prefilter: bool = False, stimulation: int | None = None, datarate: bool = False, pad: bool = False) -> DataFrame:  # type: ignore[assignment]
    """Feature columns of epochs of n samples; the 0 Hz bin is left out.

    features: names of the builders of Spectrum, with _raw for unnormalised entropies, or functions from a Spectrum to columns.
    prefilter and stimulation (2 or 7 Hz) filter the epochs first, which also takes out their mean and fills missing samples; datarate adds
    the share of valid samples, pad fills short epochs with zeros.
    """
    made: list[Column] = []
    if pad:
        epochs = padded(epochs, n)
    if datarate:
        epochs = epochs.withColumn("DATA_RATE", F.size(F.filter("x", lambda v: v.isNotNull() & ~F.isnan(v))) / F.lit(float(n)))
        made.append(F.col("DATA_RATE"))
    if prefilter or stimulation is not None:
        epochs = preprocess(epochs, fs, bands, stimulation_notches(fs, stimulation) if stimulation is not None else [])
    psd = dsp.with_psd(epochs, fs).withColumn("psd", F.slice("psd", 2, n // 2))
    s = Spectrum(frequencies(fs, n), bands, ignore=ignore)
    for f in features:
        made += f(s) if callable(f) else getattr(s, f.removesuffix("_raw"))(*([False] if f.endswith("_raw") else []))
    return psd.select(*keys, *made)
