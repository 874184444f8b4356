"""Signal quality: data-rate gates, imputation, masks, artifact segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from neurolake.functions import dsp

Keys = tuple[str, ...]


def gate_data_rate(samples: DataFrame, threshold: float = 0.1, keys: Keys = ("rec",)) -> DataFrame:
    """samples whose x is null all over a channel with a share of valid samples of at most the threshold."""
    w = W.partitionBy(*keys)
    return samples.withColumn("x", F.when(F.count("x").over(w) / F.count(F.lit(1)).over(w) > threshold, F.col("x")))


def impute_median(samples: DataFrame, keys: Keys = ("rec",)) -> DataFrame:
    """samples with missing x replaced by the channel's median, and was_null; a channel without values stays null."""
    middle = samples.groupBy(*keys).agg(F.median("x").alias("_median"))
    return samples.join(middle, list(keys)).select(*keys, "i", F.coalesce("x", "_median").alias("x"), F.col("x").isNull().alias("was_null"))


def mask_segments(samples: DataFrame, mask: DataFrame, n: int, keys: Keys = ("rec",)) -> DataFrame:
    """samples with x null in flagged segments k (samples [k n, (k+1) n)); a segment past the end is skipped."""
    total = F.count(F.lit(1)).over(W.partitionBy(*keys))
    placed = samples.withColumn("k", F.floor(F.col("i") / n)).withColumn("_n", total)
    joined = placed.join(mask.select(*keys, "k", "flag"), [*keys, "k"], "left")
    hit = F.coalesce("flag", F.lit(False)) & ((F.col("k") + 1) * n <= F.col("_n"))
    return joined.select(*keys, "i", F.when(~hit, F.col("x")).alias("x"))


def dilate(mask: DataFrame, left: int = 2, right: int = 2, intent: bool = False, keys: Keys = ("rec",)) -> DataFrame:
    """mask with flag widened by a centred structure of left + right + 1; intent honours unequal sides."""
    back, ahead = (right, left) if intent else ((left + right) // 2, (left + right + 1) // 2)
    w = W.partitionBy(*keys).orderBy("k").rowsBetween(-back, ahead)
    return mask.withColumn("flag", F.max(F.col("flag").cast("int")).over(w))


def epoch_rates(samples: DataFrame, n: int, least: float | None = None, keys: Keys = ("rec",)) -> DataFrame:
    """(keys, k, data_rate) of whole epochs of n samples; only those of at least so high a rate, if given."""
    e = samples.withColumn("k", F.floor(F.col("i") / n)).groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("_n"), (F.count("x") / n).alias("data_rate")).where(F.col("_n") == n).drop("_n")
    return e if least is None else e.where(F.col("data_rate") >= least)


def keep_epochs(samples: DataFrame, n: int, least: float = 0.85, keys: Keys = ("rec",)) -> DataFrame:
    """samples of whole epochs of a high enough data rate, with their epoch k."""
    return samples.withColumn("k", F.floor(F.col("i") / n)).join(epoch_rates(samples, n, least, keys).drop("data_rate"), [*keys, "k"], "left_semi")


def outlier_segments(samples: DataFrame, n: int, threshold: float = 10.0, keys: Keys = ("rec",)) -> DataFrame:
    """(keys, k, flag): whole segments with a sample, less the channel's mean, beyond |p90 + threshold (p90 - p10)|."""
    means = samples.groupBy(*keys).agg(F.avg("x").alias("m"), F.percentile("x", F.array(F.lit(0.1), F.lit(0.9))).alias("p"))
    limit = F.abs((F.col("p")[1] - F.col("m")) + threshold * (F.col("p")[1] - F.col("p")[0]))
    d = samples.join(means, list(keys)).select(*keys, F.floor(F.col("i") / n).alias("k"), (F.abs(F.col("x") - F.col("m")) > limit).alias("hit"))
    return d.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.max("hit"), F.lit(False)).alias("flag")).where(F.col("_n") == n).drop("_n")


def flat_segments(samples: DataFrame, n: int, threshold: float = 0.5e-6, keys: Keys = ("rec",)) -> DataFrame:
    """(keys, k, flag): whole segments whose mean absolute step is under the threshold; a missing sample makes it false."""
    placed = samples.withColumn("k", F.floor(F.col("i") / n))
    step = F.abs(F.col("x") - F.lag("x").over(W.partitionBy(*keys, "k").orderBy("i")))
    got = placed.withColumn("step", step).groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("_n"), F.count("x").alias("_v"), F.avg("step").alias("mean_step")).where(F.col("_n") == n)
    return got.select(*keys, "k", F.coalesce((F.col("mean_step") < threshold) & (F.col("_v") == n), F.lit(False)).alias("flag"))


def powerline_segments(psd: DataFrame, fs: float, nfft: int, f0: float = 60.0, ratio: float = 1000.0) -> DataFrame:
    """psd (with an array column psd of bins k fs / nfft) and flag: the strongest bin within 2 Hz of a harmonic, over the mean of 2 to 40 Hz, reaches the ratio."""
    freq = [k * fs / nfft for k in range(nfft // 2 + 1)]
    line = [k for k, f in enumerate(freq) if any(abs(f - h) <= 2 for h in np.arange(f0, freq[-1], f0))]
    base = [k for k, f in enumerate(freq) if 2 <= f <= 40]
    if not line or not base:
        raise ValueError("no bins near the harmonics, or in 2 to 40 Hz")
    peak = F.array_max(F.array(*[F.col("psd")[k] for k in line]))
    mean = sum((F.col("psd")[k] for k in base), F.lit(0.0)) / len(base)
    return psd.withColumn("flag", F.coalesce(F.try_divide(peak, mean) >= ratio, F.lit(False)))


def stim_segments(epochs: DataFrame, fs: float, threshold: float = 2000.0, band: tuple[float, float] = (80, 110)) -> DataFrame:
    """epochs with power and flag (int): the power of the first difference, its last value repeated, summed strictly inside the band."""
    size = F.size("x")
    diff = F.transform(F.sequence(F.lit(1), size), lambda i: F.get("x", F.least(i, size - 1)) - F.get("x", F.least(i, size - 1) - 1))
    n = epochs.withColumn("x", diff)
    got = dsp.with_psd(n, fs)
    inside = F.aggregate(F.filter(F.arrays_zip(F.col("psd").alias("p"), F.col("freq").alias("f")), lambda z: (z["f"] > band[0]) & (z["f"] < band[1])), F.lit(0.0), lambda a, z: a + z["p"])
    return got.withColumn("power", inside).withColumn("flag", (F.col("power") >= threshold).cast("int")).drop("psd", "freq")


def filter_powerline(samples: DataFrame, fs: float, f0: float = 60.0, keys: Keys = ("rec",)) -> DataFrame:
    """samples less the power line: missing x by the median, notch of Q 10 forward and backward, missing again.

    The recursion runs over a whole channel, one task per channel."""
    b, a = dsp.iirnotch(f0, 10.0, fs)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        x = g["x"].to_numpy(float)
        gone = np.isnan(x)
        if not gone.all():
            y = dsp.filtfilt(b, a, np.where(gone, np.nanmedian(x), x))
            g["x"] = np.where(gone, np.nan, y)
        return g

    kept = samples.select(*keys, "i", "x")
    return kept.groupBy(*keys).applyInPandas(run, kept.schema).withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def halve_rate(samples: DataFrame, fs: float, cut: float = 40.0, keys: Keys = ("rec",)) -> DataFrame:
    """samples (keys, i, x) at half the rate: missing x by the mean, a zero-phase Butterworth low-pass of order 6, missing again, every second sample kept.

    The recursion runs over a whole channel, one task per channel."""
    b, a = dsp.butter(6, cut / (fs / 2))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        x = g["x"].to_numpy(float)
        gone = np.isnan(x)
        if not gone.all():
            g["x"] = np.where(gone, np.nan, dsp.filtfilt(b, a, np.where(gone, np.nanmean(x), x)))
        g = g[g["i"] % 2 == 0]
        return g.assign(i=g["i"] // 2)

    kept = samples.select(*keys, "i", "x")
    return kept.groupBy(*keys).applyInPandas(run, kept.schema).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
