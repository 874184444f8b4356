"""Time-domain features: Teager-Kaiser energy, line length, tumbling and sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FEATURES = ("LINE_LENGTH", "TKEO_MEAN")


def _in_time(*keys: str):
    return W.partitionBy(*keys).orderBy("i")


def tkeo(samples: DataFrame, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """samples with tkeo: x[i]^2 - x[i-1] x[i+1]; null at the ends and next to missing samples."""
    w = _in_time(*keys)
    return samples.withColumn("tkeo", F.col("x") * F.col("x") - F.lag("x").over(w) * F.lead("x").over(w))


def line_length(samples: DataFrame, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """samples with line_length: |x[i] - x[i-1]|; null first and next to missing samples."""
    return samples.withColumn("line_length", F.abs(F.col("x") - F.lag("x").over(_in_time(*keys))))


def window_sizes(fs: float, segm_size: float, overlap: float = 0.0) -> tuple[int, int]:
    """(samples of a window, samples from one to the next)."""
    if fs <= 0 or segm_size <= 0 or not 0 <= overlap < segm_size:
        raise ValueError("fs and segm_size must be positive, overlap in [0, segm_size)")
    n, shift = round(fs * segm_size), round(fs * (segm_size - overlap))
    if n < 1 or shift < 1:
        raise ValueError("a window needs a sample")
    return n, shift


def windowed(samples: DataFrame, fs: float = 1.0, segm_size: float = 8.0, overlap: float = 0.0, features: tuple[str, ...] = FEATURES, datarate: bool = True, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """(keys, k, DATA_RATE?, LINE_LENGTH?, TKEO_MEAN?): features of whole windows only; a partial last one is dropped.

    Increments count where both their samples lie in the window, energies where all three do; missing ones are skipped, and a
    window without any has null. Each sample goes to the windows that hold it: one shuffle by the keys, then map-side sums.
    """
    if unknown := set(features) - set(FEATURES):
        raise ValueError(f"unknown features {sorted(unknown)}")
    n, shift = window_sizes(fs, segm_size, overlap)
    w = _in_time(*keys)
    last = F.max("i").over(W.partitionBy(*keys))
    step = samples.select(*keys, "i", "x", F.abs(F.col("x") - F.lag("x").over(w)).alias("inc"), (F.col("x") * F.col("x") - F.lag("x").over(w) * F.lead("x").over(w)).alias("psi"), F.floor((last + 1 - n) / shift).alias("k1"))
    if shift == n:
        placed = step.withColumn("k", F.floor(F.col("i") / n))
    else:
        low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("i") - n) / shift) + 1)
        placed = step.withColumn("k", F.explode(F.when(low <= F.floor(F.col("i") / shift), F.sequence(low, F.floor(F.col("i") / shift))).otherwise(F.array().cast("array<bigint>"))))
    placed = placed.where("k <= k1").withColumn("p", F.col("i") - F.col("k") * shift)
    made: list[Column] = []
    if datarate:
        made.append((F.count("x") / n).alias("DATA_RATE"))
    if "LINE_LENGTH" in features:
        made.append(F.sum(F.when(F.col("p") >= 1, F.col("inc"))).alias("LINE_LENGTH"))
    if "TKEO_MEAN" in features:
        made.append(F.avg(F.when(F.col("p").between(1, n - 2), F.col("psi"))).alias("TKEO_MEAN"))
    return placed.groupBy(*keys, "k").agg(*made)
