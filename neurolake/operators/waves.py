"""Half-wave detection: sign runs, pairs, gates, features of windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from neurolake.functions import dsp

WAVES = "wave_id long, min_pos long, min_val double, max_pos long, max_val double, zero_pos long, pk2pk double, delta_t double, upslope double, down_dur double, downslope double"


def sign_runs(samples: DataFrame, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """(keys, run, sgn, start, size, ext_pos, ext_val): maximal runs of one sign; a zero takes the sign before it, leading zeros the first sign, an all-zero signal +1.

    The extreme is the least value of a negative run and the greatest of a positive one, the first of equals."""
    w = W.partitionBy(*keys).orderBy("i")
    own = F.nullif(F.signum("x"), F.lit(0.0))
    behind = F.last(own, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first(own, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    s = samples.where("x is not null").withColumn("sgn", F.coalesce(behind, ahead, F.lit(1.0)).cast("int"))
    s = s.withColumn("run", F.sum(F.coalesce((F.col("sgn") != F.lag("sgn").over(w)).cast("long"), F.lit(0).cast("long"))).over(w))
    most = F.min(F.struct((-F.col("sgn") * F.col("x")).alias("v"), F.col("i")))
    got = s.groupBy(*keys, "run", "sgn").agg(F.min("i").alias("start"), F.count(F.lit(1)).alias("size"), most.alias("e"))
    return got.select(*keys, "run", "sgn", "start", "size", F.col("e.i").alias("ext_pos"), (-F.col("sgn") * F.col("e.v")).alias("ext_val"))


def wave_pairs(samples: DataFrame, fs: float, band: tuple[float, float] | None = None, amplitude: float | None = None, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """(keys, zero_pos, min_pos, min_val, max_pos, max_val, pk2pk, delta_t, down_dur, upslope, downslope): a negative run and the positive one after it.

    band keeps half-waves of durations strictly between half periods of its edges (no upper gate at a lower edge of 0), amplitude those that go as deep."""
    runs = sign_runs(samples, keys)
    w = W.partitionBy(*keys).orderBy("run")
    p = runs.select(*keys, "sgn", F.col("start").alias("zero_pos"), F.col("ext_pos").alias("min_pos"), F.col("ext_val").alias("min_val"), F.lead("ext_pos").over(w).alias("max_pos"), F.lead("ext_val").over(w).alias("max_val"))
    p = p.where("sgn < 0 and max_pos is not null").drop("sgn")
    if band:
        p = p.where((F.col("max_pos") - F.col("min_pos")) > fs / (2 * band[1]))
        if band[0] > 0:
            p = p.where((F.col("max_pos") - F.col("min_pos")) < fs / (2 * band[0]))
    p = p.withColumn("pk2pk", F.col("max_val") - F.col("min_val")).withColumn("delta_t", (F.col("max_pos") - F.col("min_pos")) / fs).withColumn("down_dur", (F.col("min_pos") - F.col("zero_pos")) / fs)
    p = p.withColumn("upslope", F.col("pk2pk") / F.col("delta_t")).withColumn("downslope", F.when(F.col("down_dur") > 0, F.try_divide(-F.col("min_val"), F.col("down_dur"))))
    return p if amplitude is None else p.where(-F.col("min_val") >= amplitude)


def window_features(waves: DataFrame, lengths: DataFrame, n: int, shift: int, fs: float, slope: str = "downslope", keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """(keys, k, WAVE_RATE, PK2PK, SLOPE, DELTA_T, MIN, MAX): a wave belongs to all whole windows with its trough. lengths: (keys, n_samples).

    Waves are dealt to their windows, so nothing is compared by range; a window without waves has rate 0 and nulls."""
    count = F.when(F.col("n_samples") >= n, F.floor((F.col("n_samples") - n) / shift) + 1).otherwise(0)
    spine = lengths.withColumn("_c", count).where("_c > 0").select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)).alias("k"))
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("min_pos") - n) / shift) + 1)
    high = F.floor(F.col("min_pos") / shift)
    placed = waves.where(low <= high).withColumn("k", F.explode(F.sequence(low, high)))
    got = placed.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("c"), *[F.avg(a).alias(b) for a, b in (("pk2pk", "PK2PK"), (slope, "SLOPE"), ("delta_t", "DELTA_T"), ("min_val", "MIN"), ("max_val", "MAX"))])
    return spine.join(got, [*keys, "k"], "left").select(*keys, "k", (F.coalesce("c", F.lit(0)) / (n / fs)).alias("WAVE_RATE"), "PK2PK", "SLOPE", "DELTA_T", "MIN", "MAX")


def detect(x: np.ndarray, fs: float, band: tuple[float, float] = (0.5, 4.0), amplitude: float | None = None, measure_on: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Half-waves of one signal: found in the band, their extremes refined where only drift is taken out. A missing sample leaves no waves."""
    if fs <= 0 or not 0 <= band[0] < band[1] or band[1] >= fs / 2:
        raise ValueError("need fs > 0 and 0 <= low < high < fs / 2")
    x = np.asarray(x, float)
    none = {k.split()[0]: np.zeros(0) for k in WAVES.split(", ")[1:]}
    if len(x) < 3 or np.isnan(x).any():
        return none
    x = x - x.mean()
    narrow = dsp.bandpass_fft(x, fs, *band)
    steady = x - dsp.bandpass_fft(x, fs, 0, band[0]) if band[0] > 0 else x
    if measure_on is not None and len(measure_on) != len(x):
        raise ValueError("measure_on must be as long as the signal")
    value = steady if measure_on is None else np.asarray(measure_on, float) - np.nanmean(measure_on)
    s = np.sign(narrow)
    known = np.flatnonzero(s)
    if not len(known):
        return none
    s = s[known[np.maximum(np.searchsorted(known, np.arange(len(s)), side="right") - 1, 0)]]
    start = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1])
    stop = np.append(start[1:], len(s))
    extreme = np.array([a + int(np.argmax(narrow[a:b] * s[a])) for a, b in zip(start, stop)])
    neg = np.flatnonzero((s[start[:-1]] < 0))
    lo, hi, zero = extreme[neg], extreme[neg + 1], start[neg]
    h = round(fs / (2 * band[1]))

    def refine(at: np.ndarray, sign: float) -> np.ndarray:
        """The extreme of the 2h + 1 samples from h before on; less at the end of the signal."""
        return np.array([a + int(np.argmax(sign * steady[a : a + 2 * h + 1])) for a in np.maximum(at - h, 0)], int)

    lo, hi = refine(lo, -1.0), refine(hi, 1.0)
    gate = (hi - lo) > fs / (2 * band[1])
    if band[0] > 0:
        gate &= (hi - lo) < fs / (2 * band[0])
    lo, hi, zero = lo[gate], hi[gate], zero[gate]
    pk, dt, down = value[hi] - value[lo], (hi - lo) / fs, (lo - zero) / fs
    out = dict(min_pos=lo, min_val=value[lo], max_pos=hi, max_val=value[hi], zero_pos=zero, pk2pk=pk, delta_t=dt, upslope=pk / dt, down_dur=down, downslope=np.where(down > 0, -value[lo] / np.where(down > 0, down, 1), np.nan))
    keep = -out["min_val"] >= amplitude if amplitude is not None else np.ones(len(lo), bool)
    return {k: v[keep] for k, v in out.items()}


def detect_waves(epochs: DataFrame, fs: float, band: tuple[float, float] = (0.5, 4.0), amplitude: float | None = None, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """A row for each half-wave of each signal array x. The transform takes a whole signal, so a signal is the unit of work."""
    kept = epochs.select(*keys, "x")
    names = [f.name for f in kept.schema[:-1]] if hasattr(kept.schema, "__getitem__") else list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for row in b.itertuples(index=False):
                w = pd.DataFrame(detect(np.array([np.nan if v is None else v for v in row[-1]], float), fs, band, amplitude))
                w.insert(0, "wave_id", np.arange(len(w)))
                for k, v in zip(names, row[:-1]):
                    w[k] = v
                parts.append(w)
            yield pd.concat(parts) if parts else pd.DataFrame()

    kinds = ", ".join(f"{k} {kept.schema[k].dataType.simpleString()}" for k in keys)
    order = [*[c.split()[0] for c in WAVES.split(", ")], *keys]
    return kept.mapInPandas(lambda it: (x[order] for x in run(it) if len(x)), f"{WAVES}, {kinds}")


def nearest_stage(epochs: DataFrame, hypnogram: DataFrame, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """epochs (keys, k, centre_us) with the stage in force at the centre: an as-of join by one sorted pass over both."""
    e = epochs.select(*keys, "k", F.col("centre_us").alias("t"), F.lit(None).cast("string").alias("annotation"), F.lit(None).cast("long").alias("end_us"), F.lit(1).alias("o"))
    h = hypnogram.select(*keys, F.lit(None).cast("long").alias("k"), F.col("start_us").alias("t"), "annotation", "end_us", F.lit(0).alias("o"))
    w = W.partitionBy(*keys).orderBy("t", "o").rowsBetween(W.unboundedPreceding, 0)
    both = e.unionByName(h).withColumn("s", F.last(F.when(F.col("o") == 0, F.struct("annotation", "end_us")), ignorenulls=True).over(w))
    return both.where("o = 1").select(*keys, "k", F.when(F.col("s.end_us") > F.col("t"), F.col("s.annotation")).alias("annotation"))
