"""From a signal to its hypnogram: epochs, data-rate gate, features, class scores, intervals; and the causal model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurolake.operators import classifiers, sleep, training

#: seconds of an epoch
EPOCH_S = 30


def signal_epochs(samples: DataFrame, fs: float, seconds: float = EPOCH_S, least: float = 0.85, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """(keys, k, rate, x array): whole epochs of samples (keys, i, x) with at least so high a share of valid samples; missing samples are null in x."""
    n = round(fs * seconds)
    e = samples.groupBy(*keys, F.floor(F.col("i") / n).alias("k")).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"), F.count("x").alias("v"), F.count(F.lit(1)).alias("n"))
    return e.where((F.col("n") == n) & (F.col("v") / n >= least)).select(*keys, "k", (F.col("v") / n).alias("rate"), F.col("s.x").alias("x"))


class SignalModel:
    """A stage model of signals: a training chain over the spectral features of epochs.

    fit() takes labelled epochs (keys, k, x, label), the others samples (keys, i, x). Missing samples count as the epoch's mean.
    """

    def __init__(self, fs: float, seconds: float = EPOCH_S, bands: list[tuple[float, float]] = training.STAGE_BANDS, ignore: list[tuple[float, float]] = (), least: float = 0.85, keys: tuple[str, ...] = ("rec",), **options):  # type: ignore[assignment]
        self.fs, self.seconds, self.bands, self.ignore, self.least, self.keys, self.options = fs, seconds, bands, list(ignore), least, keys, options

    def _features(self, epochs: DataFrame, *more: str) -> tuple[DataFrame, list[str]]:
        mean = F.aggregate(F.filter("x", lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v) / F.greatest(F.lit(1), F.size(F.filter("x", lambda v: v.isNotNull())))
        filled = epochs.withColumn("_m", mean).withColumn("x", F.expr("transform(x, v -> coalesce(v, _m) - _m)")).drop("_m")
        return training.stage_features(filled, self.fs, round(self.fs * self.seconds), self.bands, self.ignore, (*self.keys, "k", *more))

    def fit(self, epochs: DataFrame, label: str = "annotation") -> SignalModel:
        df, cols = self._features(epochs, label)
        self.chain = training.TrainingChain(cols, label, [*self.keys, "k"], **self.options).fit(df)
        self.states = [str(c) for c in self.chain.classes]
        return self

    def scores(self, samples: DataFrame) -> DataFrame:
        """(keys, k, a score for each stage) of the epochs that pass the gate."""
        df, cols = self._features(signal_epochs(samples, self.fs, self.seconds, self.least, self.keys))
        return self.chain.scores(df.dropna(subset=cols), list(self.keys), "k")

    def hypnogram(self, samples: DataFrame, start_us: int = 0) -> DataFrame:
        """(rec, annotation, start_us, end_us, duration): the stage of the best score of each epoch, the first by name of equals; neighbours of one stage merged."""
        return _intervals(self.scores(samples), self.states, self.seconds, start_us)


def _intervals(scored: DataFrame, states: list[str], seconds: float, start_us: int, stage: Column | None = None) -> DataFrame:
    best = stage if stage is not None else F.array_min(F.array(*[F.struct((-F.col(f"`{s}`")).alias("v"), F.lit(s).alias("s")) for s in states]))["s"]
    start = (F.col("k") * round(seconds * 1e6) + start_us).cast("long")
    rows = scored.select("rec", best.alias("annotation"), start.alias("start_us"), (start + round(seconds * 1e6)).alias("end_us")).withColumn("duration", (F.col("end_us") - F.col("start_us")) / F.lit(1e6))
    return sleep.merge(rows)


class CausalModel(SignalModel):
    """A signal model whose scores pass a Markov filter, epoch by epoch; the filter's stabilities are searched on the training scores."""

    def fit(self, epochs: DataFrame, label: str = "annotation", matrix: np.ndarray | None = None, **search) -> CausalModel:
        super().fit(epochs, label)
        df, cols = self._features(epochs, label)
        scored = self.chain.scores(df.dropna(subset=cols), list(self.keys), "k")
        truth = epochs.select(*self.keys, "k", F.col(label).alias("_truth"))
        base = classifiers.default_matrix(self.states) if matrix is None else matrix
        start = "AWAKE" if "AWAKE" in self.states else self.states[0]
        best, self.kappa = training.stability_search(scored.join(truth, [*self.keys, "k"]), list(self.keys), "k", self.states, "_truth", base, start=start, **search)
        self.matrix, self.start = classifiers.stability_matrix(base, best), start
        return self

    def decoded(self, samples: DataFrame) -> DataFrame:
        """(keys, k, state, the corrected score of each stage)."""
        return classifiers.markov_decode(super().scores(samples), list(self.keys), "k", self.states, self.matrix, self.start)

    def hypnogram(self, samples: DataFrame, start_us: int = 0) -> DataFrame:
        return _intervals(self.decoded(samples), self.states, self.seconds, start_us, F.col("state"))
