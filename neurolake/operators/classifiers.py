"""Bayesian stage models, Markov smoothing, distribution maps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from neurolake.functions import kernels, workers

STATES = ["AWAKE", "N1", "N2", "N3", "REM"]
# The default stage transition matrix, rows and columns in the order of STATES.
TRANSITIONS = [
    [0.961, 0.038, 0.001, 0.000, 0.000],
    [0.097, 0.215, 0.634, 0.000, 0.054],
    [0.020, 0.001, 0.846, 0.060, 0.073],
    [0.005, 0.001, 0.105, 0.880, 0.009],
    [0.017, 0.003, 0.061, 0.000, 0.918],
]


def gaussian_nb(train: DataFrame, test: DataFrame, columns: list[str], label: str, row: str) -> DataFrame:
    """(row, class, log_p): Gaussian naive Bayes with class priors; a variance has the library's usual floor of 1e-9 of the largest over all rows."""
    stats = train.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.var_pop(c).alias(f"v_{c}") for c in columns])
    whole = train.agg(F.count(F.lit(1)).alias("all"), (F.greatest(*[F.var_pop(c) for c in columns], F.lit(0.0)) * 1e-9).alias("floor"))
    j = test.crossJoin(F.broadcast(stats.crossJoin(F.broadcast(whole))))
    parts = [-0.5 * (F.ln(2 * math.pi * (F.col(f"v_{c}") + F.col("floor"))) + (F.col(c) - F.col(f"m_{c}")) ** 2 / (F.col(f"v_{c}") + F.col("floor"))) for c in columns]
    return j.select(row, "class", (F.ln(F.col("n") / F.col("all")) + sum(parts, F.lit(0.0))).alias("log_p"))


def predict(scored: DataFrame, row: str, score: str = "log_p") -> DataFrame:
    """(row, class): the class of the greatest score, the first by name of equals."""
    return scored.groupBy(row).agg(F.min(F.struct((-F.round(score, 9)).alias("s"), F.col("class"))).alias("e")).select(row, F.col("e.class").alias("class"))


class GaussianBayes:
    """Class likelihoods by mean and sample covariance, or by a kernel on each training row with a bandwidth of n^(-1/(d+4)).

    A kernel model holds all its training rows, in driver and workers, 8 bytes a value; densities are summed in blocks of BLOCK distances.
    """

    BLOCK = 1 << 18

    def __init__(self, columns: list[str], label: str, kernel: bool = False):
        self.columns, self.label, self.kernel = columns, label, kernel

    def fit(self, df: DataFrame) -> GaussianBayes:
        d = len(self.columns)
        pairs = [(a, b) for i, a in enumerate(self.columns) for b in self.columns[i:]]
        rows = df.groupBy(self.label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(self.columns)], *[F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).collect()
        self.classes = {}
        for r in sorted(rows, key=lambda r: r[self.label]):
            cov = np.zeros((d, d))
            for i, (a, b) in enumerate(pairs):
                j, k = self.columns.index(a), self.columns.index(b)
                cov[j, k] = cov[k, j] = r[f"c{i}"] or 0.0
            points = None
            if self.kernel:
                t = df.where(F.col(self.label) == r[self.label]).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.columns)]).toArrow()
                points = np.stack([t[f"x{i}"].to_numpy() for i in range(d)], axis=1).reshape(-1, d)
                cov = cov * r["n"] ** (-2 / (d + 4))
            self.classes[r[self.label]] = (np.array([r[f"m{i}"] for i in range(d)]), np.linalg.pinv(cov), float(np.linalg.slogdet(cov + 1e-12 * np.eye(d))[1]), points)
        return self

    def likelihoods(self, x: np.ndarray) -> np.ndarray:
        out = []
        for mean, inverse, logdet, points in self.classes.values():
            if points is None:
                e = -0.5 * np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
                out.append(np.exp(e - 0.5 * (logdet + x.shape[1] * math.log(2 * math.pi))))
            else:
                w, v = np.linalg.eigh(inverse)
                turn = v * np.sqrt(np.maximum(w, 0))
                total = kernels.sums((x - mean) @ turn, (points - mean) @ turn, self.BLOCK)
                out.append(total * math.exp(-0.5 * (logdet + x.shape[1] * math.log(2 * math.pi))) / max(len(points), 1))
        return np.stack(out, axis=1)

    def scores(self, df: DataFrame, keys: list[str], order: str, bias: dict[str, float] | None = None, smooth: bool = True) -> DataFrame:
        """df's keys and order with a score for each class: likelihoods to one, smoothed over time by a 3-tap gaussian forward and back, weighted, to one again."""
        kept = df.select(*keys, order, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(self.columns)])
        ids, made = [*keys, order], [f"_q{i}" for i in range(len(self.classes))]
        w = [float((bias or {}).get(c, 1.0)) for c in self.classes]
        g = np.exp(-0.5 * np.array([-1.0, 0.0, 1.0]) ** 2)
        taps = np.convolve(g / g.sum(), g / g.sum()).tolist()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p in batches:
                q = self.likelihoods(np.stack([p[f"_x{i}"].to_numpy(zero_copy_only=False) for i in range(len(self.columns))], axis=1))
                s = q.sum(axis=1, keepdims=True)
                q = np.where(s > 0, q / np.where(s > 0, s, 1), 1 / q.shape[1])
                yield pa.RecordBatch.from_arrays([*[p[c] for c in ids], *[pa.array(c) for c in q.T]], names=[*ids, *made])

        if self.kernel:  # each row meets all kernels, so rows are dealt to all cores
            kept = kept.repartition(workers.tasks(df.sparkSession))
        kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in ids)
        got = kept.mapInArrow(run, kinds + "".join(f", {c} double" for c in made))
        t = W.partitionBy(*keys).orderBy(order)

        def smoothed(c: str) -> Column:
            near = {0: F.col(c)}
            for k in (1, 2):
                near |= {-k: F.coalesce(F.lag(c, k).over(t), near[1 - k]), k: F.coalesce(F.lead(c, k).over(t), near[k - 1])}
            return sum((near[k] * F.lit(taps[k + 2]) for k in range(-2, 3)), F.lit(0.0))

        weighted = got.select(*ids, *[((smoothed(c) if smooth else F.col(c)) * F.lit(x)).alias(c) for c, x in zip(made, w)])
        whole = sum((F.col(c) for c in made), F.lit(0.0))
        return weighted.select(*ids, *[F.try_divide(F.col(c), whole).alias(str(k)) for c, k in zip(made, self.classes)])


def markov_step(state: int, q: np.ndarray, t: np.ndarray) -> tuple[int, np.ndarray]:
    """One epoch: (new state, corrected scores) from the state held, the class scores and the transition matrix."""
    other = np.arange(len(q)) != state
    away = q[other].sum()
    prior = 1 - t[state, state]
    den = away * prior + (1 - away) * (1 - prior)
    c = away * prior / den if den > 0 else 0.0
    r = np.where(other, q * t[state], 0.0)
    r = r / r.sum() if r.sum() > 0 else other / other.sum()
    if c > 0.5:
        new = int(np.argmax(r))
        out = r * (1 - c)
        out[new] = c
        out[state] = 0.0
        out[state] = 1 - out.sum()
        return new, out
    out = r * c
    out[state] = 1 - c
    return state, out


def stability_matrix(t: np.ndarray, stability: np.ndarray) -> np.ndarray:
    """t with the given diagonal, its off-diagonals rescaled to what is left of each row."""
    off = t * (1 - np.eye(len(t)))
    return off / np.where(off.sum(axis=1, keepdims=True) > 0, off.sum(axis=1, keepdims=True), 1) * (1 - stability)[:, None] + np.diag(stability)


def default_matrix(states: list[str] = STATES) -> np.ndarray:
    """The default matrix of the given stages: others are left out, rows made to sum to one."""
    at = [STATES.index(x) for x in states]
    t = np.array(TRANSITIONS)[np.ix_(at, at)]
    return t / t.sum(axis=1, keepdims=True)


def persistent_matrix(stay: float = 0.9, states: list[str] = STATES) -> np.ndarray:
    """A stage stays with the given chance; the others share the rest."""
    return stability_matrix(np.ones((len(states), len(states))), np.full(len(states), stay))


def change_prior(t: np.ndarray, state: int) -> float:
    """The chance that the state is left."""
    return float(1 - t[state, state] / t[state].sum())


def change_posterior(t: np.ndarray, state: int, q: np.ndarray) -> float:
    """The chance that the state is left, given the class scores."""
    prior, away = change_prior(t, state), 1 - q[state]
    return float(prior * away / (prior * away + (1 - prior) * (1 - away)))


def target_priors(t: np.ndarray, state: int) -> np.ndarray:
    """The chances of the other states if the state is left."""
    row = np.where(np.arange(len(t)) == state, 0.0, t[state])
    return row / row.sum()


def target_posteriors(t: np.ndarray, state: int, q: np.ndarray) -> np.ndarray:
    """The chances of the other states if the state is left, given the class scores."""
    row = target_priors(t, state) * q
    return row / row.sum()


def scale_certainty(t: np.ndarray, certainty: dict[int, float]) -> np.ndarray:
    """t with the chances to stay times the given certainties, rows made to sum to one."""
    out = np.array(t, float)
    for state, c in certainty.items():
        out[state, state] *= c
    return out / out.sum(axis=1, keepdims=True)


def markov_decode(scores: DataFrame, keys: list[str], order: str, states: list[str], t: np.ndarray, start: str = "AWAKE") -> DataFrame:
    """(keys, order, state, and the corrected score of each class), epoch by epoch from the start state; a recording is the unit of work, being one recursion."""
    kept = scores.select(*keys, order, *states)
    matrix, n = t.tolist(), len(states)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order).reset_index(drop=True)
        s, out, names = states.index(start), [], []
        for q in p[states].to_numpy(float).tolist():  # markov_step() in plain numbers, as rows are many and short
            row = matrix[s]
            away = sum(q[i] for i in range(n) if i != s)
            prior = 1 - row[s]
            den = away * prior + (1 - away) * (1 - prior)
            c = away * prior / den if den > 0 else 0.0
            r = [0.0 if i == s else q[i] * row[i] for i in range(n)]
            whole = sum(r)
            r = [x / whole for x in r] if whole > 0 else [0.0 if i == s else 1 / (n - 1) for i in range(n)]
            if c > 0.5:
                new = r.index(max(r))
                o = [x * (1 - c) for x in r]
                o[new], o[s] = c, 0.0
                o[s] = 1 - sum(o)
                s = new
            else:
                o = [x * c for x in r]
                o[s] = 1 - c
            out.append(o)
            names.append(states[s])
        p[states] = np.array(out).reshape(len(p), n)
        p.insert(len(keys) + 1, "state", names)
        return p

    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in [*keys, order])
    return kept.groupBy(*keys).applyInPandas(run, f"{kinds}, state string" + "".join(f", `{c}` double" for c in states))


def histogram_kl(a: DataFrame, b: DataFrame, columns: list[str], bins: int = 200, reach: float = 20.0, floor: float = 1e-9) -> DataFrame:
    """(feature, kl): divergence of b's histogram from a's, over a range of the pooled mean and so many pooled deviations."""
    tall = lambda df, side: df.select(F.lit(side).alias("side"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("side", "x.*")
    both = tall(a, 0).unionByName(tall(b, 1))
    lim = both.agg((F.avg("v") - reach * F.stddev_pop("v")).alias("lo"), (2 * reach * F.stddev_pop("v") / bins).alias("w"))
    binned = both.crossJoin(F.broadcast(lim)).select("side", "feature", F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.col("w")))).alias("bin"))
    n = binned.groupBy("feature", "bin").agg(*[F.sum(F.when(F.col("side") == s, 1).otherwise(0)).alias(f"n{s}") for s in (0, 1)])
    sizes = both.groupBy("feature").agg(*[F.sum(F.when(F.col("side") == s, 1).otherwise(0)).alias(f"t{s}") for s in (0, 1)])
    p, q = (F.col(f"n{s}") / F.col(f"t{s}") + floor for s in (0, 1))
    return n.join(F.broadcast(sizes), "feature").groupBy("feature").agg(F.sum(p * F.ln(p / q)).alias("kl"))


def random_map(a: DataFrame, b: DataFrame, columns: list[str], draws: int = 1000, shift: float = 5.0, scale: tuple[float, float] = (0.9, 1.25), seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """(scale, shift, cost): of random maps of b's features the one whose gaussian divergence from a's is least. Draws need two moments of each side only."""
    row = [df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).head() for df in (a, b)]
    m, s = (np.array([[r[f"{k}{i}"] for i in range(len(columns))] for r in row], float) for k in "ms")
    rng = np.random.default_rng(seed)
    k, t = rng.uniform(*scale, (draws, len(columns))), rng.uniform(-shift, shift, (draws, len(columns)))
    k[0], t[0] = 1, 0
    mu, sd = m[1] * k + t, s[1] * k
    cost = (np.log(sd / s[0]) + (s[0] ** 2 + (m[0] - mu) ** 2) / (2 * sd**2) - 0.5).sum(axis=1)
    best = int(np.argmin(cost))
    return k[best], t[best], float(cost[best])


def apply_map(df: DataFrame, columns: list[str], scale: np.ndarray, shift: np.ndarray) -> DataFrame:
    return df.withColumns({c: F.col(c) * float(k) + float(t) for c, k, t in zip(columns, scale, shift)})
