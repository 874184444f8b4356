"""Training of stage models: feature elimination and selection, stability and map search, pair structure, stimulation-aware models.

Fits see the rows only through Spark aggregates: Gram matrices, confusion counts and histograms of a bounded size. A whole
generation of a search is one job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurolake.operators import classifiers, features, spectral

# Stimulation frequency of a model, frequencies of the epochs it learns from, bands it leaves out.
STIMULATION_MODELS = {
    0.0: ([0.0], []),
    2.0: ([0.0, 2.0], [(0, 0.5), *[(k - 0.5, k + 0.5) for k in range(2, 30, 2)]]),
    7.0: ([0.0, 7.0], [(0, 0.5), (6, 8), (13, 15), (20, 22), (27, 29)]),
    72.5: ([72.5], []),
}
# Delta, theta, alpha, spindle and two beta bands.
STAGE_BANDS = [(0.5, 5), (4, 9), (8, 14), (11, 16), (14, 20), (20, 30)]


def differential_evolution(cost: Callable[[np.ndarray], np.ndarray], bounds: list[tuple[float, float]], popsize: int = 15, generations: int = 20, seed: int = 1, crossover: float = 0.7) -> tuple[np.ndarray, float]:
    """(point, cost) of the least cost found. cost gets a whole generation, one point a row; popsize points for each dimension."""
    rng = np.random.default_rng(seed)
    low, high = np.array(bounds, float).T
    d, n = len(bounds), max(4, popsize * len(bounds))
    cells = np.stack([rng.permutation(n) for _ in range(d)], axis=1)
    x = low + (cells + rng.random((n, d))) / n * (high - low)
    c = np.asarray(cost(x), float)
    for _ in range(generations):
        if np.std(c) <= 0.01 * abs(np.mean(c)):
            break
        pick = np.argsort(rng.random((n, n)), axis=1)[:, :2]
        moved = x[np.argmin(c)] + rng.uniform(0.5, 1) * (x[pick[:, 0]] - x[pick[:, 1]])
        moved = np.where((moved < low) | (moved > high), low + rng.random((n, d)) * (high - low), moved)
        take = rng.random((n, d)) < crossover
        take[np.arange(n), rng.integers(d, size=n)] = True
        moved = np.where(take, moved, x)
        m = np.asarray(cost(moved), float)
        better = m <= c
        x[better], c[better] = moved[better], m[better]
    best = int(np.argmin(c))
    return x[best], float(c[best])


def decode_all(q: np.ndarray, t: np.ndarray, start: int) -> np.ndarray:
    """(epochs, matrices): the state after each epoch under each of the transition matrices (matrices, k, k)."""
    n = np.arange(len(t))
    s = np.full(len(t), start)
    out = np.empty((len(q), len(t)), int)
    for i, p in enumerate(q):
        row = t[n, s]
        prior = 1 - row[n, s]
        away = p.sum() - p[s]
        den = away * prior + (1 - away) * (1 - prior)
        change = np.where(den > 0, away * prior / np.where(den > 0, den, 1), 0) > 0.5
        r = p * row
        r[n, s] = 0
        none = r.sum(axis=1) == 0
        r[none] = 1
        r[n, s] = -1
        s = np.where(change, r.argmax(axis=1), s)
        out[i] = s
    return out


def kappas(counts: np.ndarray) -> np.ndarray:
    """Cohen's kappa of confusion counts (.., k, k); 0 where chance alone agrees fully."""
    n = np.maximum(counts.sum(axis=(-1, -2)), 1)
    right = np.trace(counts, axis1=-2, axis2=-1) / n
    chance = (counts.sum(axis=-1) * counts.sum(axis=-2)).sum(axis=-1) / n**2
    return np.where(chance < 1, (right - chance) / np.where(chance < 1, 1 - chance, 1), 0.0)


def stability_search(scores: DataFrame, keys: list[str], order: str, states: list[str], truth: str, t: np.ndarray, evaluations: int = 100, popsize: int = 20, bounds: tuple[float, float] = (0.2, 0.9), seed: int = 1, start: str = "AWAKE") -> tuple[np.ndarray, float]:
    """(stability of each state, kappa): the diagonal whose decoded stages agree best with the truth.

    Every generation is one pass: a recording is decoded under all candidates at once and gives confusion counts only.
    Epochs with a null or unknown truth are decoded but not counted.
    """
    kept = scores.select(*keys, order, truth, *states).persist()
    k = len(states)

    def cost(points: np.ndarray) -> np.ndarray:
        mats = np.array([classifiers.stability_matrix(t, p) for p in points])

        def run(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values(order)
            guess = decode_all(p[states].to_numpy(float), mats, states.index(start))
            true = p[truth].map({s: i for i, s in enumerate(states)}).to_numpy(float)
            known = ~np.isnan(true)
            cell = (np.arange(len(mats)) * k + true[known].astype(int)[:, None]) * k + guess[known]
            found, n = np.unique(cell, return_counts=True)
            return pd.DataFrame({"cell": found, "n": n})

        counts = np.zeros(len(mats) * k * k)
        for r in kept.groupBy(*keys).applyInPandas(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            counts[r["cell"]] = r["n"]
        return 1 - kappas(counts.reshape(len(mats), k, k))

    try:
        generations = max(0, math.ceil(evaluations / (popsize * k)) - 1)
        best, c = differential_evolution(cost, [bounds] * k, popsize, generations, seed)
    finally:
        kept.unpersist()
    return best, 1 - c


def genetic_map(a: DataFrame, b: DataFrame, columns: list[str], shift: float = 5.0, scale: tuple[float, float] = (0.9, 1.25), popsize: int = 15, generations: int = 20, bins: int = 200, reach: float = 20.0, floor: float = 1e-9, seed: int = 1) -> tuple[np.ndarray, np.ndarray, float]:
    """(scale, shift, cost): the map of b's features whose histograms diverge least from a's, for any number of features.

    Histograms span the pooled mean of a's features and so many pooled deviations either way; values outside are left out.
    A generation is one pass over b; each task hands on counts of non-empty bins, at most candidates x features x bins.
    """
    d = len(columns)
    tall = a.select(F.explode(F.array(*[F.col(c).cast("double") for c in columns])).alias("v"))
    mid, dev = tall.agg(F.avg("v"), F.stddev_pop("v")).head()
    if mid is None or not dev:
        return np.ones(d), np.zeros(d), 0.0
    lo, width = mid - reach * dev, 2 * reach * dev / bins

    def histograms(df: DataFrame, points: np.ndarray) -> np.ndarray:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(points) * d * bins, np.int64)
            for p in parts:
                x = p[columns].to_numpy(float)
                for i, q in enumerate(points):
                    at = np.floor((x * q[d:] + q[:d] - lo) / width)
                    ok = (at >= 0) & (at < bins)
                    total += np.bincount(((i * d + np.arange(d)) * bins + np.where(ok, at, 0).astype(int))[ok], minlength=len(total))
            found = np.flatnonzero(total)
            yield pd.DataFrame({"cell": found, "n": total[found]})

        out = np.zeros(len(points) * d * bins)
        for r in df.select(*columns).dropna().mapInPandas(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            out[r["cell"]] = r["n"]
        h = out.reshape(len(points), d, bins)
        h = h / np.maximum(h.sum(axis=2, keepdims=True), 1)
        h[h == 0] = floor
        return h / h.sum(axis=2, keepdims=True)

    still = np.concatenate([np.zeros(d), np.ones(d)])
    want = histograms(a, still[None])[0]
    kept = b.select(*columns).persist()

    def cost(points: np.ndarray) -> np.ndarray:
        have = histograms(kept, points)
        return (want * np.log(want / have)).sum(axis=(1, 2))

    try:
        best, c = differential_evolution(cost, [(-shift, shift)] * d + [scale] * d, popsize, generations, seed)
    finally:
        kept.unpersist()
    return best[d:], best[:d], c


def gram(df: DataFrame, columns: list[str], target: str, folds: int, by: list[str]) -> np.ndarray:
    """(folds, d + 2, d + 2): sums of products of columns, one and the target, by folds of hashed keys; one aggregate."""
    names = [F.col(c).cast("double") for c in columns] + [F.lit(1.0), F.col(target).cast("double")]
    n = len(names)
    at = [(i, j) for i in range(n) for j in range(i, n)]
    rows = df.groupBy(F.pmod(F.xxhash64(*by), F.lit(folds)).alias("f")).agg(*[F.sum(names[i] * names[j]).alias(f"p{i}_{j}") for i, j in at]).collect()
    out = np.zeros((folds, n, n))
    for r in rows:
        for i, j in at:
            out[r["f"], i, j] = out[r["f"], j, i] = r[f"p{i}_{j}"] or 0.0
    return out


def _solve(g: np.ndarray, at: list[int], ridge: float) -> np.ndarray:
    d = g.shape[0] - 2
    use = [*at, d]
    return np.linalg.lstsq(g[np.ix_(use, use)] + ridge * max(g[d, d], 1) * np.diag([1.0] * len(at) + [0.0]), g[use, d + 1], rcond=None)[0]


def eliminate(g: np.ndarray, step: int = 5, least: int = 4, ridge: float = 1e-6) -> list[int]:
    """Columns that recursive elimination with cross-validation keeps, from Gram matrices of folds (columns alike in scale).

    The linear model is a ridge regression of the class number, which needs the Gram matrix only; the weakest weights go, step
    at a time. The count of columns with the best mean held-out R2 wins, the smaller of equals.
    """
    whole = g.sum(axis=0)
    d = whole.shape[0] - 2

    def path(train: np.ndarray) -> list[tuple[list[int], np.ndarray]]:
        at, out = list(range(d)), []
        while True:
            w = _solve(train, at, ridge)
            out.append((at, w))
            if len(at) <= least:
                return out
            drop = np.argsort(np.abs(w[:-1]), kind="stable")[: min(step, len(at) - least)]
            at = [c for i, c in enumerate(at) if i not in set(drop.tolist())]

    total: dict[int, float] = {}
    for held in g:
        n = held[d, d]
        if n < 2:
            continue
        spread = held[d + 1, d + 1] - held[d, d + 1] ** 2 / n
        for at, w in path(whole - held):
            use = [*at, d]
            lost = held[d + 1, d + 1] - 2 * w @ held[use, d + 1] + w @ held[np.ix_(use, use)] @ w
            total[len(at)] = total.get(len(at), 0.0) + (1 - lost / spread if spread > 0 else 0.0)
    ways = {len(at): at for at, _ in path(whole)}
    if not total:
        return ways[max(ways)]
    best = min(total, key=lambda k: (-round(total[k], 9), k))
    return ways[best]


def lasso(g: np.ndarray, alpha: float, rounds: int = 200) -> np.ndarray:
    """Weights of an L1 regression of the target by coordinate descent on the Gram matrix; the intercept is free."""
    d = g.shape[0] - 2
    n = max(g[d, d], 1.0)
    m = g[:, d] / n
    c = g / n - np.outer(m, m)
    w = np.zeros(d)
    for _ in range(rounds):
        was = w.copy()
        for j in range(d):
            r = c[j, d + 1] - c[j, :d] @ w + c[j, j] * w[j]
            w[j] = np.sign(r) * max(abs(r) - alpha, 0) / c[j, j] if c[j, j] > 0 else 0.0
        if np.abs(w - was).max(initial=0) < 1e-9:
            break
    return w


class TrainingChain:
    """Balance classes, eliminate features, PCA, z-score, optional L1 selection, class densities.

    order: columns that tell the rows apart; they order the tiling of small classes and deal the folds. The z-score is that of
    the rows as they are, not of the balanced ones. The linear models are least squares, not hinge losses, as these need
    only Gram matrices; normalise=False leaves the z-score out, kernel=False takes gaussian class densities.
    """

    def __init__(self, columns: list[str], label: str, order: list[str], share: float = 0.98, select: int | None = None, normalise: bool = True, kernel: bool = False, folds: int = 5, c: float = 0.01):
        self.columns, self.label, self.order, self.share, self.select = columns, label, order, share, select
        self.normalise, self.kernel, self.folds, self.c = normalise, kernel, folds, c

    def fit(self, df: DataFrame) -> TrainingChain:
        """Several passes over the feature columns, which are persisted meanwhile so that they are made once."""
        rows = df.select(*dict.fromkeys([*self.order, self.label, *self.columns])).dropna(subset=[self.label, *self.columns]).persist()
        try:
            return self._fit(rows)
        finally:
            rows.unpersist()

    def _fit(self, rows: DataFrame) -> TrainingChain:
        self.classes = sorted(r[0] for r in rows.select(self.label).distinct().collect())
        if not self.classes:
            raise ValueError("no labelled rows")
        number = F.create_map(*[F.lit(v) for i, c in enumerate(self.classes) for v in (c, float(i))])[F.col(self.label)]
        balanced = features.balance(rows, self.label, self.order).withColumn("_y", number)
        mean_dev = rows.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(self.columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).head()
        even = balanced.withColumns({c: (F.col(c) - mean_dev[f"m{i}"]) / F.lit(mean_dev[f"s{i}"] or 1.0) for i, c in enumerate(self.columns)})
        self.kept = [self.columns[i] for i in eliminate(gram(even, self.columns, "_y", self.folds, self.order))] if len(self.columns) > 4 else list(self.columns)
        self.pca = features.PCA(self.kept, self.share).fit(balanced)
        self.outputs = [f"pc{k}" for k in range(self.pca.components.shape[1])]
        self.scaling = {p: (0.0, 1.0) for p in self.outputs}
        if self.normalise:
            r = self.pca.transform(rows).agg(*[f(p).alias(f"{k}_{p}") for p in self.outputs for k, f in (("m", F.avg), ("s", F.stddev_pop))]).head()
            self.scaling = {p: (r[f"m_{p}"], r[f"s_{p}"] or 1.0) for p in self.outputs}
        if self.select is not None and len(self.outputs) > self.select:
            z = self.transform(balanced)
            weight = np.zeros(len(self.outputs))
            for i in range(len(self.classes)):
                g = gram(z.withColumn("_t", F.when(F.col("_y") == float(i), 1.0).otherwise(-1.0)), self.outputs, "_t", 1, self.order)[0]
                weight += np.abs(lasso(g, 1 / (2 * self.c * max(g[-2, -2], 1))))
            top = sorted(np.argsort(-weight, kind="stable")[: self.select].tolist())
            self.outputs = [self.outputs[i] for i in top if weight[i] > 1e-5] or [self.outputs[int(weight.argmax())]]
        self.model = classifiers.GaussianBayes(self.outputs, self.label, self.kernel).fit(self.transform(rows))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """df with the chain's output columns."""
        made = self.pca.transform(df)
        made = made.withColumns({p: (F.col(p) - float(self.scaling[p][0])) / float(self.scaling[p][1]) for p in self.outputs})
        return made.select(*df.columns, *self.outputs)

    def scores(self, df: DataFrame, keys: list[str], order: str, bias: dict[str, float] | None = None, smooth: bool = True) -> DataFrame:
        return self.model.scores(self.transform(df), keys, order, bias, smooth)


def stage_features(epochs: DataFrame, fs: float, n: int, bands: list[tuple[float, float]] = STAGE_BANDS, ignore: list[tuple[float, float]] = (), keys: tuple[str, ...] = ("rec",)) -> tuple[DataFrame, list[str]]:  # type: ignore[assignment]
    """(table, feature columns): mean frequency, relative bands and log10 of the ratios of mean bands; 22 columns for six bands.

    Without the mean frequency where bands are ignored, since it is null then.
    """
    wanted = ("relative_bands", "mean_bands") if ignore else ("mean_frequency", "relative_bands", "mean_bands")
    df = spectral.extract(epochs, fs, n, bands, wanted, ignore, keys)
    made = [c for c in df.columns if c not in keys]
    mean = made[-len(bands) :]
    ratios = {f"log_{a}_over_{b}": F.log10(F.try_divide(F.col(f"`{a}`"), F.col(f"`{b}`"))) for i, a in enumerate(mean) for b in mean[i + 1 :]}
    out = df.withColumns(ratios).drop(*mean)
    return out, [c for c in out.columns if c not in keys]


class StimulationModels:
    """One stage model for each stimulation frequency, with the bands that stimulation disturbs left out.

    Epochs are (keys, x array, label, freq, rate). Those labelled N1 or UNKNOWN and those with a data rate of at most least do
    not train. A frequency without training epochs gets no model, and its epochs no scores.
    """

    def __init__(self, fs: float, n: int, keys: tuple[str, ...] = ("rec",), bands: list[tuple[float, float]] = STAGE_BANDS, least: float = 0.85, models: dict = STIMULATION_MODELS, **options):
        self.fs, self.n, self.keys, self.bands, self.least, self.models, self.options = fs, n, keys, bands, least, models, options

    def _features(self, epochs: DataFrame, freq: float, *more: str) -> tuple[DataFrame, list[str]]:
        return stage_features(epochs, self.fs, self.n, self.bands, self.models[freq][1], (*self.keys, *more))

    def fit(self, epochs: DataFrame, label: str = "annotation", freq: str = "freq", rate: str = "rate") -> StimulationModels:
        good = epochs.where((F.col(rate) > self.least) & ~F.col(label).isin("N1", "UNKNOWN"))
        have = {float(r[0]) for r in good.select(freq).distinct().dropna().collect()}
        self.chains = {}
        for f, (learns, _) in self.models.items():
            if have & set(learns):
                df, cols = self._features(good.where(F.col(freq).isin(*learns)), f, label)
                self.chains[f] = TrainingChain(cols, label, list(self.keys), **self.options).fit(df)
        return self

    def scores(self, epochs: DataFrame, keys: list[str], order: str, freq: str = "freq") -> DataFrame:
        """(keys, order, freq, score of each class) of the epochs by the model of their frequency; a class that a model lacks is null."""
        out = None
        for f, chain in self.chains.items():
            df, cols = self._features(epochs.where(F.col(freq) == f), f, *[c for c in (*keys, order) if c not in self.keys])
            made = chain.scores(df.dropna(subset=cols), keys, order).withColumn("freq", F.lit(f))
            out = made if out is None else out.unionByName(made, allowMissingColumns=True)
        if out is None:
            raise ValueError("no model was fitted")
        return out


class PairStructure:
    """Classes from differences between epochs: a kernel density of (length, direction) for each ordered pair of classes.

    Fitted on at most max_rows labelled rows, as it holds all their ordered differences; more are an error. A row's score for a
    class is the density of its differences from the other rows of its group, summed over the others and their classes.
    """

    def __init__(self, columns: list[str], label: str, max_rows: int = 500):
        self.columns, self.label, self.max_rows = columns, label, max_rows

    @staticmethod
    def _differences(x: np.ndarray, others: np.ndarray) -> np.ndarray:
        d = x[:, None] - others[None]
        length = np.sqrt((d**2).sum(axis=2, keepdims=True))
        return np.concatenate([length, np.divide(d, length, out=np.zeros_like(d), where=length > 0)], axis=2)

    def fit(self, df: DataFrame) -> PairStructure:
        rows = df.select(self.label, *self.columns).dropna().limit(self.max_rows + 1).collect()
        if len(rows) > self.max_rows:
            raise ValueError(f"at most {self.max_rows} rows")
        y = np.array([r[0] for r in rows])
        x = np.array([[float(v) for v in r[1:]] for r in rows]).reshape(len(rows), len(self.columns))
        diff = self._differences(x, x)
        apart = ~np.eye(len(y), dtype=bool)
        self.classes = sorted(set(y.tolist()))
        self.kernels: dict[tuple, tuple[np.ndarray, np.ndarray, float]] = {}
        for a in self.classes:
            for b in self.classes:
                p = diff[(y[None, :] == a) & (y[:, None] == b) & apart]
                if len(p) > 1:
                    cov = np.atleast_2d(np.cov(p.T)) * len(p) ** (-2 / (p.shape[1] + 4)) + 1e-9 * np.eye(p.shape[1])
                    white = np.linalg.cholesky(np.linalg.inv(cov))
                    self.kernels[a, b] = (p @ white, white, float(np.linalg.slogdet(cov)[1]))
        return self

    def _density(self, pair: tuple, diff: np.ndarray) -> np.ndarray:
        points, white, logdet = self.kernels[pair]
        z, k, out = diff @ white, points.shape[1], np.empty(len(diff))
        for i in range(0, len(z), 256):
            d2 = np.maximum((z[i : i + 256] ** 2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None] - 2 * z[i : i + 256] @ points.T, 0)
            out[i : i + 256] = np.exp(-0.5 * d2).mean(axis=1)
        return out * math.exp(-0.5 * (logdet + k * math.log(2 * math.pi)))

    def scores(self, df: DataFrame, keys: list[str], row: str) -> DataFrame:
        """(keys, row, score of each class). A group is compared with itself, row by row, so it should be one recording."""
        kept = df.select(*keys, row, *self.columns)

        def run(p: pd.DataFrame) -> pd.DataFrame:
            x = p[self.columns].to_numpy(float)
            out = np.zeros((len(x), len(self.classes)))
            for i in range(len(x)):
                diff = np.delete(self._differences(x[i : i + 1], x)[0], i, axis=0)
                for a, b in self.kernels:
                    out[i, self.classes.index(b)] += self._density((a, b), diff).sum()
            return pd.concat([p[[*keys, row]].reset_index(drop=True), pd.DataFrame(out, columns=[str(c) for c in self.classes])], axis=1)

        kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in [*keys, row])
        return kept.groupBy(*keys).applyInPandas(run, kinds + "".join(f", `{c}` double" for c in self.classes))
