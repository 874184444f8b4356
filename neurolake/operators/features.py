"""Feature matrices: scaling, augmentation, balancing, outliers, scores, projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neurolake.functions import kernels, workers


def zscore(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """df with columns scaled to mean 0 and population deviation 1, over all rows or those of a class; null where there is no spread.

    Statistics are one aggregate, broadcast back: one row, or one for each class."""
    stats = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    made = (df.groupBy(by) if by else df).agg(*stats)
    joined = df.join(F.broadcast(made), by) if by else df.crossJoin(F.broadcast(made))
    out = joined.withColumns({c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0))) for c in columns})
    return out.select(*df.columns)


class RunningZScore:
    """Pooled mean and population deviation over batches; a batch is scaled by what has been seen up to and with it."""

    def __init__(self, columns: list[str]):
        self.columns = columns
        self.state: dict[str, tuple[int, float, float]] = {c: (0, 0.0, 0.0) for c in columns}

    def update(self, batch: DataFrame) -> DataFrame:
        row = batch.agg(*[f(c).alias(f"{n}_{c}") for c in self.columns for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))]).head()
        for c in self.columns:
            n0, m0, s0 = self.state[c]
            n1 = row[f"n_{c}"]
            if n1:
                m1, s1 = row[f"m_{c}"], row[f"s_{c}"]
                m = (n0 * m0 + n1 * m1) / (n0 + n1)
                self.state[c] = (n0 + n1, m, ((n0 * s0**2 + n1 * s1**2 + n0 * (m0 - m) ** 2 + n1 * (m1 - m) ** 2) / (n0 + n1)) ** 0.5)
        return batch.withColumns({c: F.try_divide(F.col(c) - F.lit(m), F.nullif(F.lit(s), F.lit(0.0))) for c, (_, m, s) in self.state.items()})


class ZScore:
    """Scales by the mean and population deviation of training rows; with a label, by those of each class, one column for each feature and class.

    The state is one aggregate: (mean, deviation) by class, None without a label. A feature without spread gives nulls.
    """

    def __init__(self, columns: list[str], label: str | None = None):
        self.columns, self.label = columns, label

    def fit(self, df: DataFrame) -> ZScore:
        stats = [f(c).alias(f"{n}{i}") for i, c in enumerate(self.columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
        rows = (df.groupBy(self.label) if self.label else df).agg(*stats).collect()
        of = lambda r: [(r[f"m{i}"], r[f"s{i}"]) for i in range(len(self.columns))]
        self.state = {r[self.label] if self.label else None: of(r) for r in sorted(rows, key=lambda r: str(r[0]) if self.label else "")}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        name = lambda c, k: c if k is None else f"{c}_{k}"
        return df.withColumns({name(c, k): F.try_divide(F.col(c) - F.lit(m), F.nullif(F.lit(s), F.lit(0.0))) for k, stats in self.state.items() for c, (m, s) in zip(self.columns, stats)})


def remove_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """df without the feature columns."""
    return df.drop(*columns)


def remove_samples(df: DataFrame, where: Column) -> DataFrame:
    """df without the rows for which the condition holds; an undefined condition holds not."""
    return df.where(~F.coalesce(where, F.lit(False)))


def replace_labels(df: DataFrame, label: str, old: list[str], new: str) -> DataFrame:
    """df with every old label replaced by the new one."""
    return df.withColumn(label, F.when(F.col(label).isin(*old), F.lit(new)).otherwise(F.col(label)))


def augment(df: DataFrame, columns: list[str], operation: str) -> DataFrame:
    """df with a column for each feature (ln, log10, sqrt, square) or for each pair in order (+, -, *, /), named op_name or a_op_b; undefined values are null."""
    unary = {"ln": lambda c: F.when(c > 0, F.ln(c)), "log10": lambda c: F.when(c > 0, F.log10(c)), "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)), "square": lambda c: c * c}
    binary = {"+": ("plus", lambda a, b: a + b), "-": ("minus", lambda a, b: a - b), "*": ("times", lambda a, b: a * b), "/": ("over", F.try_divide)}
    made: dict[str, Column] = {}
    if operation in unary:
        made = {f"{operation}_{c}": unary[operation](F.col(c)) for c in columns}
    elif operation in binary:
        word, f = binary[operation]
        made = {f"{a}_{word}_{b}": f(F.col(a), F.col(b)) for i, a in enumerate(columns) for b in columns[i + 1 :]}
    else:
        raise ValueError(f"unknown operation {operation}")
    return df.withColumns(made)


def pairwise_augment(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quotients, then products, of the given columns only."""
    return augment(augment(df, columns, "/"), columns, "*")


def balance(df: DataFrame, label: str, order: list[str], noise: dict[str, float] | None = None, seed: int = 1) -> DataFrame:
    """df with copies of the rows of smaller classes, in order and round and round, until all classes have as many; copy is 0 for originals.

    A class of n rows grows by its own size several times, so each row says how often it is copied; rows of a class are numbered in ranges of the order.
    noise: for features, the deviation of what is added to copies, as a part of that of the class."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    most = n.agg(F.max("_n").alias("_m"))
    j = _numbered(df, label, order).join(F.broadcast(n), label).crossJoin(F.broadcast(most))
    extra = F.col("_m") - F.col("_n")
    copies = F.floor(extra / F.col("_n")) + F.when(F.col("_r") < extra % F.col("_n"), 1).otherwise(0)
    out = j.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies)))
    if noise:
        spread = df.groupBy(label).agg(*[F.stddev_pop(c).alias(f"_s_{c}") for c in noise])
        out = out.join(F.broadcast(spread), label).withColumns({c: F.when(F.col("copy") > 0, F.col(c) + F.randn(seed + k) * F.col(f"_s_{c}") * f).otherwise(F.col(c)) for k, (c, f) in enumerate(noise.items())})
    return out.select(*df.columns, "copy")


#: ranges of the order in which rows are numbered
NUMBERED = 256


def _numbered(df: DataFrame, label: str, order: list[str]) -> DataFrame:
    """df with _r, the rank of each row in its class, from 0. A number that leads the order deals rows to ranges, which are numbered apart; so no task sorts a class."""
    kind, cuts = df.schema[order[0]].dataType, []
    if isinstance(kind, T.NumericType) and not isinstance(kind, T.DecimalType):
        found = df.agg(F.percentile_approx(order[0], [i / NUMBERED for i in range(1, NUMBERED)], 10 * NUMBERED)).head()[0] or []
        cuts = sorted({c for c in found if c == c})
    key = F.col(order[0])

    def place(lo: int, hi: int) -> Column:
        """How many of cuts[lo:hi], besides those before lo, are at most the key."""
        if lo == hi:
            return F.lit(lo)
        m = (lo + hi) // 2
        return F.when(key >= F.lit(cuts[m]).cast(kind), place(m + 1, hi)).otherwise(place(lo, m))

    # null comes first in the order, so its rows are in the first range; NaN is greater than all numbers here too
    dealt = df.withColumn("_g", place(0, len(cuts)))
    whole = dealt.groupBy(label, "_g").agg(F.count(F.lit(1)).alias("_c"))
    ahead = whole.withColumn("_a", F.coalesce(F.sum("_c").over(W.partitionBy(label).orderBy("_g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(F.col(label).alias("_l"), F.col("_g").alias("_h"), "_a")
    inside = dealt.withColumn("_r", F.row_number().over(W.partitionBy(label, "_g").orderBy(*order)) - 1)
    j = inside.join(F.broadcast(ahead), F.col(label).eqNullSafe(F.col("_l")) & (F.col("_g") == F.col("_h")))
    return j.withColumn("_r", F.col("_r") + F.col("_a")).drop("_g", "_a", "_l", "_h")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def local_outliers(df: DataFrame, row: str, vector: str, label: str, k: int = 20, limit: float = 1.5) -> DataFrame:
    """(row, label, lof, outlier): the local outlier factor of each row among those of its class; vector is an array column.

    A class is the unit of work; it is held as numbers, its distances only in part. A row without some number of its vector has no factor."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        t = t.take(pc.sort_indices(t["r"])).combine_chunks()
        ids, x = pa.concat_arrays(t["r"].chunks), pa.concat_arrays([c.flatten() for c in t["v"].chunks]).to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        whole = ~np.isnan(x).any(axis=1)
        lof = np.full(len(x), np.nan)
        if whole.sum() > 1:
            lof[whole] = kernels.local_outlier_factor(x[whole], k)
        for at in range(0, len(x) if len(x) > 1 else 0, 1 << 16):
            part = lof[at : at + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"l": pa.repeat(key[0], len(part)), "r": ids[at : at + (1 << 16)], "lof": pa.array(part, from_pandas=True)})
        workers.trim()

    kept = df.select(F.col(label).alias("l"), F.col(row).alias("r"), F.col(vector).cast("array<double>").alias("v")).where("l is not null and r is not null")
    kinds = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in ("l", "r"))
    made = kept.groupBy("l").applyInArrow(run, f"{kinds}, lof double")
    return made.select(F.col("r").alias(row), F.col("l").alias(label), "lof", (F.col("lof") > limit).alias("outlier"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(F.col(truth).cast("string").alias("truth"), F.col(guess).cast("string").alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def scores(df: DataFrame, truth: str, guess: str, unknown: str = "UNKNOWN") -> DataFrame:
    """(measure, class, value): kappa, accuracy and weighted F1 over all, kappa, F1 and accuracy of each class against the rest, and the rate of unknown pairs, which are left out."""
    c = confusion(df, truth, guess)
    known = c.where(f"truth <> '{unknown}' and guess <> '{unknown}'")
    side = known.groupBy(F.col("truth").alias("k")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)).alias("hit"))
    other = known.groupBy(F.col("guess").alias("k")).agg(F.sum("n").alias("g"))
    per = side.join(other, "k", "full").select("k", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("hit", F.lit(0)).alias("hit"))
    per = per.crossJoin(F.broadcast(known.agg(F.sum("n").alias("all"))))
    po, pe = lambda h, a: h / a, lambda t, g, a: (t * g) / (a * a)
    t, g, hit, n = (F.col(x).cast("double") for x in ("t", "g", "hit", "all"))
    f1 = F.coalesce(F.try_divide(2 * hit, t + g), F.lit(0.0))
    right = (n - t - g + 2 * hit) / n
    chance = pe(t, g, n) + pe(n - t, n - g, n)
    classes = per.select("k", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in (("kappa", F.try_divide(right - chance, 1 - chance)), ("f1", f1), ("accuracy", right))])).alias("x")).select("x.measure", F.col("k").alias("class"), "x.value")
    whole = per.agg(F.sum(hit).alias("h"), F.max(n).alias("a"), F.sum(pe(t, g, n)).alias("e"), F.sum(f1 * t / n).alias("f"))
    acc = po(F.col("h"), F.col("a"))
    total = whole.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in (("kappa", F.try_divide(acc - F.col("e"), 1 - F.col("e"))), ("accuracy", acc), ("f1", F.col("f")))])).alias("x")).select("x.measure", F.lit("all").alias("class"), "x.value")
    lost = c.agg((F.sum(F.when((F.col("truth") == unknown) | (F.col("guess") == unknown), F.col("n")).otherwise(0)) / F.sum("n")).alias("value")).select(F.lit("unknown").alias("measure"), F.lit("all").alias("class"), "value")
    return classes.unionByName(total).unionByName(lost)


#: ranges of scores over which running sums are made
RANGES = 64


def _counted(df: DataFrame, label: str, score: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, s, p, n, all_p, all_n, tp, fp, below): of each distinct score its positive and negative rows, all of them, those at or above it, the negative ones below it.

    Scores are dealt to ranges; running sums go over the totals of the ranges, of which there are few, and inside each range.
    """
    by = df.groupBy(*keys, F.col(score).alias("s")).agg(F.sum(label).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("n"))
    cuts = sorted(set(df.agg(F.percentile_approx(score, [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).head()[0] or []))
    dealt = by.withColumn("_r", F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col("s"))) if cuts else F.lit(0))
    sums = dealt.groupBy(*keys, "_r").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    group = [*keys] or [F.lit(0)]
    ahead, whole = W.partitionBy(*group).orderBy("_r").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*group)
    sums = sums.select(*keys, "_r", *[F.coalesce(F.sum(c).over(ahead), F.lit(0.0)).alias(f"{c}0") for c in ("rp", "rn")], F.sum("rp").over(whole).alias("all_p"), F.sum("rn").over(whole).alias("all_n"))
    inside = W.partitionBy(*keys, "_r").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    run = dealt.select(*keys, "_r", "s", "p", "n", *[F.coalesce(F.sum(c).over(inside), F.lit(0.0)).alias(f"{c}0") for c in ("p", "n")])
    j = run.join(F.broadcast(sums), [*keys, "_r"])
    return j.select(*keys, "s", "p", "n", "all_p", "all_n", (F.col("all_p") - F.col("rp0") - F.col("p0")).alias("tp"), (F.col("all_n") - F.col("rn0") - F.col("n0")).alias("fp"), (F.col("rn0") + F.col("n0")).alias("below"))


def roc_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr, stability): of all scores as thresholds the one with the greatest sqrt((1 - fpr)^2 + tpr^2), the highest of equals; stability is 1 less it."""
    r = _counted(df, label, score).select(F.col("s").alias("threshold"), F.try_divide("tp", "all_p").alias("tpr"), F.try_divide("fp", "all_n").alias("fpr"))
    best = r.agg(F.max(F.struct(F.round(F.sqrt((1 - F.col("fpr")) ** 2 + F.col("tpr") ** 2), 12).alias("q"), "threshold", "tpr", "fpr")).alias("e"))
    return best.select("e.threshold", "e.tpr", "e.fpr", (1 - F.col("e.threshold")).alias("stability"))


def auroc_ap(df: DataFrame, label: str, score: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, auroc, ap): by rank sums with ties halved, and by precision over the falling distinct scores."""
    r = _counted(df, label, score, keys)
    s = r.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), F.sum("p").alias("sum_p"), F.sum("n").alias("sum_n"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("area"))
    return s.select(*keys, F.try_divide(F.col("u"), F.col("sum_p") * F.col("sum_n")).alias("auroc"), F.try_divide("area", "sum_p").alias("ap"))


def compare_datasets(df: DataFrame, dataset: str, label: str, columns: list[str]) -> DataFrame:
    """(a, b, class, loglikelihood, auroc, ap) of every ordered pair of data sets: b's rows, scaled by a's mean and deviation, under the kernel density of a's
    rows of a class: their mean log density, and how well it tells b's rows of that class; class 'all' is the density of all of a's rows.

    All rows of df are kernels: each task holds them, as numbers, and compares its rows with all of them in blocks.
    """
    t = df.select(F.col(dataset).cast("string").alias("d"), F.col(label).cast("string").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).dropna().toArrow()
    names, y = (t[c].to_numpy() for c in ("d", "y"))
    x = np.stack([t[f"x{i}"].to_numpy() for i in range(len(columns))], axis=1).reshape(len(names), len(columns))
    held = {}
    for a in sorted(set(names.tolist())):
        mine = names == a
        mean, dev = x[mine].mean(axis=0), x[mine].std(axis=0)
        dev = np.where(dev > 0, dev, 1)
        held[a] = (mean, dev, {c: (x[mine & (y == c)] - mean) / dev for c in sorted(set(y[mine].tolist()))})
    shared = df.sparkSession.sparkContext.broadcast(held)
    d = len(columns)

    def run(parts):
        for p in parts:
            q = p[columns].to_numpy(float)
            for a, (mean, dev, classes) in shared.value.items():
                z = (q - mean) / dev
                made = {c: kernels.log_sums(z, k) for c, k in classes.items()}
                number = {c: len(k) for c, k in classes.items()} | {"all": sum(map(len, classes.values()))}
                for c, s in ({"all": np.logaddexp.reduce(list(made.values()), axis=0)} | made).items():
                    yield pd.DataFrame({"a": a, "b": p["_d"], "class": c, "hit": (p["_y"] == c).astype("int64"), "ll": s - np.log(number[c]) - d / 2 * np.log(2 * np.pi)})

    asked = df.select(F.col(dataset).cast("string").alias("_d"), F.col(label).cast("string").alias("_y"), *columns).dropna().repartition(workers.tasks(df.sparkSession))
    scored = asked.mapInPandas(run, "a string, b string, class string, hit long, ll double")
    keys = ("a", "b", "class")
    mean = scored.groupBy(*keys).agg(F.avg("ll").alias("loglikelihood"))
    told = auroc_ap(scored.where("class <> 'all'").withColumn("ll", F.round("ll", 9)), "hit", "ll", keys)
    return mean.join(told, list(keys), "left")


class PCA:
    """Fewest leading components that explain the given share of the variance. The covariance is one aggregate over the rows."""

    def __init__(self, columns: list[str], share: float = 0.98):
        self.columns, self.share = columns, share

    def fit(self, df: DataFrame) -> PCA:
        pairs = [(a, b) for i, a in enumerate(self.columns) for b in self.columns[i:]]
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(self.columns)], *[F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).head()
        d = len(self.columns)
        cov = np.zeros((d, d))
        for i, (a, b) in enumerate(pairs):
            j, k = self.columns.index(a), self.columns.index(b)
            cov[j, k] = cov[k, j] = row[f"c{i}"]
        w, v = np.linalg.eigh(cov)
        order = np.argsort(-w)
        w, v = w[order], v[:, order]
        self.explained = w / w.sum()
        keep = min(d, int(np.searchsorted(np.cumsum(self.explained), self.share)) + 1)
        v = v[:, :keep] * np.where(v[np.abs(v[:, :keep]).argmax(axis=0), np.arange(keep)] < 0, -1, 1)
        self.mean, self.components = np.array([row[f"m{i}"] for i in range(d)]), v
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        made = {f"pc{k}": sum(((F.col(c) - float(m)) * float(x) for c, m, x in zip(self.columns, self.mean, self.components[:, k])), F.lit(0.0)) for k in range(self.components.shape[1])}
        return df.withColumns(made)


def kde_log_likelihood(train: DataFrame, test: DataFrame, columns: list[str], row: str, bandwidth: float = 1.0) -> DataFrame:
    """(row, ll): log density at each test row of a gaussian kernel on each training row. The training rows are held by each task, as one array, and gone through in blocks."""
    t = train.select([F.col(c).cast("double").alias(c) for c in columns]).toArrow()
    n, h, d = t.num_rows, bandwidth, len(columns)
    shared = train.sparkSession.sparkContext.broadcast(np.stack([t[c].to_numpy() for c in columns], axis=1).reshape(n, d) / h)

    def run(*cols: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in cols], axis=1)
        return pd.Series(kernels.log_sums(x / h, shared.value) - np.log(n) - d * np.log(h) - d / 2 * np.log(2 * np.pi))

    return test.repartition(workers.tasks(train.sparkSession)).select(row, F.pandas_udf(run, "double")(*columns).alias("ll"))
