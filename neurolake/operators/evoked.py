"""Evoked responses: canonical response parameterisation of trials (session, trial, i, v).

Trials come as sample rows, or whole: (session, trial, v array), whose samples count from 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from neurolake.functions import dsp, workers

#: trials of a session whose products are held at once
BLOCK = 512
#: trials in a side of the pairs that a task makes, and pairs of an Arrow batch of them
SIDE, PAIRS = 2048, 1 << 16


def whole(trials: DataFrame) -> DataFrame:
    """(session, trial, v array), with i array if samples came as rows: a row for each trial."""
    if trials.schema["v"].dataType.typeName() == "array":
        return trials.select("session", "trial", "v").where(F.size("v") > 0)
    s = F.sort_array(F.collect_list(F.struct("i", F.col("v").cast("double").alias("v"))))
    return trials.groupBy("session", "trial").agg(s.alias("s")).select("session", "trial", F.col("s.i").cast("array<bigint>").alias("i"), F.col("s.v").alias("v"))


def _matrix(batches: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(trials in order, the samples' places, their samples in rows) of whole trials; what a trial has not is NaN."""
    t = pa.Table.from_batches(batches)
    t = t.take(pc.sort_indices(t["trial"])).combine_chunks()
    flat = lambda c: pa.concat_arrays([c.flatten() for c in t[c].chunks]).to_numpy(zero_copy_only=False)
    sizes = np.nan_to_num(pc.list_value_length(t["v"]).to_numpy()).astype(np.int64)
    ids, v = pa.concat_arrays(t["trial"].chunks), flat("v").astype(float, copy=False)
    if (sizes == sizes[0]).all():
        at = flat("i").reshape(len(ids), -1) if "i" in t.column_names else np.arange(sizes[0])[None]
        if (at == at[0]).all():
            if (np.diff(at[0]) == 0).any():
                raise ValueError("a trial has two values of one sample")
            return ids, at[0], v.reshape(len(ids), -1)
    at = flat("i") if "i" in t.column_names else np.arange(len(v)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(ids)), sizes)
    if ((np.diff(at) == 0) & (np.diff(row) == 0)).any():
        raise ValueError("a trial has two values of one sample")
    grid, column = np.unique(at, return_inverse=True)
    x = np.full((len(ids), len(grid)), np.nan)
    x[row, column] = v
    return ids, grid, x


def _by_session(trials: DataFrame, run: Callable[[pa.Array, np.ndarray, np.ndarray], Iterator[dict]], schema: str) -> DataFrame:
    """Columns that run makes of each session's (trials, places, samples in rows); a session is the unit of work and held once, as numbers."""

    def of(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in run(*_matrix(list(batches))):
            n = len(next(iter(made.values())))
            yield pa.RecordBatch.from_pydict({"session": pa.repeat(key[0], n)} | {c: x if isinstance(x, pa.Array) else pa.array(np.asarray(x)) for c, x in made.items()})
        workers.trim()

    kind = trials.schema["session"].dataType.simpleString()
    return whole(trials).groupBy("session").applyInArrow(of, f"session {kind}, {schema}")


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, one for those without any."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return np.where(norm == 0, 1, norm)


def projections(trials: DataFrame, one_way: bool = False) -> DataFrame:
    """(session, a, b, s): trial b projected on the unit vector of trial a; a zero trial has norm one. one_way: one orientation of each pair, see selected().

    All pairs are asked for. Trials are numbered in each session and dealt to sides of SIDE trials; a task makes the pairs of two sides and hands
    them on PAIRS at a time, so what it holds doesn't grow.
    """
    kind, tk = (trials.schema[c].dataType.simpleString() for c in ("session", "trial"))
    s = whole(trials)
    by = W.partitionBy("session")
    numbered = s.withColumn("r", (F.row_number().over(by.orderBy("trial")) - 1).cast("long")).withColumn("k", F.count(F.lit(1)).over(by)).withColumn("own", F.floor(F.col("r") / SIDE))
    sides = F.sequence(F.lit(0).cast("long"), F.floor((F.col("k") - 1) / SIDE))
    dealt = numbered.withColumn("o", F.explode(sides)).withColumn("p", F.least("own", "o")).withColumn("q", F.greatest("own", "o")).drop("o")
    # pairs are many where trials are few, so tasks are counted, not left to the size of the trials
    dealt = dealt.repartition(workers.tasks(trials.sparkSession), "session", "p", "q")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        ids, _, x = _matrix(batches)
        t = pa.Table.from_batches(batches)
        r, own, k = (t[c].to_numpy()[pc.sort_indices(t["trial"]).to_numpy()] for c in ("r", "own", "k"))
        x = np.nan_to_num(x)
        unit = x / _norms(x)[:, None]
        p, q = key[1].as_py(), key[2].as_py()
        for a, b in {(p, q), (q, p)}:
            rows, cols = np.flatnonzero(own == a), np.flatnonzero(own == b)
            step = max(1, PAIRS // max(len(cols), 1))
            for at in range(0, len(rows), step):
                mine = rows[at : at + step]
                keep = _standing(r[mine][:, None], r[cols][None], k[0]) if one_way else r[mine][:, None] != r[cols][None]
                i, j = np.nonzero(keep)
                got = (unit[mine] @ x[cols].T)[i, j]
                yield pa.RecordBatch.from_pydict({"session": pa.repeat(key[0], len(i)), "a": ids.take(pa.array(mine[i])), "b": ids.take(pa.array(cols[j])), "s": got})
        workers.trim()

    return dealt.groupBy("session", "p", "q").applyInArrow(run, f"session {kind}, a {tk}, b {tk}, s double")


def _profile(x: np.ndarray, fs: float, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, population variance) over all ordered pairs of trials (rows) of the projections over sqrt(fs), of the first samples of each length.

    A projection is a product u.x, so over all pairs its mean is that of the means of u and x, and its variance follows from both
    covariances; a trial's projection on itself, which is its length, is taken out. So work grows with the trials, not with their pairs.
    """
    k, blocks = len(x), [slice(at, at + BLOCK) for at in range(0, len(x), BLOCK)]
    centre = x.mean(axis=0)
    spread = sum((x[b] - centre).T @ (x[b] - centre) for b in blocks) / k
    mean, var = np.zeros(len(lengths)), np.zeros(len(lengths))
    for j, m in enumerate(lengths):
        part = x[:, :m]
        norm = np.sqrt(np.einsum("ij,ij->i", part, part))
        scale = 1 / np.where(norm == 0, 1, norm)
        mu = scale @ part / k
        own = np.zeros((m, m))
        for b in blocks:
            u = part[b] * scale[b, None] - mu
            own += u.T @ u
        own, c, cov = own / k, centre[:m], spread[:m, :m]
        middle = mu @ c
        square = k * k * (c @ own @ c + mu @ cov @ mu + (own * cov).sum()) - ((norm - middle) ** 2).sum()
        pairs = max(1, k * (k - 1))
        mean[j] = (k * k * middle - norm.sum()) / pairs
        var[j] = max(square / pairs - (mean[j] - middle) ** 2, 0)
    return mean / math.sqrt(fs), var / fs


def profile(trials: DataFrame, fs: float, n: int, first: int = 10, step: int = 5) -> DataFrame:
    """(session, length, mean, var): mean and population variance over pairs of the projections, over sqrt(fs), of the first 10, 15, ... samples."""
    lengths = np.arange(first, n, step)

    def run(ids: pa.Array, grid: np.ndarray, x: np.ndarray) -> Iterator[dict]:
        here = lengths[lengths <= x.shape[1]]
        if len(ids) > 1:
            mean, var = _profile(np.nan_to_num(x), fs, here)
            yield {"length": here, "mean": mean, "var": var}

    return _by_session(trials, run, "length long, mean double, var double")


def duration(profile_: DataFrame) -> DataFrame:
    """(session, length): that of the greatest mean, the shortest of equals."""
    return profile_.groupBy("session").agg(F.min(F.struct((-F.round("mean", 9)).alias("m"), F.col("length"))).alias("e")).select("session", F.col("e.length").alias("length"))


def selected(a: Column, b: Column, k: Column) -> Column:
    """Whether the ordered pair of trial ranks stands for its pair: each trial leads in about half of its pairs."""
    d = F.pmod(b - a, k)
    return (d * 2 < k) | ((d * 2 == k) & (F.least(a, b) % 2 == F.when(a < b, 0).otherwise(1)))


def _standing(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """selected() of ranks that are arrays."""
    d = (b - a) % k
    return (a != b) & ((2 * d < k) | ((2 * d == k) & ((np.minimum(a, b) % 2 == 0) == (a < b))))


def select_pairs(trials: DataFrame) -> DataFrame:
    """projections of one orientation of each pair; ranks are the order of the trials."""
    return projections(trials, one_way=True)


def _statistic(x: np.ndarray) -> np.ndarray:
    """Of each trial (row) the mean of the selected projections in which it takes part.

    A trial leads the next ranks, half of all, round the session, and follows as many before it; so their sums are differences of running sums.
    """
    k = len(x)
    unit, half = x / _norms(x)[:, None], (k - 1) // 2
    total = np.zeros(k)
    for mine, others, way in ((unit, x, 1), (x, unit, -1)):
        turned = others[::way]
        run = np.zeros((k + half + 1, x.shape[1]))
        np.cumsum(turned[np.arange(k + half) % k], axis=0, out=run[1:])
        total += np.einsum("ij,ij->i", mine, (run[half + 1 :] - run[1 : k + 1])[::way])
        del run
    if k % 2 == 0:
        lead, partner = _opposite(k)
        s = np.einsum("ij,ij->i", unit[lead], x[partner])
        total[lead] += s
        total[partner] += s
    return total / (k - 1)


def _opposite(k: int) -> tuple[np.ndarray, np.ndarray]:
    """(leading, other) ranks of the pairs half of an even session apart."""
    low = np.arange(k // 2)
    return np.where(low % 2 == 0, low, low + k // 2), np.where(low % 2 == 0, low + k // 2, low)


def _selected_sums(x: np.ndarray) -> tuple[int, float, float]:
    """(number, sum, sum of squares) of the selected projections of trials (rows).

    Squares need the products of the samples of the trials that a trial leads. A block of trials shares most of these, which move on with the
    block; only pairs at both ends of its reach are made one by one.
    """
    k, n = x.shape
    unit, half = x / _norms(x)[:, None], (k - 1) // 2
    total = square = 0.0
    at = lambda lo, hi: x[np.arange(lo, max(lo, hi)) % k]
    core, reach = np.zeros((n, n)), None  # products of the ranks from the first on, up to the second
    for r0 in range(0, k, BLOCK):
        r1 = min(r0 + BLOCK, k)
        u, ranks = unit[r0:r1], np.arange(r0, r1)[:, None]
        lo, hi = r1, r0 + half + 1
        if lo >= hi:
            spans = [(r0 + 1, r1 + half)]
        else:
            spans = [(r0 + 1, lo), (hi, r1 + half)]
            gone, come = reach or (lo, lo)
            for a in range(gone, lo, BLOCK):
                y = at(a, min(a + BLOCK, lo))
                core -= y.T @ y
            for a in range(come, hi, BLOCK):
                y = at(a, min(a + BLOCK, hi))
                core += y.T @ y
            reach = (lo, hi)
            square += ((u @ core) * u).sum()
        for a, b in spans:
            b_ranks = np.arange(a, max(a, b))[None]
            s = (u @ at(a, b).T) * ((b_ranks > ranks) & (b_ranks <= ranks + half))
            square += (s * s).sum()
    run = np.zeros((k + half + 1, n))
    np.cumsum(x[np.arange(k + half) % k], axis=0, out=run[1:])
    total = (unit * (run[half + 1 :] - run[1 : k + 1])).sum()
    if k % 2 == 0:
        lead, partner = _opposite(k)
        s = np.einsum("ij,ij->i", unit[lead], x[partner])
        total, square = total + s.sum(), square + (s * s).sum()
    return k * (k - 1) // 2, float(total), float(square)


def trial_statistic(trials: DataFrame) -> DataFrame:
    """(session, trial, stat): mean of the selected projections in which the trial takes part. Pairs are never made."""

    def run(ids: pa.Array, grid: np.ndarray, x: np.ndarray) -> Iterator[dict]:
        if len(ids) > 1:
            yield {"trial": ids, "stat": _statistic(np.nan_to_num(x))}

    return _by_session(trials, run, f"trial {trials.schema['trial'].dataType.simpleString()}, stat double")


def reject(stats: DataFrame, coeff: float = 3.5) -> DataFrame:
    """stats with rejected: further from the median than coeff robust deviations (1.4826 MAD; at MAD 0 the population deviation); none among under three or without spread."""
    s = stats.join(stats.groupBy("session").agg(F.median("stat").alias("med"), F.count("stat").alias("n"), F.stddev_pop("stat").alias("sd")), "session")
    mad = s.groupBy("session").agg((F.median(F.abs(F.col("stat") - F.col("med"))) * 1.4826).alias("mad"))
    s = s.join(mad, "session").withColumn("spread", F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("sd")))
    far = (F.col("n") >= 3) & (F.col("spread") > 0) & (F.abs(F.col("stat") - F.col("med")) > coeff * F.col("spread"))
    return s.select("session", "trial", "stat", F.coalesce(far, F.lit(False)).alias("rejected"))


def kernel_pca(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit components in columns, singular values) of x (samples, trials), by the eigenvectors of the trials' Gram matrix, descending."""
    w, v = np.linalg.eigh(x.T @ x)
    order = np.argsort(-w)
    s = np.sqrt(np.maximum(w[order], 0))
    e = x @ v[:, order]
    return e / np.where(s > 1e-12 * max(s.max(), 1e-300), s, 1), s


def parameterise(v: np.ndarray, t: np.ndarray, prune: bool = False, coeff: float = 3.5, min_trials: int = 5) -> dict:
    """The whole parameterisation of v (samples, trials) at times t: duration, canonical shape, weights, residuals, significance, rejected trials.

    Pairs of trials are never held: what is asked of them are sums, see _profile() and _selected_sums()."""
    v, t = np.asarray(v, float), np.asarray(t, float)
    if v.ndim != 2 or len(v) != len(t) or v.shape[1] < 2 or len(v) <= 10:
        raise ValueError("need (samples, trials), a time for each sample, two trials and more than 10 samples")
    fs = 1 / np.mean(np.diff(t))
    k, x = v.shape[1], np.ascontiguousarray(v.T)
    lengths = np.arange(10, len(v), 5)
    mean, var = _profile(x, fs, lengths)
    n = int(lengths[int(np.argmax(mean))])

    def test(part: np.ndarray) -> tuple[float, float]:
        count, total, square = _selected_sums(part)
        middle = total / count
        dev2 = square - count * middle**2
        if count < 2 or dev2 <= 1e-14 * square:
            return math.nan, math.nan
        z = middle / math.sqrt(dev2 / (count - 1) / count)
        return float(z), dsp.t_sf(float(z), count - 1)

    part = v[:n]
    c = _shape(part)
    al = c @ part
    if al.sum() < 0:
        c, al = -c, -al
    rest = part - np.outer(c, al)
    stat = _statistic(x[:, :n]) / math.sqrt(fs)
    med = np.median(stat)
    spread = 1.4826 * np.median(np.abs(stat - med)) or stat.std()
    bad = np.abs(stat - med) > coeff * spread if k >= 3 and spread > 0 else np.zeros(k, bool)
    if prune and k >= min_trials and bad.any() and (~bad).sum() >= min_trials:
        out = parameterise(v[:, ~bad], t, False, coeff, min_trials)
        return out | {"rejected": np.flatnonzero(bad).tolist(), "kept": np.flatnonzero(~bad).tolist()}
    error = np.linalg.norm(rest, axis=0)
    t_dur, p_dur = test(x[:, :n])
    t_full, p_full = test(x[:, : lengths[-1]])
    return dict(tau_r=float(t[n]) if n < len(t) else float(t[-1]), length=n, shape=c, al=al, al_p=al / math.sqrt(n), residual=rest, epep_root=error, vsnr=np.abs(al) / np.where(error == 0, np.nan, error), expl_var=1 - error**2 / np.maximum((part**2).sum(axis=0), 1e-300), erp=np.concatenate([c, np.zeros(len(v) - n)]), average=v.mean(axis=1), deviation=v.std(axis=1), profile=mean, profile_var=var, t_dur=t_dur, p_dur=p_dur, t_full=t_full, p_full=p_full, rejected=[], kept=list(range(k)))


def _shape(x: np.ndarray) -> np.ndarray:
    """The first of kernel_pca(); of more trials than samples by the samples' products, which give the same."""
    if x.shape[1] <= len(x):
        return kernel_pca(x)[0][:, 0]
    w, v = np.linalg.eigh(x @ x.T)
    return v[:, -1] * (w[-1] > 0)


def _stands(a: int, b: int, k: int) -> bool:
    d = (b - a) % k
    return 2 * d < k or (2 * d == k and (min(a, b) % 2 == 0) == (a < b))


def crp(trials: DataFrame, fs: float, prune: bool = False, coeff: float = 3.5, min_trials: int = 5) -> DataFrame:
    """A row for each trial kept of each session: duration, weight, its measures, the session's significance. A session is the unit of work."""

    def run(ids: pa.Array, grid: np.ndarray, x: np.ndarray) -> Iterator[dict]:
        got = parameterise(x.T, grid / fs, prune, coeff, min_trials)
        n = len(got["kept"])
        yield {"trial": ids.take(pa.array(got["kept"], "int64")), "length": np.full(n, got["length"])} | {c: np.broadcast_to(np.asarray(got[c], float), n) for c in ("tau_r", "al", "al_p", "vsnr", "expl_var", "t_dur", "p_dur", "p_full")}

    return _by_session(trials, run, f"trial {trials.schema['trial'].dataType.simpleString()}, length long, tau_r double, al double, al_p double, vsnr double, expl_var double, t_dur double, p_dur double, p_full double")


def traces(trials: DataFrame) -> DataFrame:
    """(session, i, average, deviation): over the trials, of each sample."""
    return trials.groupBy("session", "i").agg(F.avg("v").alias("average"), F.stddev_pop("v").alias("deviation"))


def responses(trials: DataFrame, fs: float, prune: bool = False, coeff: float = 3.5, min_trials: int = 5) -> DataFrame:
    """(session, trial, i, fitted, residual): the fitted response of each trial kept, 0 after the duration, and what is left of the trial."""

    def run(ids: pa.Array, grid: np.ndarray, x: np.ndarray) -> Iterator[dict]:
        got = parameterise(x.T, grid / fs, prune, coeff, min_trials)
        kept = np.array(got["kept"])
        for at in range(0, len(kept), BLOCK):
            some = kept[at : at + BLOCK]
            fitted = np.outer(got["al"][at : at + BLOCK], got["erp"])
            yield {"trial": ids.take(pa.array(np.repeat(some, len(grid)))), "i": np.tile(grid, len(some)), "fitted": fitted.reshape(-1), "residual": (x[some] - fitted).reshape(-1)}

    return _by_session(trials, run, f"trial {trials.schema['trial'].dataType.simpleString()}, i long, fitted double, residual double")
