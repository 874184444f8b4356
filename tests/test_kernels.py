"""Kernel densities and nearest rows in blocks, against their definitions."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd

from neurolake.functions import kernels
from neurolake.operators import classifiers, features
from neurolake.plans import catalog


def test_nearest_rows_hold_no_pairs(monkeypatch):
    rng = np.random.default_rng(0)
    for x in (rng.normal(size=(700, 2)), rng.integers(0, 6, (900, 3)).astype(float), np.zeros((300, 1)), rng.normal(size=(5, 2))):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        k = min(20, len(x) - 1)
        want = np.stack([np.lexsort((np.arange(len(x)), r))[:k] for r in d])
        for block in (1 << 20, 999):
            at, found = kernels.nearest(x, 20, block)
            assert (np.sort(at, axis=1) == np.sort(want, axis=1)).all() and np.allclose(np.sort(found, axis=1), np.take_along_axis(d, want, axis=1))
    tracemalloc.start()
    kernels.local_outlier_factor(rng.normal(size=(20_000, 2)), 20)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_outliers_of_classes(spark):
    rows = [(i, "a", [float(i % 7), float(i % 5)]) for i in range(60)] + [(99, "a", [60.0, 60.0]), (100, "b", [1.0, 1.0]), (101, "a", [None, 1.0])]
    out = features.local_outliers(spark.createDataFrame(rows, "id int, c string, v array<double>"), "id", "v", "c")
    got = {r["id"]: r for r in out.collect()}
    assert got[99]["outlier"] and not got[5]["outlier"] and 100 not in got and got[101]["lof"] is None
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_data_sets_of_more_rows_are_compared(spark):
    n = 21_000
    rng = np.random.default_rng(2)
    y = np.where(rng.random(n) < 0.5, "A", "B")
    x = rng.normal(size=(n, 1)) + (y == "B")[:, None]
    df = spark.createDataFrame(pd.DataFrame(x, columns=["u"]).assign(y=y, d=np.where(np.arange(n) < n - 300, "p", "q")))
    got = features.compare_datasets(df, "d", "y", ["u"]).toPandas().set_index(["a", "b", "class"])
    mine = x[: n - 300]
    z, k = (x[n - 300 :] - mine.mean()) / mine.std(), (mine - mine.mean()) / mine.std()
    assert len(got) == 12 and abs(got.loc[("p", "q", "all"), "loglikelihood"] - np.log(np.exp(-0.5 * (z - k.T) ** 2).mean(axis=1) / np.sqrt(2 * np.pi)).mean()) < 1e-9


def test_kernel_density_of_more_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_500, 2))
    asked = np.array([[0.0, 0.0], [3.0, -4.0], [90.0, 90.0], [5e3, 0.0]])
    make = lambda x: spark.createDataFrame(pd.DataFrame(x, columns=["u", "v"]).assign(id=range(len(x))))
    got = features.kde_log_likelihood(make(x), make(asked), ["u", "v"], "id", 0.7).toPandas().sort_values("id")["ll"]
    e = -0.5 * ((asked[:, None] - x[None]) ** 2).sum(axis=2) / 0.7**2
    want = e.max(axis=1) + np.log(np.exp(e - e.max(axis=1)[:, None]).mean(axis=1)) - 2 * np.log(0.7) - np.log(2 * np.pi)
    assert np.allclose(got, want)
    assert np.allclose(kernels.log_sums(asked, x, 77), kernels.log_sums(asked, x))


def test_compare_datasets_does_every_step(spark):
    got = catalog.QUERIES["compare_datasets"](spark, "/root/testdata/sf0.001").toPandas()
    assert set(got.columns) == {"a", "b", "class", "loglikelihood", "auroc", "ap"}
    assert len(got) == 2 * 2 * 11 and got["auroc"].notna().sum() == 40


def test_kernel_scores_are_dealt_to_all_tasks(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(300, 2)), columns=["u", "v"]).assign(y=rng.integers(0, 2, 300), night=np.arange(300) % 2, id=range(300)))
    m = classifiers.GaussianBayes(["u", "v"], "y", kernel=True).fit(df)
    out = m.scores(df, ["night"], "id", {0: 2.0})
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    got = out.toPandas().sort_values(["night", "id"])
    p = df.toPandas().sort_values(["night", "id"])
    g = np.exp([-0.5, 0.0, -0.5])
    for night in (0, 1):
        q = m.likelihoods(p[p["night"] == night][["u", "v"]].to_numpy())
        q /= q.sum(axis=1, keepdims=True)
        q = np.stack([np.convolve(np.pad(c, 2, mode="edge"), np.convolve(g / g.sum(), g / g.sum()), mode="valid") for c in q.T], axis=1) * [2.0, 1.0]
        assert np.allclose(got[got["night"] == night][["0", "1"]], q / q.sum(axis=1, keepdims=True))
