"""Searches, selections and models of operators.training on made-up rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from neurolake.operators import classifiers, training


def test_differential_evolution_finds_the_minimum():
    x, c = training.differential_evolution(lambda p: ((p - [0.3, -1.0]) ** 2).sum(axis=1) + 1e-3, [(-2, 2), (-2, 2)], generations=200)
    assert np.allclose(x, [0.3, -1.0], atol=0.05) and c < 0.01


def test_decode_all_is_the_step_by_step_decoder():
    rng = np.random.default_rng(0)
    q = rng.dirichlet(np.full(5, 0.3), 60)
    mats = np.array([classifiers.stability_matrix(classifiers.default_matrix(), s) for s in rng.uniform(0.2, 0.9, (4, 5))])
    got = training.decode_all(q, mats, 0)
    for c, t in enumerate(mats):
        s = 0
        for i, p in enumerate(q):
            s, _ = classifiers.markov_step(s, p, t)
            assert got[i, c] == s


def test_stability_search_beats_a_poor_diagonal(spark):
    rng = np.random.default_rng(1)
    states = classifiers.STATES
    rows = []
    for rec in range(3):
        y = np.repeat(rng.integers(5, size=12), 10)
        q = np.full((len(y), 5), 0.1)
        seen = np.where(rng.random(len(y)) < 0.15, rng.integers(5, size=len(y)), y)
        q[np.arange(len(y)), seen] = 0.6
        rows += [(rec, i, states[y[i]] if i % 17 else None, *map(float, q[i])) for i in range(len(y))]
    df = spark.createDataFrame(rows, ["rec", "k", "truth", *states])
    t = classifiers.default_matrix()
    best, kappa = training.stability_search(df, ["rec"], "k", states, "truth", t, evaluations=40, popsize=4)
    assert ((best >= 0.2) & (best <= 0.9)).all()
    local = df.toPandas().sort_values(["rec", "k"])

    def agreement(diagonal: np.ndarray) -> float:
        counts = np.zeros((5, 5))
        for _, g in local.groupby("rec"):
            guess = training.decode_all(g[states].to_numpy(float), classifiers.stability_matrix(t, diagonal)[None], 0)[:, 0]
            known = g.truth.notna().to_numpy()
            np.add.at(counts, (g.truth[known].map(states.index), guess[known]), 1)
        return float(training.kappas(counts))

    assert abs(agreement(best) - kappa) < 1e-9
    assert kappa >= np.median([agreement(d) for d in rng.uniform(0.2, 0.9, (20, 5))])


def test_genetic_map_undoes_a_shift(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(0, 1, (2000, 2))
    b = (rng.normal(0, 1, (2000, 2)) - [1.5, -2.0]) / 1.1
    make = lambda x: spark.createDataFrame(pd.DataFrame(x, columns=["u", "v"]))
    scale, shift, cost = training.genetic_map(make(a), make(b), ["u", "v"], generations=12)
    assert np.allclose(shift, [1.5, -2.0], atol=0.4) and cost < 1
    none = training.genetic_map(make(a).where("u > 1000"), make(b), ["u", "v"])
    assert none[2] == 0 and (none[0] == 1).all()


def test_elimination_and_lasso_keep_what_tells():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 12))
    y = 2 * x[:, 1] - x[:, 4] + x[:, 7] + 0.5 * x[:, 9] + 0.1 * rng.normal(size=600)
    m = np.column_stack([x, np.ones(600), y])
    g = np.stack([m[k::5].T @ m[k::5] for k in range(5)])
    assert {1, 4, 7, 9} <= set(training.eliminate(g)) and len(training.eliminate(g)) <= 7
    w = training.lasso(g.sum(axis=0), 0.2)
    assert set(np.flatnonzero(w)) <= {1, 4, 7, 9} and w[1] > 1


def test_chain_tells_classes_apart(spark):
    rng = np.random.default_rng(4)
    y = np.array(["A"] * 150 + ["B"] * 60)
    x = rng.normal(size=(210, 6)) + (y == "B")[:, None] * np.array([3, -3, 0, 0, 2, 0])
    df = spark.createDataFrame(pd.DataFrame(x, columns=[f"f{i}" for i in range(6)]).assign(id=range(210), rec=0, y=y))
    cols = [f"f{i}" for i in range(6)]
    for options in ({"select": 2}, {"kernel": True, "normalise": False}):
        chain = training.TrainingChain(cols, "y", ["id"], **options).fit(df)
        got = chain.scores(df, ["rec"], "id", smooth=False).toPandas().sort_values("id")
        assert (np.where(got["A"] > got["B"], "A", "B") == y).mean() > 0.9
    with pytest.raises(ValueError):
        training.TrainingChain(cols, "y", ["id"]).fit(df.where("id < 0"))


def test_kernel_density_takes_every_row(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_400, 2))
    y = np.where(np.arange(len(x)) < 400, "B", "A")
    x[-3000:] += 40
    df = spark.createDataFrame(pd.DataFrame(x[:20_400], columns=["u", "v"]).assign(y=y))
    more = spark.createDataFrame(pd.DataFrame(x[400:1400] - 30, columns=["u", "v"]).assign(y="A"))
    m = classifiers.GaussianBayes(["u", "v"], "y", kernel=True).fit(df.unionByName(more))
    assert {c: len(v[3]) for c, v in m.classes.items()} == {"A": 21_000, "B": 400}
    asked = np.array([[0.0, 0.0], [40.0, 40.0], [-30.0, -30.0]])
    got = m.likelihoods(asked)
    monkeypatch.setattr(classifiers.GaussianBayes, "BLOCK", 7)
    small = classifiers.GaussianBayes(["u", "v"], "y", kernel=True).fit(df.where("y = 'B'"))
    mine = x[:400]
    cov = np.cov(mine.T) * 400 ** (-2 / 6)
    d = asked[:, None] - mine[None]
    want = np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", d, np.linalg.inv(cov), d)).mean(axis=1) / (2 * np.pi * np.sqrt(np.linalg.det(cov)))
    assert np.allclose(small.likelihoods(asked)[:, 0], want) and np.allclose(got[:, 1], want)


def test_pair_structure_tells_classes_apart(spark):
    rng = np.random.default_rng(5)
    y = np.array(["A"] * 15 + ["B"] * 15)
    x = rng.normal(size=(30, 2)) * 0.3 + (y == "B")[:, None] * np.array([4.0, 0.0])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["u", "v"]).assign(id=range(30), rec=0, y=y))
    got = training.PairStructure(["u", "v"], "y").fit(df).scores(df, ["rec"], "id").toPandas().sort_values("id")
    assert (np.where(got["A"] > got["B"], "A", "B") == y).mean() > 0.9
    with pytest.raises(ValueError):
        training.PairStructure(["u", "v"], "y", max_rows=10).fit(df)


def test_stimulation_models_take_their_frequency(spark):
    rng = np.random.default_rng(6)
    fs, n, rows = 100.0, 400, []
    for i in range(80):
        slow = i % 2 == 0
        t = np.arange(n) / fs
        x = np.sin(2 * np.pi * (1.6 if slow else 10.4) * t + i) + 0.3 * rng.normal(size=n)
        rows.append((i, 0, x.tolist(), "N3" if slow else ("UNKNOWN" if i == 1 else "AWAKE"), 7.0 if i % 4 < 2 else 0.0, 0.5 if i == 2 else 1.0))
    df = spark.createDataFrame(rows, "id long, rec long, x array<double>, annotation string, freq double, rate double")
    m = training.StimulationModels(fs, n, ("id", "rec")).fit(df)
    assert set(m.chains) == {0.0, 2.0, 7.0}
    got = m.scores(df, ["rec"], "id").toPandas().merge(df.select("id", "annotation").toPandas())
    assert len(got) == 80
    known = got[got.annotation != "UNKNOWN"]
    assert (np.where(known["N3"] > known["AWAKE"], "N3", "AWAKE") == known.annotation).mean() > 0.8
