"""Evoked responses of many trials: what is held grows with the trials, not with their pairs."""

from __future__ import annotations

import tracemalloc

import numpy as np

from neurolake.operators import evoked


def held(run) -> float:
    """MB that run allocates at its peak."""
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def many(k: int) -> np.ndarray:
    rng = np.random.default_rng(0)
    return np.sin(np.arange(60) / 6)[None] * rng.normal(3, 1, k)[:, None] + rng.normal(0, 1, (k, 60))


def sessions(spark, sizes, n=12):
    rng = np.random.default_rng(1)
    rows = [(s, t, [float(v) for v in rng.normal(0.3, 1, n)]) for s, k in sizes.items() for t in range(k)]
    return spark.createDataFrame(rows, "session int, trial int, v array<double>"), {s: np.array([v for a, _, v in rows if a == s]) for s in sizes}


def pairs(x):
    norm = np.sqrt((x * x).sum(axis=1))
    return (x / np.where(norm == 0, 1, norm)[:, None]) @ x.T


def test_parameterisation_holds_no_pairs(monkeypatch):
    assert held(lambda: evoked.parameterise(many(1500).T, np.arange(60) / 100)) < 30
    x = many(41)
    for block in (5, 512):
        monkeypatch.setattr(evoked, "BLOCK", block)
        for k in (2, 3, 6, 7, 8, 40, 41):
            s = pairs(x[:k])
            one = [s[a, b] for a in range(k) for b in range(k) if a != b and evoked._stands(a, b, k)]
            assert np.allclose(evoked._selected_sums(x[:k]), (len(one), np.sum(one), np.square(one).sum()))


def test_responses_come_in_parts(spark):
    df, x = sessions(spark, {0: evoked.BLOCK + 90, 1: 5}, 20)
    got = evoked.responses(df, 50.0).toPandas()
    for s, v in x.items():
        g = got[got["session"] == s].sort_values(["trial", "i"])
        assert len(g) == v.size and np.allclose(g["fitted"] + g["residual"], v.reshape(-1))


def test_selected_pairs_are_made_once(spark, monkeypatch):
    monkeypatch.setattr(evoked, "SIDE", 3)
    df, x = sessions(spark, {0: 10, 1: 3, 2: 1, 3: 7})
    got = {(r["session"], r["a"], r["b"]): r["s"] for r in evoked.select_pairs(df).collect()}
    want = {(s, a, b): pairs(v)[a, b] for s, v in x.items() for a in range(len(v)) for b in range(len(v)) if a != b and evoked._stands(a, b, len(v))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_projections_are_made_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(evoked, "SIDE", 4)
    df, x = sessions(spark, {0: 11, 1: 2, 2: 1})
    got = evoked.projections(df)
    rows = {(r["session"], r["a"], r["b"]): r["s"] for r in got.collect()}
    want = {(s, a, b): pairs(v)[a, b] for s, v in x.items() for a in range(len(v)) for b in range(len(v)) if a != b}
    assert rows.keys() == want.keys() and all(abs(rows[k] - want[k]) < 1e-12 for k in want)


def test_statistics_hold_no_pairs():
    assert held(lambda: evoked._statistic(many(3000))) < 30
    for k in (2, 3, 4, 7, 8):
        x = many(k)
        s = pairs(x)
        want = [np.mean([s[a, b] for a in range(k) for b in range(k) if a != b and t in (a, b) and evoked._stands(a, b, k)]) for t in range(k)]
        assert np.allclose(evoked._statistic(x), want)


def test_rejection_reads_each_trial_once(spark):
    df, x = sessions(spark, {0: 9, 1: 2}, 30)
    far = df.unionByName(spark.createDataFrame([(0, 99, [50.0] * 30)], df.schema))
    plan = evoked.reject(evoked.trial_statistic(far))
    assert {r["trial"] for r in plan.collect() if r["rejected"]} == {99}
    assert "Generate" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_profile_holds_no_pairs():
    x, lengths = many(3000), np.arange(10, 60, 5)
    assert held(lambda: evoked._profile(x, 100.0, lengths)) < 30
    for k in (2, 3, 50):
        mean, var = evoked._profile(x[:k], 4.0, lengths)
        for j, m in enumerate(lengths):
            s = pairs(x[:k, :m])[~np.eye(k, dtype=bool)] / 2
            assert np.allclose((mean[j], var[j]), (s.mean(), s.var()))


def test_durations_of_whole_trials_are_those_of_samples(spark):
    df, x = sessions(spark, {0: 6, 1: 3}, 40)
    rows = spark.createDataFrame([(s, t, i + 5, float(v)) for s, x in x.items() for t, y in enumerate(x) for i, v in enumerate(y)], "session int, trial int, i long, v double")
    a, b = (sorted(map(tuple, evoked.duration(evoked.profile(d, 50.0, 40)).collect())) for d in (df, rows))
    assert a == b and len(a) == 2
