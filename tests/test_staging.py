"""Signals to hypnograms, and the operators around."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurolake.functions import dsp
from neurolake.operators import classifiers, evoked, features, quality, spectral, staging, waves
from neurolake.sources import tables


def night(spark, seed=1, fs=50, seconds=4, minutes=16):
    """Signal of three stages that change every minute: slow, alpha and fast waves in noise; and its epochs with their stage."""
    rng, n = np.random.default_rng(seed), fs * seconds
    rows, epochs = [], []
    for k in range(minutes * 60 // seconds):
        stage, f, amp = [("N3", 2, 6.0), ("AWAKE", 10, 3.0), ("REM", 18, 2.0)][(k * seconds // 60) % 3]
        t = (np.arange(n) + k * n) / fs
        x = amp * np.sin(2 * np.pi * f * t) + rng.normal(0, 1, n)
        x[rng.random(n) < 0.03] = np.nan
        if k == 7:
            x[: n // 2] = np.nan
        rows += [("a", k * n + i, None if math.isnan(v) else float(v)) for i, v in enumerate(x)]
        epochs.append(("a", k, stage))
    samples = spark.createDataFrame(rows, "rec string, i long, x double")
    return samples, spark.createDataFrame(epochs, "rec string, k long, annotation string")


def test_signal_to_hypnogram(spark):
    fs, seconds = 50, 4
    bands = [(0.5, 5), (8, 12), (14, 20)]
    samples, stages = night(spark)
    labelled = staging.signal_epochs(samples, fs, seconds).join(stages, ["rec", "k"])
    model = staging.SignalModel(fs, seconds, bands).fit(labelled)
    scores = model.scores(samples)
    assert scores.count() == labelled.count() == 16 * 15 - 1 and scores.where("k = 7").count() == 0
    h = model.hypnogram(samples).orderBy("start_us").collect()
    truth = {r["k"]: r["annotation"] for r in stages.collect()}
    agree = [truth[k] == r["annotation"] for r in h for k in range(r["start_us"] // 4_000_000, r["end_us"] // 4_000_000)]
    assert np.mean(agree) > 0.85 and all(a["end_us"] <= b["start_us"] for a, b in zip(h, h[1:])) and len(h) < 40
    causal = staging.CausalModel(fs, seconds, bands).fit(labelled, evaluations=30, popsize=3)
    c = causal.hypnogram(samples).collect()
    assert causal.kappa > 0.6 and {r["annotation"] for r in c} <= {"N3", "AWAKE", "REM"} and sum(r["duration"] for r in c) == pytest.approx(4.0 * (16 * 15 - 1))


def test_half_rate_keeps_slow_waves(spark):
    t = np.arange(1000) / 500
    x = np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 120 * t)
    rows = [("a", i, None if i in (300, 301) else float(v)) for i, v in enumerate(x)]
    got = quality.halve_rate(spark.createDataFrame(rows, "rec string, i long, x double"), 500.0).orderBy("i").collect()
    y = np.array([np.nan if r["x"] is None else r["x"] for r in got])
    assert len(y) == 500 and np.isnan(y).sum() == 1 and np.isnan(y[150])
    far = np.abs(y - np.sin(2 * np.pi * 5 * t[::2]))
    assert np.nanmax(far[60:140]) < 0.05 and np.nanmax(far[165:-60]) < 0.05


def test_spectral_extractor_options(spark):
    rng = np.random.default_rng(2)
    x = np.sin(2 * np.pi * 7 * np.arange(200) / 100) * 5 + rng.normal(size=200) + 40
    df = spark.createDataFrame([(0, [float(v) for v in x]), (1, [float(v) for v in x[:150]] + [None] * 10)], "rec int, x array<double>")
    mine = lambda s: [F.element_at(F.col(s.psd), 14).alias("at_7")]
    plain, cut = (spectral.extract(df, 100.0, 200, [(2, 10), (10, 20)], ("relative_bands", mine), prefilter=True, stimulation=k, datarate=True, pad=True).orderBy("rec").collect() for k in (None, 7))
    assert [round(r["DATA_RATE"], 3) for r in plain] == [1.0, 0.95] and cut[0]["at_7"] < 0.2 * plain[0]["at_7"]


def test_trained_scaling_noise_and_labels(spark):
    df = spark.createDataFrame([("a", float(v), 1.0) for v in range(10)] + [("b", float(v), 2.0) for v in (5, 9)], "label string, v double, w double")
    z = features.ZScore(["v"]).fit(df.where("label = 'a'"))
    assert z.transform(df.where("v = 9 and label = 'b'")).head()["v"] == pytest.approx((9 - 4.5) / np.std(np.arange(10)))
    each = features.ZScore(["v", "w"], "label").fit(df)
    row = each.transform(df.where("v = 9 and label = 'b'")).head()
    assert set(each.state) == {"a", "b"} and row["v_b"] == pytest.approx(1.0) and row["w_a"] is None
    noisy = features.balance(df, "label", ["v"], {"v": 0.1}).where("label = 'b'").collect()
    assert len(noisy) == 10 and all(r["v"] in (5, 9) for r in noisy if r["copy"] == 0) and all(r["v"] not in (5, 9) and abs(r["v"] - 7) < 4 for r in noisy if r["copy"])
    assert features.replace_labels(df, "label", ["b"], "c").where("label = 'c'").count() == 2
    assert features.remove_samples(df, F.col("v") > 4).count() == 5 and features.remove_features(df, ["w"]).columns == ["label", "v"]


def test_transition_parts():
    t = classifiers.default_matrix()
    q = np.array([0.1, 0.2, 0.4, 0.1, 0.2])
    assert classifiers.change_prior(t, 0) == pytest.approx(1 - t[0, 0]) and classifiers.target_priors(t, 2).sum() == pytest.approx(1)
    s, out = classifiers.markov_step(0, q, t)
    c = classifiers.change_posterior(t, 0, q)
    assert (c > 0.5) == (s != 0) and classifiers.target_posteriors(t, 0, q)[0] == 0
    scaled = classifiers.scale_certainty(t, {1: 0.5})
    assert np.allclose(scaled.sum(axis=1), 1) and scaled[1, 1] < t[1, 1] and np.allclose(scaled[0], t[0])


def test_responses_and_traces(spark):
    rng = np.random.default_rng(3)
    shape = np.sin(np.arange(60) / 6) * np.exp(-np.arange(60) / 20)
    v = np.stack([shape * (10 + k) + rng.normal(0, 0.3, 60) for k in range(6)])
    df = spark.createDataFrame([(0, k, i, float(v[k, i])) for k in range(6) for i in range(60)], "session int, trial int, i long, v double")
    got = evoked.responses(df, 100.0).toPandas()
    whole = got.pivot(index="trial", columns="i", values="fitted").to_numpy() + got.pivot(index="trial", columns="i", values="residual").to_numpy()
    assert np.allclose(whole, v) and got["residual"].abs().mean() < 1.0
    tr = evoked.traces(df).orderBy("i").toPandas()
    assert np.allclose(tr["average"], v.mean(axis=0)) and np.allclose(tr["deviation"], v.std(axis=0))


def test_rereference_csv_and_nearest_stage(spark, tmp_path):
    rows = [("a", ch, i, float(i * k + 1)) for k, ch in enumerate(("x", "m1", "m2")) for i in range(4)]
    got = tables.rereference(spark.createDataFrame(rows, "rec string, ch string, i long, x double"), "x", ["m1", "m2"], 2.0).orderBy("i").collect()
    assert [r["x"] for r in got] == [2 * (1 - (1.5 * i + 1)) for i in range(4)]
    df = spark.createDataFrame([(1, 0.5, "a"), (2, None, "b")], "id long, f double, label string")
    tables.write_features_csv(df, str(tmp_path / "t"))
    assert tables.read_features_csv(spark, str(tmp_path / "t"), df.schema.simpleString()[7:-1].replace(":", " ")).orderBy("id").collect() == df.orderBy("id").collect()
    e = spark.createDataFrame([("a", 0, 5), ("a", 1, 15), ("a", 2, 40)], "rec string, k long, centre_us long")
    h = spark.createDataFrame([("a", "N1", 0, 10), ("a", "N2", 10, 30)], "rec string, annotation string, start_us long, end_us long")
    assert [r["annotation"] for r in waves.nearest_stage(e, h).orderBy("k").collect()] == ["N1", "N2", None]
    taps = dsp.firwin(51, 0.1, 0.3)
    assert abs(np.sum(taps * np.cos(math.pi * (np.arange(51) - 25) * 0.2)) - 1) < 1e-9


def test_maps_and_epochs(spark):
    rng = np.random.default_rng(1)
    a = spark.createDataFrame([(float(v),) for v in rng.normal(0, 1, 400)], "v double")
    b = a.withColumn("v", (F.col("v") - 1.0) / 1.1)
    scale, shift, _ = classifiers.random_map(a, b, ["v"], 4000)
    moved = classifiers.apply_map(b, ["v"], scale, shift).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).head()
    assert abs(moved["m"]) < 0.2 and abs(moved["s"] - 1) < 0.15
    s = spark.createDataFrame([("a", i, None if i in (1, 2) else 1.0) for i in range(10)], "rec string, i long, x double")
    assert sorted(r["i"] for r in quality.keep_epochs(s, 4, 0.6).collect()) == [4, 5, 6, 7]
