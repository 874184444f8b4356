"""Kernels and operators on signals whose features are known."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurolake.functions import dsp
from neurolake.operators import classifiers, evoked, features, quality, spikes, timefeat, waves


def rows(spark, x, rec="a"):
    return spark.createDataFrame([(rec, i, None if v is None or math.isnan(v) else float(v)) for i, v in enumerate(x)], "rec string, i long, x double")


def test_butterworth_gains():
    b, a = dsp.butter(4, 0.25)
    z = np.exp(-1j * np.pi * 0.25 * np.arange(len(b)))
    assert abs(abs(b @ z) / abs(a @ z) - math.sqrt(0.5)) < 1e-9
    assert abs(b.sum() / a.sum() - 1) < 1e-9
    b, a = dsp.butter(3, 0.1, "high")
    assert abs(b.sum() / a.sum()) < 1e-9


def test_cheby2_stops():
    b, a = dsp.cheby2(5, 40, 0.4)
    w = np.linspace(0.4, 1, 50)
    z = np.exp(-1j * np.pi * w[:, None] * np.arange(len(b)))
    assert (np.abs(z @ b) / np.abs(z @ a) <= 0.01 + 1e-6).all()
    assert abs(b.sum() / a.sum() - 1) < 1e-9


def test_filtfilt_has_no_phase():
    t = np.arange(2000) / 200
    x = np.sin(2 * np.pi * 5 * t)
    y = dsp.filtfilt(*dsp.butter(4, 0.2), x)
    assert np.abs(y - x)[200:-200].max() < 1e-3
    b, a = dsp.iirnotch(50, 10, 200)
    assert np.abs(dsp.filtfilt(b, a, np.sin(2 * np.pi * 50 * t)))[400:-400].max() < 1e-3


def test_resample_keeps_the_tone():
    for fs in (500, 512, 1024):
        x = np.sin(2 * np.pi * 30 * np.arange(5 * fs) / fs)
        y = dsp.resample(x, 200, fs)
        assert len(y) == 1000
        assert np.argmax(np.abs(np.fft.rfft(y))) == 150


def test_student_tail():
    assert abs(dsp.t_sf(2.0, 10) - 0.036694) < 1e-6
    assert abs(dsp.t_sf(0.0, 5) - 0.5) < 1e-9
    assert abs(dsp.t_sf(-1.0, 3) - 0.804499) < 1e-6


def test_welch_matches_sine_power():
    f, p = dsp.welch(np.sin(2 * np.pi * 8 * np.arange(64) / 64), 64)
    assert np.argmax(p[0]) == 8 and abs(p[0].sum() - 0.5) < 1e-9


@pytest.mark.parametrize("segm,overlap", [(5, 0), (1, 0.5), (4, 2), (0.5, 0.25)])
def test_windows_match_naive(spark, segm, overlap):
    rng = np.random.default_rng(0)
    x = rng.normal(size=1000)
    x[100:150] = np.nan
    n, shift = timefeat.window_sizes(50, segm, overlap)
    got = {r["k"]: r for r in timefeat.windowed(rows(spark, x), 50, segm, overlap).collect()}
    assert len(got) == (len(x) - n) // shift + 1
    for k, r in got.items():
        w = x[k * shift : k * shift + n]
        inc, psi = np.abs(np.diff(w)), w[1:-1] ** 2 - w[:-2] * w[2:]
        assert abs(r["DATA_RATE"] - np.mean(~np.isnan(w))) < 1e-12
        for name, v, f in (("LINE_LENGTH", inc, np.nansum), ("TKEO_MEAN", psi, np.nanmean)):
            assert (r[name] is None) == bool(np.isnan(v).all())
            if r[name] is not None:
                assert abs(r[name] - f(v)) < 1e-9


def test_window_guards():
    for bad in ((0, 1, 0), (10, 0, 0), (10, 1, 1), (10, 1, -1)):
        with pytest.raises(ValueError):
            timefeat.window_sizes(*bad)


def test_data_rate_and_median(spark):
    x = rows(spark, [1, None, None, None, None])
    assert [r["x"] for r in quality.gate_data_rate(x, 0.5).orderBy("i").collect()] == [None] * 5
    got = quality.impute_median(rows(spark, [None, 4.0, 5, 6, None])).orderBy("i").collect()
    assert [r["x"] for r in got] == [5, 4, 5, 6, 5] and [r["was_null"] for r in got] == [True, False, False, False, True]


@pytest.mark.parametrize("band,f0", [((0.5, 4), 2), ((4, 8), 6), ((8, 12), 10)])
def test_waves_of_a_sine(band, f0):
    w = waves.detect(np.sin(2 * np.pi * f0 * np.arange(20 * 500) / 500), 500, band)
    assert abs(len(w["pk2pk"]) - 20 * f0) <= 2
    assert abs(np.median(w["pk2pk"]) - 2) < 0.02
    assert len(waves.detect(np.zeros(1000), 500, band)["pk2pk"]) == 0
    assert len(waves.detect(np.full(1000, np.nan), 500, band)["pk2pk"]) == 0


def sharp(rng, fs, seconds, events, noise):
    """Noise with triangles of (time, height) and 16 ms to a side, each followed by a shallow swing the other way."""
    x = rng.normal(0, noise, round(seconds * fs))
    t = np.arange(len(x)) / fs
    for at, height in events:
        x += height * np.maximum(0, 1 - np.abs(t - at) / 0.016) - 0.25 * height * np.exp(-0.5 * ((t - at - 0.045) / 0.012) ** 2)
    return x


def channels(spark, parts):
    rows = [(0, ch, first + i, float(v)) for ch, first, x in parts for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "rec long, ch int, i long, x double")


def test_halfwave_spikes_by_their_definition(spark):
    rng, fs, reach = np.random.default_rng(7), 400, 20
    events = {1: [(0.9, 500), (2.35, -450), (4.1, 650)], 4: [(1.5, -700), (3.3, 520)]}
    parts = [(ch, first, sharp(rng, fs, sec, [(t - first / fs, h) for t, h in events[ch]], 12)) for ch, first, sec in ((1, 0, 5.0), (4, 200, 3.5))]
    got = spikes.halfwave(channels(spark, parts), fs, total_amp=300, slope=3000, duration=0.006).collect()
    for ch, want in events.items():
        near = [(t, h) for t, h in want if any(r["channel"] == ch and abs(r["peak_time"] - t) < 0.01 and (r["peak_amp"] > 0) == (h > 0) for r in got)]
        assert near == want
    band = {ch: dsp.filtfilt(*dsp.butter(4, 80 / (fs / 2)), dsp.filtfilt(*dsp.butter(2, 1 / (fs / 2), "high"), x)) for ch, _, x in parts}
    level = np.median([np.abs(v).mean() for v in band.values()])
    for r in got:
        first = dict((ch, f) for ch, f, _ in parts)[r["channel"]]
        v, i = np.sign(r["peak_amp"]) * band[r["channel"]] * 70 / level, r["peak_index"] - first
        left, right = v[max(0, i - reach) : i], v[i : i + reach + 1]
        assert abs(v[i] - abs(r["peak_amp"])) < 1e-6 * abs(v[i])
        assert abs(r["left_amp"] - (v[i] - left.min())) < 1e-6 and abs(r["right_amp"] - (v[i] - right.min())) < 1e-6
        assert abs(r["left_dur"] - (len(left) - left.argmin()) / fs) < 1e-9 and abs(r["right_dur"] - right.argmin() / fs) < 1e-9
        assert r["left_slope"] > 3000 and r["right_slope"] > 3000 and r["total_amp"] > 300
    noise = channels(spark, [(0, 0, rng.normal(0, 12, 10 * fs))])
    assert spikes.halfwave(noise, fs).count() < 10
    spaced = spark.createDataFrame([(0, 0, i) for i in (1, 4, 9, 10, 30)], "rec int, ch int, i long")
    assert sorted(r["i"] for r in spikes._spaced(spaced, 8, ("rec", "ch")).collect()) == [1, 9, 30]


def test_halfwave_query_reads_whole_signals(spark):
    from neurolake.plans import catalog

    got = catalog.QUERIES["spikes_halfwave"](spark, "/root/testdata/sf0.01")
    assert got.where("peak_index >= 48").count() > 0


def bursts(rng, fs, seconds, times):
    t = np.arange(round(seconds * fs)) / fs
    return rng.normal(0, 12, len(t)) + sum(250 * np.maximum(0, 1 - np.abs(t - at) / 0.04) * np.sin(2 * np.pi * 27 * (t - at) + 0.4) for at in times)


@pytest.mark.parametrize("family,rate", [("cheby2", 200), ("butter", 200), ("fir", 200), ("cheby2", 250)])
def test_envelope_spikes_in_blocks_are_those_of_the_whole(spark, family, rate):
    rng, fs, times = np.random.default_rng(2), 250, (9.3, 22.8, 37.1, 51.6)
    x = bursts(rng, fs, 60, times)
    whole = spikes.envelope_events(x, fs, family=family, rate=rate)
    assert all(any(abs(e["pos"] - at) < 0.05 for e in whole) for at in times) and len(whole) < 15
    df = spark.createDataFrame([("a", 0, i, float(v)) for i, v in enumerate(x)], "rec string, ch int, i long, x double")
    got = spikes.envelope(df, fs, core_s=20, family=family, rate=rate).collect()
    strong = {round(e["pos"], 1) for e in whole if e["above"] > 20}
    assert strong == {round(r["pos"], 1) for r in got if r["above"] > 20} and len(strong) >= 4


def test_envelope_parts():
    x = np.array([0.0, 1.5, 4, 6.5, 9, 11])
    y = 2 - x + 0.5 * x**3
    at = np.linspace(0, 11, 50)
    assert np.abs(spikes._spline(x, y, at) - (2 - at + 0.5 * at**3)).max() < 1e-8
    assert dsp.cheby2_order(0.6, 0.7, 6, 60) >= 8 and dsp.cheby2_order(0.1, 0.05, 6, 60) >= 6
    env = np.array([0, 3, 5, 4, 0, 0, 6, 2, 0, 0, 0, 0, 0, 0, 0, 7, 8, 0], float)
    assert spikes._tops(env, np.full(18, 1.0), 4).tolist() == [6, 16] and spikes._tops(env, np.full(18, 1.0), 2).tolist() == [2, 6, 16]
    assert spikes._unite(env, np.array([2, 6, 16]), 5).tolist() == [6, 16]
    assert spikes.envelope_events(np.zeros(4000), 200) == []
    with pytest.raises(NotImplementedError):
        spikes.envelope_events(np.ones(4000), 200, beta=15.0)
    with pytest.raises(ValueError):
        spikes.envelope_events(np.ones(4000), 200, k2=1.0)


def test_discharges_of_channels(spark):
    e = spark.createDataFrame([("a", 0, 1.0, 1.0, 0.9, 0.1, 5.0), ("a", 2, 1.004, 0.5, 0.8, 0.3, 7.0), ("a", 0, 1.008, 0.5, 0.7, 0.2, 9.0), ("a", 1, 3.0, 1.0, 0.6, 0.4, 1.0)], "rec string, ch int, pos double, con double, weight double, pdf double, above double")
    got = {(r["event_id"], r["ch"]): (r["MV"], r["MA"], r["MW"], r["MPDF"], r["MP"], round(r["MD"], 6)) for r in spikes.discharges(e).collect()}
    assert got == {(0, 0): (1.0, 9.0, 0.9, 0.2, 1.0, 0.013), (0, 2): (0.5, 7.0, 0.8, 0.3, 1.004, 0.013), (1, 1): (1.0, 1.0, 0.6, 0.4, 3.0, 0.005)}
    some = spark.createDataFrame([("a", 0, 1.0, 1.0), ("a", 1, 1.005, 0.5), ("a", 1, 2.0, 0.5)], "rec string, ch int, pos double, con double")
    assert spikes.accept_ambiguous(some).count() == 2


def test_waves_at_the_ends_are_refined_in_what_is_there():
    fs, band = 100, (0.5, 4.0)
    h = round(fs / (2 * band[1]))
    x = np.cumsum(np.random.default_rng(1).normal(size=400))
    w = waves.detect(x, fs, band)
    steady = x - x.mean()
    steady = steady - dsp.bandpass_fft(steady, fs, 0, band[0])
    assert len(w["min_pos"]) and all(steady[i] <= steady[max(0, i - h) : i + 1].min() + 1e-9 or i < h for i in w["min_pos"][:1].astype(int))
    assert (w["max_pos"] < len(x)).all() and (w["min_pos"] >= 0).all()


def test_crp_finds_duration_and_artifacts():
    rng = np.random.default_rng(3)
    t = np.arange(500) / 1000
    shape = np.sin(2 * np.pi * 10 * t) * np.exp(-t / 0.08)
    v = 100 * shape[:, None] + rng.normal(0, 30, (500, 12))
    v[:, 3] = -300 * shape + rng.normal(0, 100, 500)
    got = evoked.parameterise(v, t, prune=True)
    assert 3 in got["rejected"] and 0.05 < got["tau_r"] < 0.4 and got["p_dur"] < 1e-6 and got["al"].sum() > 0


@pytest.mark.parametrize("k", [2, 3, 4, 5, 8, 11, 20])
def test_pairs_have_one_orientation(spark, k):
    df = spark.createDataFrame([(a, b, k) for a in range(k) for b in range(k) if a != b], "a int, b int, k int")
    got = {(r["a"], r["b"]) for r in df.where(evoked.selected(F.col("a"), F.col("b"), F.col("k"))).collect()}
    assert got == {(a, b) for a in range(k) for b in range(k) if a != b and evoked._stands(a, b, k)}
    assert len(got) == k * (k - 1) // 2 and all((b, a) not in got for a, b in got)


def test_running_scores_equal_whole(spark):
    df = spark.createDataFrame([(float(i * i % 17),) for i in range(40)], "v double")
    z = features.RunningZScore(["v"])
    for lo, hi in ((0, 5), (5, 9), (9, 17)):
        z.update(df.where(f"v >= {lo} and v < {hi}"))
    v = np.array([r[0] for r in df.collect()])
    n, m, s = z.state["v"]
    assert n == 40 and abs(m - v.mean()) < 1e-9 and abs(s - v.std()) < 1e-9


def test_pca_counts_components(spark):
    x = np.random.default_rng(4).normal(size=(300, 4)) * [10, 5, 0.5, 0.1]
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double, d double")
    assert features.PCA(list("abcd"), 0.98).fit(df).components.shape == (4, 2)


def test_markov_rows():
    t = classifiers.default_matrix()
    assert np.allclose(t.sum(axis=1), 1)
    s, q = classifiers.markov_step(0, np.array([0.9, 0.05, 0.05, 0, 0]), t)
    assert s == 0 and abs(q.sum() - 1) < 1e-9
    s, q = classifiers.markov_step(0, np.array([0.01, 0.97, 0.02, 0, 0]), t)
    assert s == 1 and abs(q.sum() - 1) < 1e-9
