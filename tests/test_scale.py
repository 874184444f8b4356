"""Steps whose tasks hold few rows of a large class or recording."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from neurolake.functions import dsp, workers
from neurolake.operators import features, sleep, spikes


def test_rows_of_a_class_are_numbered_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(features, "NUMBERED", 5)
    values = [None, None, float("nan"), *[float(i * 7 % 23) for i in range(60)]]
    rows = [("ab"[i % 2] if i % 9 else None, v, i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "c string, v double, i int")
    got = {r["i"]: r["_r"] for r in features._numbered(df, "c", ["v", "i"]).collect()}
    key = lambda r: (r[1] is not None, r[1] is not None and r[1] != r[1], r[1] if r[1] is not None and r[1] == r[1] else 0, r[2])
    want = {r[2]: n for c in (None, "a", "b") for n, r in enumerate(sorted((r for r in rows if r[0] == c), key=key))}
    assert got == want
    text = features.balance(df.where("c is not null"), "c", ["v", "i"])._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(c#" not in text or "_g#" in text.split("row_number() windowspecdefinition(")[1].split(")")[0]


def test_night_score_is_one_pass(spark):
    hour = 3600 * 10**6
    marks = ["AWAKE", "N1", "N2", "REM", "AWAKE", "N2", "N3", "REM", "N2", "AWAKE", "AWAKE"]
    rows = [(rec, a, i * hour, (i + 1) * hour, 3600.0) for rec, part in ((1, marks), (2, ["AWAKE", "AWAKE"]), (3, ["N2", "AWAKE"])) for i, a in enumerate(part)]
    h = spark.createDataFrame(rows, "rec int, annotation string, start_us long, end_us long, duration double")
    out = sleep.night_score(h, 3600, 1800, 7200, 3600, 10, 1800)
    m = sleep.merge(h)
    on, off = sleep.sleep_onset(m, 3600, 1800), sleep.final_awakening(m, 7200, 3600, 10)
    night = m.join(on, "rec").join(off, "rec").where("start_us >= onset_us and start_us < awakening_us").drop("onset_us", "awakening_us")
    want = on.join(off, "rec").join(sleep.count_separated(night).withColumnRenamed("n", "rem_cycles"), "rec", "left").join(sleep.awakenings(night).withColumnRenamed("n", "awakenings"), "rec", "left")
    want = want.join(sleep.rem_latency(night, on), "rec", "left").join(sleep.stage_times(night, ["AWAKE", "N1", "N2", "N3", "REM"]), "rec", "left")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.select(out.columns).collect()))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_channels_of_one_length_are_filtered_in_step(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4, 70))
    for b, a in (dsp.butter(4, 0.3), dsp.butter(2, 0.05, "high"), dsp.cheby2(8, 60, 0.6), (np.ones(3) / 3, np.ones(1))):
        for n in (1, 2, 9, 70):
            assert (dsp.filtfilt(b, a, x[:, :n]) == np.stack([dsp.filtfilt(b, a, r[:n]) for r in x])).all()
    rows = [("r", ch, i + ch, float(x[ch % 4, i])) for ch, n in enumerate((70, 70, 30, 1, 70)) for i in range(n) if (ch, i) not in ((1, 5), (1, 6), (4, 0))]
    df = spark.createDataFrame([*rows, ("r", 9, 0, None)], "rec string, ch int, i long, x double")
    got = spikes._bands(df, 100.0, {"w": (5.0, 30.0)})
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    got = got.toPandas().sort_values(["ch", "i"])
    assert set(got["ch"]) == {0, 1, 2, 3, 4}
    high, low = dsp.butter(2, 0.1, "high"), dsp.butter(4, 0.6)
    for ch, g in got.groupby("ch"):
        i, v = (np.array([r[k] for r in rows if r[1] == ch]) for k in (2, 3))
        i = i.astype(int)
        at = np.arange(i.min(), i.max() + 1)
        assert (g["i"] == at).all() and (g["w"] == dsp.filtfilt(*low, dsp.filtfilt(*high, np.interp(at, i, v.astype(float))))).all()


def test_groups_are_whole_in_every_piece(spark):
    class Frame:
        """What groups() asks of a frame, without workers: its function is run here on given batches."""

        sparkSession = spark

        def repartition(self, *_):
            return self

        def sortWithinPartitions(self, *_):
            return self

        def mapInArrow(self, pieces, schema):
            return pieces

    keys = [k for k in (None, 0, 1, 2, 3, 4) for _ in range((k or 0) * 30 + 1)]
    t = pa.table({"k": pa.array(keys, "int32"), "i": pa.array(range(len(keys)), "int64")})
    for rows in (1, 40, 10**6):
        for piece in (1, 7, 1000):
            with pytest.MonkeyPatch.context() as m:
                m.setattr(workers, "ROWS", rows)
                run = lambda t, at: iter([(t["k"][int(a)].as_py(), int(b - a), set(t["k"].to_pylist()[a:b])) for a, b in zip(at, at[1:])])
                got = list(workers.groups(Frame(), ["k"], "i", run, "")(iter(t.to_batches(piece))))
            assert got == [(k, (k or 0) * 30 + 1, {k}) for k in (None, 0, 1, 2, 3, 4)]


def test_envelope_of_channels_in_step(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(5, 300)) + 8 * (np.abs(np.arange(300) - 150) < 3) * np.sin(np.arange(300))
    x[3] = 0
    each = [spikes.envelope_events(r, 200.0, window=0.1, step=0.05, k1=1.0) for r in x]
    assert spikes.envelope_events(x, 200.0, window=0.1, step=0.05, k1=1.0) == each and not each[3] and any(each)
    df = spark.createDataFrame([("a", ch, i, float(v)) for ch in range(5) for i, v in enumerate(x[ch])], "rec string, ch int, i long, x double")
    out = spikes.envelope(df, 200.0, core_s=10.0, window=0.1, step=0.05, k1=1.0)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    got = {(r["ch"], r["pos"]): r["above"] for r in out.collect()}
    assert got == {(ch, e["pos"]): e["above"] for ch, part in enumerate(each) for e in part}


def test_discharges_of_many_short_channels(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6, 420)) + 9 * (np.abs(np.arange(420) - 210) < 3) * np.sin(np.arange(420))
    df = spark.createDataFrame([(0, ch, i, float(v)) for ch in range(6) for i, v in enumerate(x[ch, : 420 - 3 * ch])], "rec int, ch int, i long, x double")
    e = spikes.envelope(df, 200.0, core_s=10.0, window=0.1, step=0.05, k1=0.6, k2=0.8)
    got = spikes.discharges(e).toPandas()
    assert "FlatMapGroupsInPandas" not in e._jdf.queryExecution().toString()
    assert len(got) and set(got["MV"]) <= {0.5, 1.0} and (abs(got["MP"] - 1.05) < 0.05).any()
