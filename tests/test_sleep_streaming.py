"""A hand-made night, and streams that agree with tables."""

from __future__ import annotations

import pytest

from neurolake.operators import classifiers, sleep
from neurolake.streaming import features as streaming

NIGHT = [("AWAKE", 0, 600), ("N1", 600, 900), ("N2", 900, 2700), ("N3", 2700, 4500), ("REM", 4500, 5100), ("AWAKE", 5100, 5130), ("REM", 5130, 5400), ("N2", 5430, 7200), ("AWAKE", 7200, 13200)]


@pytest.fixture(scope="module")
def night(spark):
    return spark.createDataFrame([("a", s, a * 10**6, b * 10**6, float(b - a)) for s, a, b in NIGHT], "rec string, annotation string, start_us long, end_us long, duration double")


def test_night(night):
    assert sleep.sleep_onset(night).head()["onset_us"] == 600 * 10**6
    assert sleep.final_awakening(night).head()["awakening_us"] == 7200 * 10**6
    assert sleep.is_complete(night).head()["complete"]
    assert sleep.awakenings(night).head()["n"] == 3  # the AWAKE before the first sleep counts too
    assert sleep.count_separated(night, ("REM",), 1800).head()["n"] == 1
    assert sleep.stage_times(night, ["N2", "REM"]).head()[1:] == (3570.0, 870.0)
    r = sleep.rem_latency(night).head()
    assert (r["from_onset_s"], r["from_awake_s"]) == (3900.0, 3900.0)


def test_gaps(night):
    rows = sleep.fill_sleep(night, 60).orderBy("start_us").collect()
    assert [(r["annotation"], r["start_us"]) for r in rows if r["annotation"] == "SLP"] == [("SLP", 5400 * 10**6)]
    assert sleep.correct(night).where("annotation = 'SLP'").count() == 1
    changed = sleep.correct_rem(night, 30).orderBy("start_us").collect()
    assert [r["annotation"] for r in changed][6] == "AWAKE" and len(changed) == len(NIGHT)


def test_transitions(night):
    m = {(r["from_state"], r["to_state"]): r["p"] for r in sleep.transition_matrix(sleep.transition_counts(night, ["AWAKE", "N2", "REM"])).collect()}
    assert m[("AWAKE", "REM")] == 1.0 and m[("REM", "AWAKE")] == 0.5 and m[("N2", "REM")] == 0.0


def test_stream_equals_table(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, 1_700_000_000 + 60 * i, float(i)) for i in range(200)], "rec long, s long, x double").selectExpr("rec", "timestamp_seconds(s) AS ts", "x")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming.windowed_rates(stream, "10 minutes").writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = {(r["rec"], r["start"]): (r["n"], r["energy"]) for r in streaming.windowed_rates(df, "10 minutes").collect()}
    assert {(r["rec"], r["start"]): (r["n"], r["energy"]) for r in spark.table("rates").collect()} == want
    assert streaming.spike_sessions(df, "4 minutes").count() == 3


def test_markov_stream(spark, tmp_path):
    states = classifiers.STATES
    rows = [("a", k, *[0.92 if s == ("N2" if k > 3 else "AWAKE") else 0.02 for s in states]) for k in range(8)]
    df = spark.createDataFrame(rows, "rec string, k long, " + ", ".join(f"{s} double" for s in states))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming.markov_stream(stream, states, classifiers.persistent_matrix()).writeStream.format("memory").queryName("states").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {(r["k"], r["state"]) for r in classifiers.markov_decode(df, ["rec"], "k", states, classifiers.persistent_matrix()).collect()}
    assert {(r["k"], r["state"]) for r in spark.table("states").collect()} == want


def test_running_scores_of_a_stream(spark, tmp_path):
    from neurolake.streaming import features as streaming

    for k in range(3):
        spark.createDataFrame([(float(v + 10 * k),) for v in range(4)], "v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    source = spark.readStream.schema("v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = streaming.running_zscore(source, ["v"], lambda df, n: got.append([r["v"] for r in df.collect()]))
    query = writer.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(60)
    assert query.exception() is None and len(got) == 3 and all(len(g) == 4 for g in got)
    assert abs(sum(got[0])) < 1e-9 and not abs(sum(got[1])) < 1e-9
