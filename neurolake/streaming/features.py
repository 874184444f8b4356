"""Structured Streaming: windowed features, spike sessions, Markov states, running scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from neurolake.operators.classifiers import markov_step
from neurolake.operators.features import RunningZScore


def windowed_rates(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(rec, start, n, mean, energy) of event-time windows of a stream or table (rec, ts, x); rows later than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    got = events.withWatermark("ts", late).groupBy("rec", w.alias("w")).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.sum(F.col("x") * F.col("x")).alias("energy"))
    return got.select("rec", F.col("w.start").alias("start"), "n", "mean", "energy")


def spike_sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(rec, start, n, height): events closer than the gap make one session; its highest."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("rec", s.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("height")).select("rec", F.col("w.start").alias("start"), "n", "height")


def markov_stream(scores: DataFrame, states: list[str], t: np.ndarray, start: str = "AWAKE") -> DataFrame:
    """(rec, k, state) of a stream (rec, k, a score for each state): the state of each recording is kept between batches, whose rows come in order of k."""
    kind = scores.schema["rec"].dataType.simpleString()

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        s = held.get[0] if held.exists else states.index(start)
        p = pd.concat(list(parts)).sort_values("k")
        names = []
        for q in p[states].to_numpy(float):
            s, _ = markov_step(s, q, t)
            names.append(states[s])
        held.update((s,))
        yield pd.DataFrame({"rec": key[0], "k": p["k"].to_numpy(), "state": names})

    return scores.groupBy("rec").applyInPandasWithState(run, f"rec {kind}, k long, state string", "s int", "append", GroupStateTimeout.NoTimeout)


def running_zscore(stream: DataFrame, columns: list[str], sink: Callable[[DataFrame, int], None]):
    """A writer that scales each micro-batch by all rows so far and hands it to the sink."""
    z = RunningZScore(columns)
    return stream.writeStream.foreachBatch(lambda df, n: sink(z.update(df), n))
