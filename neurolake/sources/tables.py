"""The data model: sample rows, epoch arrays, hypnograms; and plain readers and writers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: how event types stand for sleep stages in the event table
STAGES = {"signup": "AWAKE", "view": "N1", "click": "N2", "purchase": "N3", "error": "REM"}


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where it isn't installed."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def read_features_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Epoch features from CSV with a header; empty cells are null, ids stay nullable integers."""
    return spark.read.csv(path, schema=schema, header=True)


def write_features_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def missing_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN is missing data: from here on it is null."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def samples(events: DataFrame, gap_every: int | None = None) -> DataFrame:
    """(rec, event_id, ts, i, x): events as one signal per user, numbered from 0 in time; every so many'th event id is missing."""
    x = F.col("value") if gap_every is None else F.when(F.col("event_id") % gap_every != 0, F.col("value"))
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("rec"), "event_id", "ts", (F.row_number().over(order) - 1).cast("long").alias("i"), x.alias("x"))


def epochs(embeddings: DataFrame) -> DataFrame:
    """(rec, label, x array<double>): each vector is an epoch."""
    return embeddings.select(F.col("vec_id").alias("rec"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def explode_epochs(epochs_: DataFrame) -> DataFrame:
    """Epochs as sample rows (rec, label, i, x)."""
    return epochs_.select("rec", "label", F.posexplode("x").alias("i", "x")).withColumn("i", F.col("i").cast("long"))


def micros(c: str | Column) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) if isinstance(c, str) else F.unix_micros(c.cast("timestamp"))


def hypnogram(events: DataFrame, drop_every: int | None = None) -> DataFrame:
    """(rec, event_id, annotation, start_us, end_us, duration): stages as intervals in microseconds; a recording's last event only ends one.

    drop_every: leaves out intervals of every so many'th event id, which opens gaps.
    """
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    stage = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])[F.col("event_type")]
    h = events.select(F.col("user_id").alias("rec"), "event_id", stage.alias("annotation"), micros("ts").alias("start_us"), F.lead(micros("ts")).over(order).alias("end_us")).where("end_us is not null")
    if drop_every:
        h = h.where(F.col("event_id") % drop_every != 0)
    return h.withColumn("duration", (F.col("end_us") - F.col("start_us")) / F.lit(1e6))


def rereference(samples_: DataFrame, target: str, against: list[str], gain: float = 1e6) -> DataFrame:
    """(rec, i, x): one channel less the mean of others, scaled; channels are rows (rec, ch, i, x) and meet on (rec, i)."""
    wide = samples_.where(F.col("ch").isin(target, *against)).groupBy("rec", "i").pivot("ch", [target, *against]).agg(F.first("x"))
    mean = sum((F.col(f"`{a}`") for a in against), F.lit(0.0)) / len(against)
    return wide.select("rec", "i", ((F.col(f"`{target}`") - mean) * gain).alias("x"))
