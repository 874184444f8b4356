"""DataFrame plumbing of the operators: column-adding Arrow maps, checkpoints, packed exchanges."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ready(spark: SparkSession) -> SparkSession:
    """Make workers find this package and give checkpoints a place; the cluster's spark.checkpoint.dir has precedence."""
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parents[2])
    known = sc.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="neurolake-checkpoints-"))
    return spark


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark keeps it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def trim() -> None:
    """Hands freed memory of this worker back; a worker lives on for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: how to let go of what this worker keeps for later tasks, by the operator that uses it
_kept: dict[str, Callable[[], object]] = {}


def keep(name: str, drop: Callable[[], object]) -> None:
    """Notes that this worker keeps something for later tasks of an operator, and how to let go of it."""
    _kept[name] = drop


def release(but: str | None = None) -> None:
    """Lets go of what this worker keeps, but for one operator; a worker lives on for tasks of others."""
    for name in [n for n in _kept if n != but]:
        _kept.pop(name)()


def trimmed(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn, and trim() once it has ended and its own arrays are gone. What is kept for tasks of other operators than keeps goes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keeps)
        yield from fn(batches)
        trim()

    return run


def cut(df: DataFrame) -> DataFrame:
    """The rows, materialised in the shared checkpoint folder; survives lost executors."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df less the columns whose names clash, as Spark compares them, with names about to be added."""
    clash = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in clash])


def add_columns(df: DataFrame, fields: list[tuple[str, str]], fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], keep: list[str] | None = None, keeps: str | None = None) -> DataFrame:
    """df with columns that fn makes of each Arrow batch, row by row. Clashing columns are replaced.

    keep: the columns of df to hand on; all of them by default. keeps: as of trimmed().
    """
    spark = ready(df.sparkSession)
    new = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))
    clash = {n.lower() for n, _ in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in clash]
    schema = T.StructType([df.schema[c] for c in kept] + list(new.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch)
            names = kept + [n for n, _ in fields]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + [made[n] for n, _ in fields], names=names)

    assert spark is not None
    return df.mapInArrow(trimmed(run, keeps), schema)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def runs(batches: Iterator[pa.RecordBatch], column: str, least_bytes: int = 4 << 20) -> Iterator[pa.Table]:
    """Tables of whole runs of a column by which the rows are sorted, of at least so many bytes but the last; the last run waits for the next batch."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = text_column(batch, column).to_numpy()
        other = np.flatnonzero(key != key[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if not cut and held and text_column(held[-1], column)[-1].as_py() != key[-1]:
            cut = -1  # the batch is the beginning of a run
        if cut and size + batch.nbytes >= least_bytes:
            whole = [*held, batch.slice(0, cut)] if cut > 0 else held
            yield pa.Table.from_batches(whole)
            held, size = [batch.slice(max(cut, 0))], 0
        else:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def in_pieces(member: DataFrame, keys: list[str], item: str, most: Column) -> DataFrame:
    """member with deal: the group (keys) of each item, and if that has more than most items, a pair of pieces of it.

    Any two items of a group meet under some deal, and no deal has much more than twice as many items as most says.
    """
    sizes = member.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_t", F.ceil(F.col("_n") / most)).where("_t > 1").select(*keys, "_t")
    sized = member.join(sizes, keys, "left").withColumn("_t", F.coalesce("_t", F.lit(1))).withColumn("_p", F.pmod(F.xxhash64(item), F.col("_t")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_t") - 1), lambda q: F.xxhash64(*keys, F.least("_p", q), F.greatest("_p", q)))
    return sized.withColumn("deal", F.explode(meets)).drop("_t", "_p")
