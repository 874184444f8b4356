"""Python workers: how many tasks they get where work outgrows rows, and their memory, as they live on for tasks of other queries."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def trim() -> None:
    """Hands what this worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tasks(spark: SparkSession) -> int:
    """Tasks for work that grows faster than its rows, which adaptive execution would put into few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


#: rows that a task of groups() gathers before it works on the groups that are whole
ROWS = 1 << 20


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows whose keys aren't those of the row before."""
    fresh = np.zeros(max(t.num_rows - 1, 0), bool)
    for k in keys:
        c = t[k].combine_chunks()
        a, b = c[:-1], c[1:]
        fresh |= pc.fill_null(pc.not_equal(a, b), pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(fresh) + 1]) if t.num_rows else np.zeros(0, np.int64)


def groups(df: DataFrame, keys: list[str], order: str, run: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What run makes of many groups at once: rows sorted by keys and order, and the bounds of the groups among them.

    For small groups, where a call for each would cost more than the work. A group is never split, however long.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, limit = [], 0, ROWS
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= limit:
                t = pa.Table.from_batches(held)
                at = _starts(t, keys)
                if at[-1]:
                    yield from run(t[: at[-1]], at)
                    held = [x for x in t[at[-1] :].to_batches() if x.num_rows]
                n = sum(x.num_rows for x in held)
                limit = max(ROWS, 2 * n)
        if n:
            t = pa.Table.from_batches(held)
            yield from run(t, np.concatenate([_starts(t, keys), [n]]))

    return df.repartition(tasks(df.sparkSession), *keys).sortWithinPartitions(*keys, order).mapInArrow(pieces, schema)


def equal_sizes(bounds: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(groups, the places of their rows): groups of one size together, so many that they have about that many rows."""
    sizes = np.diff(bounds)
    for s in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == s)
        step = min(2048, max(1, most // max(s, 1)))
        for a in range(0, len(of), step):
            yield of[a : a + step], bounds[of[a : a + step]][:, None] + np.arange(s)
