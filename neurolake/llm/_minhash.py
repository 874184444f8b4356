"""MinHash bands: candidates among sets of 64-bit hashes, and their exact Jaccard clusters.

Two sets of Jaccard s share a minimum with chance s, and a band of ``rows`` minima with chance s^rows; they become candidates
if they agree in any of ``bands`` bands. With 30 bands of 5, 0.8 is missed with chance (1 - 0.8^5)^30 = 7e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from neurolake.llm import _frames, _text

BANDS = 30
ROWS = 5
#: keys of a band in a group of its key space, about
GROUP_ROWS = 1 << 17


def distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in order, and the first of each row."""
    row = _text.rows_of(first)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[fresh], np.searchsorted(row[fresh], np.arange(len(first)))


def nodes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash of each row's set of distinct hashes."""
    return _text.mix(_text.row_sums(_text.mix(h), first).astype(np.uint64) + np.diff(first).astype(np.uint64))


def band_keys(h: np.ndarray, first: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(rows of first, bands): a hash of each band's minima; 0 for empty rows."""
    out = np.zeros((len(first) - 1, bands), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    at = first[:-1][full]
    low = (h >> np.uint64(32)).astype(np.uint32)
    seeds = np.random.default_rng(11).integers(1, 1 << 32, (bands, rows, 2), dtype=np.uint32) | np.uint32(1)
    for b in range(bands):
        key = np.full(len(full), b, np.uint64)
        for s, a in seeds[b]:
            x = (low ^ s) * a
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            key = _text.mix(key + np.uint64(0x9E3779B97F4A7C15) * (np.minimum.reduceat(x, at).astype(np.uint64) + np.uint64(1)))
        out[full, b] = key
    return out


def candidate_edges(sets: DataFrame, bands: int = BANDS) -> DataFrame:
    """(a long, b long) of (node long, keys binary): every node that shares a band with others is linked to the least of them.

    Nodes travel packed, 16 bytes for each band; a group holds one band's keys of a share of the key space.
    """
    _frames.ready(sets.sparkSession)
    parts = 1 + sets.count() // GROUP_ROWS

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = np.concatenate(held)
            held.clear()
            ks, loads = [], []
            for b in range(bands):
                pair = np.ascontiguousarray(rows[:, [0, b + 1]])
                part = pair[:, 1] % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                for piece in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    ks.append(b * parts + int(part[piece[0]]))
                    loads.append(pair[piece].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(loads, pa.binary())], names=["k", "load"])

        for batch in batches:
            if batch.num_rows:
                node = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, bands)
                held.append(np.column_stack([node, keys]))
            if sum(map(len, held)) > 1 << 16:
                yield from flush()
        yield from flush()

    def link(group: pa.Table) -> pa.Table:
        pair = np.frombuffer(b"".join(group.column("load").to_pylist()), np.uint64).reshape(-1, 2)
        node, key = pair[:, 0].view(np.int64), pair[:, 1]
        order = np.argsort(key, kind="stable")
        node, key = node[order], key[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        head = np.repeat(np.minimum.reduceat(node, start), np.diff(np.append(start, len(key))))
        apart = node != head
        out = pa.table({"a": node[apart], "b": head[apart]})
        _frames.trim()
        return out

    return sets.select("node", "keys").mapInArrow(deal, "k int, load binary").groupBy("k").applyInArrow(link, "a long, b long")


def clusters(sets: list[np.ndarray], least: float) -> np.ndarray:
    """The cluster of each set: sets of Jaccard at least so much are linked, exactly; named by their first set.

    A set is compared with those not yet reached only, through lists of who holds a hash, so a cluster of close sets takes few comparisons.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    values = np.unique(np.concatenate(sets), return_inverse=True)[1] if size.sum() else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(n), size)
    out = np.full(n, -1)

    def index() -> tuple[np.ndarray, np.ndarray]:
        open_ = np.flatnonzero(out[owner] < 0)
        order = open_[np.argsort(values[open_], kind="stable")]
        return owner[order], np.concatenate([[0], np.cumsum(np.bincount(values[order], minlength=int(values.max(initial=-1)) + 1))])

    holders, at = index()
    left = indexed = n
    for root in range(n):
        if out[root] >= 0:
            continue
        out[root] = root
        left -= 1
        todo = [root]
        while todo and left:
            i = todo.pop()
            if 2 * left < indexed:
                holders, at = index()
                indexed = left
            mine = values[first[i] : first[i + 1]]
            count = at[mine + 1] - at[mine]
            hit = holders[np.repeat(at[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            who, both = np.unique(hit, return_counts=True)
            near = who[(both >= least * (size[i] + size[who] - both) - 1e-9) & (out[who] < 0)]
            out[near] = root
            left -= len(near)
            todo += near.tolist()
    return out
