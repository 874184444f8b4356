"""Hamming neighbours among 64-bit fingerprints, and connected components of links.

Candidates come from pigeonhole blocks: fingerprints that differ in at most ``radius`` = 3 bits agree in at
least one of four 16-bit blocks. Inside a block, many distances are updated at once on vertical bit planes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurolake.llm import _frames

#: pairs of runs up to this length are compared by shifts of all runs at once, of longer ones by tiles of each
SHIFT_RUN = 120
#: runs over this are first cut by further blocks of the other bits
FINE_RUN = 16_384
#: fingerprints compared with a whole run at once
TILE = 256


class Forest:
    """Union-find over dense indices; the smaller index is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def roots(self, x: np.ndarray) -> np.ndarray:
        at = self.up[x]
        while True:
            above = self.up[at]
            if np.array_equal(above, at):
                self.up[x] = at
                return at
            at = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Adds links, whole arrays at a time."""
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            open_ = ra != rb
            a, b = ra[open_], rb[open_]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def planes_of(fp: np.ndarray) -> np.ndarray:
    """(64, bytes): bit plane j holds bit j of all fingerprints, eight to a byte."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")


def within(planes: np.ndarray, others: np.ndarray, radius: int, out: np.ndarray, skip: int = -1) -> np.ndarray | None:
    """Packed mask of the positions whose distance is at most radius (0 to 3); None if there is none.

    planes, others: bit planes along the first axis, (64, 1 or q, m) and (64, q, 1 or m). out: packed (q, m) mask of positions that
    are not to be compared; skip: a 16-bit block in which all agree. A carry-save counter of two bits and an overflow bit stands
    for every position. Blocks of eight positions are abandoned once all of them exceed the radius: after 16 planes, and again
    after every eight more, only blocks with a position left are carried on, if they are few.
    """
    order = [j for j in range(64) if j // 16 != skip]

    def differing(js: list[int], q: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(planes, blocks): where the chosen blocks of eight positions differ."""
        p, o = planes[js], others[js]
        return p[:, q if p.shape[1] > 1 else 0, b] ^ o[:, q, b if o.shape[2] > 1 else 0]

    q = b = apart = None
    asked = out != 255
    if 16 * np.count_nonzero(asked) < asked.size:
        q, b = np.nonzero(asked)
        over, apart, base = out[asked], differing(order, q, b), 0
    else:
        over = out.copy()
    ones, twos, x, carry = np.zeros_like(over), np.zeros_like(over), np.empty_like(over), np.empty_like(over)
    for n, j in enumerate(order, 1):
        if apart is None:
            np.bitwise_xor(planes[j], others[j], out=x)
        else:
            x = apart[n - 1 - base]
        np.bitwise_and(ones, x, out=carry)
        ones ^= x
        np.bitwise_and(twos, carry, out=x)
        over |= x
        twos ^= carry
        if n % 8 == 0 and 16 <= n < len(order):
            left = over != 255
            alive = np.count_nonzero(left)
            if not alive:
                return None
            if 16 * alive < left.size:
                if apart is None:
                    q, b = np.nonzero(left)
                    apart = differing(order[n:], q, b)
                else:
                    q, b, apart = q[left], b[left], apart[n - base :, left]
                base = n
                over, ones, twos = over[left], ones[left], twos[left]
                carry = np.empty_like(over)
    if radius == 2:
        over |= ones & twos
    elif radius == 1:
        over |= twos
    elif radius == 0:
        over |= twos | ones
    if apart is None:
        return ~over
    near = np.zeros_like(out)
    near[q, b] = ~over
    return near


def _set_bits(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every set bit of packed rows; only bytes that hold one are unpacked."""
    q, b = np.nonzero(packed)
    i, bit = np.nonzero(np.unpackbits(packed[q, b][:, None], axis=1, bitorder="little"))
    return q[i], 8 * b[i] + bit


def run_links(fp: np.ndarray, run: np.ndarray, radius: int, skip: int = -1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius among fingerprints of the same run; runs are contiguous and numbered from 0. All pairs are compared. skip: a block in which runs agree."""
    if len(fp) < 2:
        return
    length = np.bincount(run)
    size = length[run]
    for least, most in ((2, 8), (9, 20), (21, 48), (49, SHIFT_RUN)):
        at = np.flatnonzero((size >= least) & (size <= most))
        if len(at) < 2:
            continue
        f, r = fp[at], run[at]
        shifted = [planes_of(f)]
        for k in range(1, 8):
            moved = shifted[0] >> np.uint8(k)
            moved[:, :-1] |= shifted[0][:, 1:] << np.uint8(8 - k)
            shifted.append(moved)
        for s in range(1, int(size[at].max())):
            n = len(f) - s
            same = r[:n] == r[s:]
            if not same.any():
                break
            q, k = divmod(s, 8)
            m = (n + 7) // 8
            near = within(shifted[0][:, None, :m], shifted[k][:, None, q : q + m], radius, ~np.packbits(same, bitorder="little")[None], skip)
            if near is not None:
                hit = _set_bits(near)[1]
                yield at[hit], at[hit + s]
    first = np.concatenate([[0], np.cumsum(length)])
    for r in np.flatnonzero(length > SHIFT_RUN).tolist():
        f = fp[first[r] : first[r + 1]]
        planes = planes_of(f)
        for q in range(0, len(f), TILE):
            asked = f[q : q + TILE]
            bits = np.unpackbits(asked.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T * np.uint8(255)
            # from the tile on; within it a pair is compared from its smaller index
            lane = q // 8
            n = len(f) - 8 * lane
            out = np.zeros((len(asked), planes.shape[1] - lane), np.uint8)
            out[:, -1] = ~np.packbits(np.ones(n - 8 * (out.shape[1] - 1), bool), bitorder="little")[0]
            square = np.packbits(np.tri(len(asked), dtype=bool), axis=1, bitorder="little")
            out[:, : square.shape[1]] |= square
            near = within(planes[:, None, lane:], bits[:, :, None], radius, out, skip)
            if near is not None:
                i, j = _set_bits(near)
                yield first[r] + q + i, first[r] + q + j


def _runs(key: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])


def _sub_keys(fp: np.ndarray, block: int, parts: int) -> Iterator[np.ndarray]:
    """Keys of which close fingerprints that agree in the block share at least one: the other 48 bits in parts, 3 of which may differ."""
    low = fp & np.uint64((1 << (16 * block)) - 1)
    high = (fp >> np.uint64(16 * block + 16)) << np.uint64(16 * block) if block < 3 else np.zeros_like(fp)
    rest = low | high
    width = 48 // parts
    for same in combinations(range(parts), parts - 3):
        mask = sum(((1 << width) - 1) << (width * i) for i in same)
        yield rest & np.uint64(mask)


def bucket_links(fp: np.ndarray, block: int, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root) of the links among distinct fingerprints that agree in the block."""
    fp = np.sort(fp)
    fp = fp[np.concatenate([[True], fp[1:] != fp[:-1]])] if len(fp) else fp
    if len(fp) < 2:
        return fp[:0], fp[:0]
    forest = Forest(len(fp))
    key = (fp >> np.uint64(16 * block)) & np.uint64(0xFFFF)
    order = np.argsort(key, kind="stable")
    run = _runs(key[order])
    size = np.bincount(run)[run]

    def compare(at: np.ndarray, runs: np.ndarray) -> None:
        for a, b in run_links(fp[at], runs, radius, block):
            forest.join(at[a], at[b])

    few = size <= FINE_RUN
    compare(order[few], np.unique(run[few], return_inverse=True)[1])
    if not few.all():
        at, outer = order[~few], run[~few]
        for sub in _sub_keys(fp[at], block, 8):
            o = np.lexsort((sub, outer))
            r = np.cumsum(np.concatenate([[True], (sub[o][1:] != sub[o][:-1]) | (outer[o][1:] != outer[o][:-1])])) - 1
            compare(at[o], r)
    root = forest.roots(np.arange(len(fp)))
    child = np.flatnonzero(root != np.arange(len(fp)))
    return fp[child], fp[root[child]]


def hamming_links(fps: DataFrame, radius: int = 3, buckets: int | None = None) -> DataFrame:
    """(a long, b long): links, a spanning forest per block bucket, of all fingerprints in column fp that differ in at most radius bits.

    Every pair within the radius is connected by the links together; no pair outside it is linked directly. Fingerprints
    travel packed, 8 bytes for each of the four blocks. Nulls are ignored, repeated ones count once, an empty table has no links.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3")
    spark = _frames.ready(fps.sparkSession)
    n = buckets or _frames.partitions(spark)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            fp = np.unique(np.concatenate(held))
            held.clear()
            keys, loads = [], []
            for block in range(4):
                part = (((fp >> np.uint64(16 * block)) & np.uint64(0xFFFF)) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(n)
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order])) + 1
                for piece in np.split(order, cuts):
                    if len(piece):
                        keys.append(block * n + int(part[piece[0]]))
                        loads.append(fp[piece].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(loads, pa.binary())], names=["k", "load"])

        for batch in batches:
            held.append(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if sum(map(len, held)) > 1 << 20:
                yield from flush()
        yield from flush()

    def link(group: pa.Table) -> pa.Table:
        block = group.column("k")[0].as_py() // n
        fp = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("load").to_pylist()])
        a, b = bucket_links(fp, block, radius)
        _frames.trim()
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return fps.select(F.col("fp").cast("long")).mapInArrow(deal, "k int, load binary").groupBy("k").applyInArrow(link, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (a, b). Nodes are of any ordered type.

    Rounds of contraction: every node goes to the least of itself and its neighbours, and on, by doubled steps, to where that leads;
    edges are drawn between what their ends went to, and those within one node vanish. Each round at least halves the nodes, and
    links that are stars, as the bucket-wise linkers hand on, vanish in one or two. Aggregates combine map-side, so a hub is not held in a task.
    """
    _frames.ready(edges.sparkSession)
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    labels = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to"))
        to = _frames.cut(to)
        while True:
            on = to.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
            on = _frames.cut(to.join(on, F.col("to") == F.col("_n")).select("node", F.col("_t").alias("to"), (F.col("_t") != F.col("to")).alias("moved")))
            to = on.select("node", "to")
            if on.where("moved").isEmpty():
                break
        labels = to.select("node", F.col("to").alias("component")) if labels is None else labels.join(to.select(F.col("node").alias("_n"), "to"), F.col("component") == F.col("_n"), "left").select("node", F.coalesce("to", "component").alias("component"))
        end = lambda c: e.join(to.select(F.col("node").alias("_n"), F.col("to").alias("_t")), F.col(c) == F.col("_n"))
        e = end("a").select(F.col("_t").alias("a"), "b")
        e = _frames.cut(end("b").select("a", F.col("_t").alias("b")).where("a <> b").distinct())
        if e.isEmpty():
            return labels
        labels = _frames.cut(labels)
