"""Sums of gaussian kernels and nearest rows, in blocks: memory grows with the rows, not with their pairs."""

from __future__ import annotations

import numpy as np

#: distances that are held at once
BLOCK = 1 << 18


def _exponents(x: np.ndarray, k: np.ndarray, block: int):
    """Blocks (rows of x, rows of k, minus half their squared distances); block is the number of distances."""
    wide = max(1, min(len(k), 2048, block))
    high = max(1, block // wide)
    ones = np.ones((len(x), 1))
    left = np.concatenate([x, ones, -0.5 * (x * x).sum(axis=1, keepdims=True)], axis=1)
    right = np.concatenate([k, -0.5 * (k * k).sum(axis=1, keepdims=True), np.ones((len(k), 1))], axis=1).T
    for i in range(0, len(x), high):
        for j in range(0, len(k), wide):
            yield slice(i, i + high), slice(j, j + wide), np.minimum(left[i : i + high] @ right[:, j : j + wide], 0)


def sums(x: np.ndarray, k: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """At each row of x the sum of exp(-d^2 / 2) over its distances d to all rows of k."""
    out, centre = np.zeros(len(x)), k.mean(axis=0) if len(k) else 0.0
    for i, _, e in _exponents(x - centre, k - centre, block):
        out[i] += np.exp(e, out=e).sum(axis=1)
    return out


def log_sums(x: np.ndarray, k: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Logarithms of sums(), also where these are too small for a number."""
    if not len(k):
        return np.full(len(x), -np.inf)
    total = sums(x, k, block)
    far = ~(total > 1e-250)
    out = np.log(np.where(far, 1, total))
    if far.any():
        y, centre = x[far], k.mean(axis=0)
        top, rest = np.full(len(y), -np.inf), np.zeros(len(y))
        for i, _, e in _exponents(y - centre, k - centre, block):
            t = np.maximum(top[i], e.max(axis=1))
            rest[i] = rest[i] * np.exp(top[i] - t) + np.exp(e - t[:, None]).sum(axis=1)
            top[i] = t
        out[far] = top + np.log(rest)
    return out


def nearest(x: np.ndarray, k: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the k rows nearest to each row of x, itself left out; of equals those that come first.

    Rows are taken along the coordinate that spreads most. What lies outside of a stretch of it is further away than the stretch's ends, so a
    row is done once its k-th distance is less than that; until then its stretch grows, to all rows if need be. So the result is exact.
    """
    n, k = len(x), min(k, len(x) - 1)
    axis = int(np.argmax(x.std(axis=0)))
    order = np.argsort(x[:, axis], kind="stable")
    y = x[order]
    line = y[:, axis]
    places, found = np.empty((n, k), np.int64), np.empty((n, k))
    for at in range(0, n, 256):
        todo, reach = np.arange(at, min(at + 256, n)), 2 * k + 64
        while len(todo):
            lo, hi = max(0, todo[0] - reach), min(n, todo[-1] + 1 + reach)
            left = []
            step = max(1, block // (hi - lo))
            for a in range(0, len(todo), step):
                rows = todo[a : a + step]
                d = np.sqrt(sum(((y[rows, j][:, None] - y[None, lo:hi, j]) ** 2 for j in range(y.shape[1])), 0.0))
                d[np.arange(len(rows)), rows - lo] = np.inf
                far = np.partition(d, k - 1, axis=1)[:, k - 1]
                done = ((lo == 0) | (far < line[rows] - line[lo])) & ((hi == n) | (far < line[hi - 1] - line[rows]))
                left.append(rows[~done])
                rows, d, far = rows[done], d[done], far[done]
                inside = d <= far[:, None]
                plain = inside.sum(axis=1) == k
                if plain.any():
                    j = np.nonzero(inside[plain])[1].reshape(-1, k)
                    places[order[rows[plain]]], found[order[rows[plain]]] = order[lo + j], np.take_along_axis(d[plain], j, axis=1)
                for r in np.flatnonzero(~plain):
                    j = np.flatnonzero(inside[r])
                    j = j[np.lexsort((order[lo + j], d[r, j]))[:k]]
                    places[order[rows[r]]], found[order[rows[r]]] = order[lo + j], d[r, j]
            todo, reach = np.concatenate(left), 4 * reach
    return places, found


def local_outlier_factor(x: np.ndarray, k: int) -> np.ndarray:
    """The mean local reachability density of the k nearest rows over a row's own."""
    at, d = nearest(x, k)
    reach = np.maximum(d, d.max(axis=1)[at])
    lrd = 1 / (reach.mean(axis=1) + 1e-10)
    return lrd[at].mean(axis=1) / lrd
