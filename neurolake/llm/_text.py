"""Vectorised text primitives shared by the operators.

Everything works on the raw UTF-8 buffer of an Arrow string column, so a batch of documents costs a fixed
number of NumPy passes instead of a Python step for each word. Texts are taken whole: work is cut into
chunks between documents only, and a document longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: bytes whose hashes are summed at once
HASH_BYTES = 1 << 15
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, hence invertible modulo 2**64
#: of a second, independent hash
SECOND = 0xA0761D6478BD642F
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(predicate: Callable[[int], bool]) -> np.ndarray:
    return np.array([predicate(i) for i in range(256)], dtype=bool)


#: letters, digits and every non-ASCII byte (after lower-casing): words of decontamination
ALNUM = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())
#: everything but ASCII white space: words of SimHash and of the language model
NONSPACE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) of runs of whole texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row) of the maximal runs of bytes in the class; runs end with their row."""
    n = len(buf)
    mask = table[buf]
    start, end = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    start[inner] = mask[inner]
    end[inner - 1] = mask[inner - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if size > 4 * CHUNK_BYTES:  # of a very long text: not kept
            return out
        _powers[name] = have = out
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit hash of each slice, equal for equal bytes: a polynomial from prefix sums, then mixed. base: odd; another one gives another hash."""
    n = len(buf)
    prefix = np.empty(n + 1, dtype=np.uint64)
    prefix[0] = 0
    power = _power(f"p{base}", base, n + 1)
    for k in range(0, n, HASH_BYTES):  # in parts that the processor's cache holds
        terms = prefix[k + 1 : min(k + HASH_BYTES, n) + 1]
        terms[:] = buf[k : k + HASH_BYTES]
        terms += np.uint64(1)
        terms *= power[k : k + HASH_BYTES][: len(terms)]
        terms[:1] += prefix[k : k + 1]
        np.cumsum(terms, out=terms)
    return mix((prefix[ends] - prefix[starts]) * _power(f"i{base}", pow(base, -1, 1 << 64), n + 1)[starts])


def hash_one(word: bytes) -> int:
    """word_hashes() of one word."""
    buf = np.frombuffer(word, dtype=np.uint8)
    return int(word_hashes(buf, np.array([0]), np.array([len(buf)]))[0])


def combine(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Hash of a pair; order matters."""
    return mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + g * _MULT + np.uint64(0x165667B19E3779F9))


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]; 0 for empty rows."""
    sums = np.cumsum(values)
    total = np.zeros(len(sums) + 1, sums.dtype)
    total[1:] = sums
    return total[first[1:]] - total[first[:-1]]


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from first items of rows."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each slice buf[start:end], all slices of equal lane count in step."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fixed values: the five primes of XXH64
    n = len(starts)
    out = np.empty(n, dtype=np.uint64)
    if not n:
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    u64 = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    u32 = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))

    def rotl(x: np.ndarray, r: int) -> np.ndarray:
        return (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    def lane(x: np.ndarray) -> np.ndarray:
        return rotl(x * p2, 31) * p1

    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        length = (ends - starts).astype(np.int64)
        h = np.full(n, s + p5, dtype=np.uint64)
        at = starts.astype(np.int64).copy()
        long = np.flatnonzero(length >= 32)
        if len(long):
            acc = [np.full(len(long), x, dtype=np.uint64) for x in (s + p1 + p2, s + p2, s, s - p1)]
            left = length[long] // 32
            act = np.arange(len(long))
            while len(act):
                pos = at[long[act]]
                for k in range(4):
                    acc[k][act] = rotl(acc[k][act] + u64[pos + 8 * k] * p2, 31) * p1
                at[long[act]] += 32
                left[act] -= 1
                act = act[left[act] > 0]
            v = rotl(acc[0], 1) + rotl(acc[1], 7) + rotl(acc[2], 12) + rotl(acc[3], 18)
            for k in range(4):
                v = (v ^ lane(acc[k])) * p1 + p4
            h[long] = v
        h += length.astype(np.uint64)
        rest = length % 32
        for k in range(3):
            act = np.flatnonzero(rest >= 8 * (k + 1))
            if len(act):
                h[act] = rotl(h[act] ^ lane(u64[at[act]]), 27) * p1 + p4
                at[act] += 8
        act = np.flatnonzero(rest % 8 >= 4)
        h[act] = rotl(h[act] ^ (u32[at[act]].astype(np.uint64) * p1), 23) * p2 + p3
        at[act] += 4
        for k in range(3):
            act = np.flatnonzero(rest % 4 > k)
            h[act] = rotl(h[act] ^ (padded[at[act]].astype(np.uint64) * p5), 11) * p1
            at[act] += 1
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        h ^= h >> np.uint64(32)
    return h


_spread = np.zeros(256, dtype=np.uint64)
for _bit in range(8):
    _spread |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_bit)) & np.uint64(1)) << np.uint64(8 * _bit)


def bit_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows, 64): in how many hashes of the row each bit is set. Eight 8-bit counters share a word, emptied every 255 hashes."""
    n_rows = len(first) - 1
    counts = np.zeros((n_rows, 64), dtype=np.int64)
    sizes = np.diff(first)
    pieces = (sizes + 254) // 255
    if not pieces.sum():
        return counts
    owner = np.repeat(np.arange(n_rows), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = first[:-1][owner] + 255 * nth
    full = np.flatnonzero(pieces)
    groups = (np.cumsum(pieces) - pieces)[full]
    octets = h.view(np.uint8).reshape(-1, 8)
    last = int(first[-1])
    for k in range(8):
        packed = np.add.reduceat(_spread[octets[:last, k]], at)
        lanes = packed.view(np.uint8).reshape(-1, 8)
        counts[full, 8 * k : 8 * k + 8] = np.add.reduceat(lanes.astype(np.int64), groups, axis=0)
    return counts


def majority(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash: bit b is set where it is set in over half of the row's hashes."""
    bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)
