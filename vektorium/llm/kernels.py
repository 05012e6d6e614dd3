"""NumPy text kernels shared by the operators of this subpackage.

They run on the bytes of whole Arrow batches, never row by row. Words are the
maximal runs of bytes other than ``\\x20 \\x09-\\x0D``; UTF-8 continuation and
lead bytes are never in that set, so byte runs and code point runs agree.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import zstandard

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 1 << 20
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_tables: dict = {}


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not glibc
    _trim = None


def release() -> None:
    """Give memory that is free inside this Python worker back to the system; workers stay between tasks and would hold it.

    Taking it anew costs CPU time, so this is for the end of a task.
    """
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place on a uint64 array."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def _table(seed: int, n: int):
    """Random byte values, powers of an odd base and of its inverse modulo 2**64."""
    have = _tables.get(seed)
    if have is None or len(have[1]) < n:
        n = max(n, _STEP + 1)
        base = _ODD[seed % 2]
        rnd = np.random.default_rng(seed + 17).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
        have = _tables[seed] = (rnd, _powers(base, n), _powers(pow(base, -1, 1 << 64), n))
    return have


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64, starting at 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(offs):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def runs(data: np.ndarray, offs: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without break bytes, and each row's first run (one more entry than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~breaks[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offs[(offs > 0) & (offs < len(data))]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run's bytes, equal for equal runs wherever they stand."""
    out = np.empty(len(starts), U64)
    i, n = 0, len(starts)
    while i < n:
        low = starts[i]
        j = max(int(np.searchsorted(ends, low + _STEP, "right")), i + 1)
        high = ends[j - 1]
        rnd, up, down = _table(seed, int(high - low) + 1)
        part = rnd[data[low:high]]
        part *= up[: high - low]
        total = np.zeros(high - low + 1, U64)
        np.cumsum(part, out=total[1:])
        raw = total[ends[i:j] - low] - total[starts[i:j] - low]
        raw *= down[starts[i:j] - low]
        raw ^= (ends[i:j] - starts[i:j]).astype(U64) * U64(0xD6E8FEB86659FD93)
        out[i:j] = mix(raw)
        i = j
    return out


def window_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each n consecutive entries of h, by doubling; one for each start (empty if there are under n)."""
    base, mask = _ODD[seed % 2] ^ 0x5DEECE66C, (1 << 64) - 1
    if len(h) < n:
        return np.zeros(0, U64)
    done, acc, have, cur = 0, None, 1, h
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            if acc is None:
                acc = cur.copy()
            else:  # acc covers [0, done), cur covers `have` from done on
                m = min(len(acc), len(cur) - done)
                acc = acc[:m] + cur[done : done + m] * U64(pow(base, done, 1 << 64) & mask)
            done += have
        if n >> (bit + 1):
            cur = cur[: len(cur) - have] + cur[have:] * U64(pow(base, have, 1 << 64) & mask)
            have *= 2
    return mix(acc[: len(h) - n + 1].copy())


_zstd = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(x: np.ndarray) -> bytes:
    """Compress an integer array: byte planes under zstd, so that leading zero bytes cost nothing."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(-1, x.dtype.itemsize).T if len(x) else np.zeros(0, np.uint8)
    return _zstd[0].compress(planes.tobytes())


def unsqueeze(b: bytes, dtype) -> np.ndarray:
    """Inverse of squeeze."""
    raw = np.frombuffer(_zstd[1].decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def lookup(u: np.ndarray, x: np.ndarray, bits: int) -> np.ndarray:
    """Places of x in the sorted distinct hashes u of so many bits, which hold all of x; from a table of first bits on."""
    if not len(u):
        return np.zeros(len(x), np.int64)
    shift = np.uint64(max(0, bits - len(u).bit_length() - 1))
    first = np.searchsorted(u, np.arange(((1 << bits) - 1 >> int(shift)) + 1, dtype=np.uint64) << shift)
    at = first[(x >> shift).astype(np.int64)]
    open_ = np.flatnonzero(u[at] != x)
    while len(open_):
        at[open_] += 1
        open_ = open_[u[at[open_]] != x[open_]]
    return at


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct entries; sorting 64-bit integers is much faster than hashing them."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]
