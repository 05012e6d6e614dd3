"""NumPy kernels that Arrow functions call on whole batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Scores within this of the k-th are scored again in index order, so ties are told apart exactly.
NEAR = 1e-9


def matrix(col: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """(rows, dim) doubles of a list column; all rows must have the same length and no nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros((0, dim or 0))
    if col.null_count:
        raise ValueError("a vector is null")
    values = col.flatten()
    lengths = np.diff(col.offsets.to_numpy())
    want = dim if dim is not None else int(lengths[0])
    if (lengths != want).any():
        raise ValueError(f"vectors of lengths {sorted(set(lengths.tolist()))} where {want} is expected")
    if values.null_count:
        raise ValueError("a component is null")
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), want)


def exact(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise scores of x and q, summed in index order as the JVM expressions do."""
    p = x * q if metric == "dot" else (x - q) * (x - q)
    return np.cumsum(p, axis=1)[:, -1] if p.shape[1] else np.zeros(len(p))


def rough(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(len(q), len(x)) scores by matrix product, larger is better."""
    s = q @ x.T
    return s if metric == "dot" else 2 * s - (x * x).sum(1)[None, :] - (q * q).sum(1)[:, None]


def shortlist(metric: str, x: np.ndarray, q: np.ndarray, k: int, near: float = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """(query rows, x rows) of all that may be among the best k of this block, by query."""
    if not len(x) or not len(q) or k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(invalid="ignore", over="ignore"):
        s = rough(metric, x, q)
        s[np.isnan(s)] = -np.inf
        if k >= s.shape[1]:
            return np.nonzero(np.ones_like(s, bool))
        floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        room = near * np.maximum(1.0, np.abs(np.where(np.isfinite(floor), floor, 0)))
        return np.nonzero(s >= (floor - room)[:, None])


def block_topk(metric: str, x: np.ndarray, q: np.ndarray, k: int, near: float = NEAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, x rows, exact scores) of the shortlist; scores that are no number are left out."""
    i, j = shortlist(metric, x, q, k, near)
    if not len(i):
        return i, j, np.zeros(0)
    with np.errstate(invalid="ignore", over="ignore"):
        v = exact(metric, x[j], q[i])
    ok = ~np.isnan(v)
    return i[ok], j[ok], v[ok]


def to_half(x: np.ndarray) -> np.ndarray:
    """IEEE half precision, halves to even."""
    with np.errstate(over="ignore"):
        return np.asarray(x, np.float32).astype("<f2")
