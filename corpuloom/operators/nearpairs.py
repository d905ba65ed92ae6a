"""The k nearest of many rows for many queries at a time, as products of matrices that are exact in their result.

Squared distances come from |x|^2 + |q|^2 - 2xq, whose rounding is bounded; what may be among a
query's k within that bound is worked out again term by term, as search.distance() does, so
that distances, their order and ties are those of the plain sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs that are worked out again at a time.
PAIRS = 1 << 16


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the keys of a and b are."""
    every = pc.dictionary_encode(pa.concat_arrays([a, b])).indices.to_numpy(zero_copy_only=False)
    return every[: len(a)], every[len(a) :]


def by_key(keys: pa.Array) -> np.ndarray:
    return pc.sort_indices(keys).to_numpy(zero_copy_only=False)


def plain(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of rows, summed term by term."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        d = x[:, j] - q[:, j]
        total += d * d
    return np.sqrt(total)


def nearest_pairs(q: np.ndarray, x: np.ndarray, barred: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, row of x and distance of the k nearest of each, ties by row of x; barred pairs (a mask) are left out.

    Rows that are not finite come last (NaN behind infinity).
    """
    with np.errstate(all="ignore"):
        square_q, square_x = (np.einsum("ij,ij->i", m, m) for m in (q, x))
        fine_q, fine_x = square_q < 1e300, square_x < 1e300
        square_q, square_x = np.where(fine_q, square_q, 0), np.where(fine_x, square_x, 0)
        near = square_x[None, :] + square_q[:, None] - 2 * (np.where(fine_q[:, None], q, 0) @ np.where(fine_x[:, None], x, 0).T)
        # Twice the rounding of a sum of products, of its norms and of the plain sum.
        slack = 8 * (q.shape[1] + 8) * np.finfo(np.float64).eps * (square_q + square_x.max(initial=0))
        near[:, ~fine_x] = np.inf
        if barred is not None:
            near[barred] = np.inf
        if k < len(x):
            last = np.partition(near, k - 1, 1)[:, k - 1]
            wanted = near <= (last + 2 * slack)[:, None]
        else:
            wanted = np.ones(near.shape, bool)
        wanted[:, ~fine_x] = True
        wanted[~fine_q] = True
        if barred is not None:
            wanted &= ~barred
        row, col = np.nonzero(wanted)
        far = np.concatenate([plain(q[row[i : i + PAIRS]], x[col[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)]) if len(row) else np.zeros(0)
    order = np.lexsort((col, far, row))
    row, col, far = row[order], col[order], far[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], col[kept], far[kept]
