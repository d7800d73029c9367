"""Arrays of numbers as compressed bytes, for shuffles between groups that ask and groups that answer."""

from __future__ import annotations

import numpy as np
import zstandard

U = np.uint64


def tally(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sum of n of each."""
    if not len(keys):
        return np.zeros(0, U), np.zeros(0, np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    return keys[new], np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(new))


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted keys go over from one bucket to the next; each bucket has a range of the 64-bit numbers."""
    return np.searchsorted(keys, np.array([(1 << 64) * b // buckets for b in range(1, buckets)], U))


def deflated(x: np.ndarray) -> bytes:
    """Whole numbers as their first bytes, then their second bytes and so on as far as there are any, compressed."""
    planes = np.ascontiguousarray(x.astype(U).view(np.uint8).reshape(-1, 8).T)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + zstandard.compress(planes[:width].tobytes(), 3)


def inflated(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view(U).ravel()
