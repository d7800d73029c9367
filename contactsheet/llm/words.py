"""Words of many texts at once, straight from the bytes of an Arrow column: no object for a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: Bytes with A-Z lower-cased.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Bytes of a word: all but space, tab, line feed, vertical tab, form feed and carriage return.
NOT_SPACE = ~np.isin(np.arange(256), [32, *range(9, 14)])
#: Words of more bytes than this are hashed one by one.
LONG = 64
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = x * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(30))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's texts in a row, and where each begins and the last one ends. Null texts are empty."""
    column = pc.fill_null(column, "")
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    starts = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def spans(data: np.ndarray, starts: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and how many words come before each text and in all. inside: by byte, whether it is of a word."""
    mask = inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = cut[:1] = cut[-1:] = True
    begin, end = mask.copy(), mask.copy()
    begin[1:] &= ~mask[:-1] | cut[1:-1]
    end[:-1] &= ~mask[1:] | cut[1:-1]
    begin = np.flatnonzero(begin)
    return begin, np.flatnonzero(end) + 1, np.searchsorted(begin, starts)


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, eight bytes at a time; words of one length up to eight bytes never share one."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - begin
    out = mix(size.astype(U) + U(0x9E3779B97F4A7C15))
    rows = np.arange(len(size))
    for k in range(0, LONG, 8):
        left = size[rows] - k
        out[rows] = mix(out[rows] ^ (eight[begin[rows] + k] & _KEEP[np.minimum(left, 8)]))
        rows = rows[left > 8]
        if not len(rows):
            break
    for i in rows:
        out[i] = xxhash.xxh64_intdigest(data[begin[i] : end[i]].tobytes())
    return out


def word_hashes(column: pa.Array, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a string column's texts with A-Z lower-cased, and how many words come before each text and in all."""
    data, starts = utf8(column)
    data = LOWER[data]
    begin, end, before = spans(data, starts, inside)
    return hashes(data, begin, end), before


class Lookup:
    """The places of hashes in a sorted array of distinct ones, by their first bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = U(64 - max(1, min(20, 4 * max(1, len(keys)).bit_length())))
        tops = np.arange((1 << int(64 - self.shift)) + 1, dtype=object)
        self.first = np.searchsorted(keys >> self.shift, tops.astype(np.int64).astype(U)).astype(np.int32)
        self.most = int(np.diff(self.first).max(initial=0))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted hash, -1 without one."""
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys):
            return out
        top = (wanted >> self.shift).astype(np.int64)
        first, last = self.first[top], self.first[top + 1]
        for k in range(self.most):
            at = np.minimum(first + k, len(self.keys) - 1)
            out = np.where((first + k < last) & (self.keys[at] == wanted), at, out)
        return out
