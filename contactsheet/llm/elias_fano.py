"""Elias-Fano lists: nondecreasing whole numbers in about log2(universe / n) + 2 bits each, any of them found without decoding the rest.

A list's bytes are a head (n, low bits a number, bytes of the samples, of the low part), the place of every SAMPLE-th one in the high
part, the low bits in a row, and the high part: for each number a one, after as many zeros as its high bits grew since the last.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QBQQ")
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def encoded(values: np.ndarray) -> bytes:
    """The list of values, which don't decrease and aren't negative; it may be empty."""
    values = np.asarray(values, np.int64)
    n = len(values)
    if n and (values[0] < 0 or (np.diff(values) < 0).any()):
        raise ValueError("values must not decrease")
    low = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1) if n else 0
    at = (values >> low) + np.arange(n)
    ones = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
    ones[at] = 1
    lows = ((values[:, None] >> np.arange(low)) & 1).astype(np.uint8)
    samples = at[::SAMPLE].astype("<u8" if len(ones) >> 32 else "<u4").tobytes()
    packed = np.packbits(lows.ravel(), bitorder="little").tobytes()
    return _HEAD.pack(n, low | (128 if len(ones) >> 32 else 0), len(samples), len(packed)) + samples + packed + np.packbits(ones, bitorder="little").tobytes()


class EliasFano:
    """A list as encoded() gives it."""

    def __init__(self, data: bytes):
        self.n, kind, samples, lows = _HEAD.unpack_from(data)
        self.low, at = kind & 127, _HEAD.size
        self.samples = np.frombuffer(data, "<u8" if kind & 128 else "<u4", samples // (8 if kind & 128 else 4), at)
        self.lows = np.frombuffer(data, np.uint8, lows, at + samples)
        self.high = np.frombuffer(data, np.uint8, offset=at + samples + lows)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The i-th number, counted from 0: from the last sample before it, over bytes of the high part until the one is reached."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, inside = place >> 3, place & 7
        now = int(self.high[byte]) >> inside << inside  # the sampled one is the first that is left
        while left >= _ONES[now]:
            left -= int(_ONES[now])
            byte, now = byte + 1, int(self.high[byte + 1])
        for _ in range(left):
            now &= now - 1
        place = byte * 8 + (now & -now).bit_length() - 1
        bits = np.arange(i * self.low, (i + 1) * self.low)
        lows = (self.lows[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1
        return (place - i << self.low) | int((lows.astype(np.int64) << np.arange(self.low)).sum())

    def values(self) -> np.ndarray:
        """All numbers."""
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        lows = np.unpackbits(self.lows, count=self.n * self.low, bitorder="little").reshape(self.n, self.low).astype(np.int64)
        return ((at - np.arange(self.n)) << self.low) | (lows << np.arange(self.low)).sum(1)
