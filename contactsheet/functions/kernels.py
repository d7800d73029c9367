"""Numeric kernels of one grey image, and the ladders that turn their signals into scores.

A kernel takes a two-dimensional array of 0 to 255. signals() runs them over a table in Arrow batches; what follows is expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def laplacian(g: np.ndarray) -> np.ndarray:
    p = np.pad(g.astype(float), 1, mode="reflect") if min(g.shape) > 1 else np.pad(g.astype(float), 1, mode="edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def zone_variance(g: np.ndarray, zones: int = 5) -> tuple[float, bool]:
    """The best variance of the Laplacian over a grid of zones; over the whole image, and True, if a zone's side is under 10 pixels."""
    h, w = g.shape
    if h // zones < 10 or w // zones < 10:
        return float(laplacian(g).var()), True
    return max(float(laplacian(g[r * (h // zones) : (r + 1) * (h // zones), c * (w // zones) : (c + 1) * (w // zones)]).var()) for r in range(zones) for c in range(zones)), False


def edge_fraction(g: np.ndarray) -> float:
    """The share of pixels on edges."""
    return float(edge_mask(g).mean())


def edge_mask(g: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Which pixels are on edges: thin gradient ridges over high, and those over low that touch them."""
    p = np.pad(g.astype(float), 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    m = np.abs(gx) + np.abs(gy)
    q = np.pad(m, 1)
    flat = np.abs(gx) >= np.abs(gy)
    ridge = np.where(flat, (m >= q[1:-1, :-2]) & (m > q[1:-1, 2:]), (m >= q[:-2, 1:-1]) & (m > q[2:, 1:-1]))
    edge, weak = ridge & (m > high), ridge & (m > low)
    while True:
        e = np.pad(edge, 1)
        near = np.zeros_like(edge)
        for y in range(3):
            for x in range(3):
                near |= e[y : y + edge.shape[0], x : x + edge.shape[1]]
        grown = near & weak
        if (grown == edge).all():
            return edge
        edge = grown | edge


def frequency_ratio(g: np.ndarray) -> float | None:
    """The sum of the high over that of the low magnitudes of the spectrum; None without low energy."""
    h, w = g.shape
    m = np.abs(np.fft.fftshift(np.fft.fft2(g.astype(float))))
    r = int(0.2 * min(h // 2, w // 2))
    y, x = np.ogrid[:h, :w]
    low = (y - h // 2) ** 2 + (x - w // 2) ** 2 <= r * r
    total = float(m[low].sum())
    return float(m[~low].sum()) / total if total > 0 else None


def area_resize(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """SRC-07. The mean of the part of g that each of height x width pixels covers, borders weighed by what lies inside.

    From a summed-area table read between its entries, so that each pixel costs the same whatever it covers.
    """
    s = np.pad(g.astype(float), ((1, 0), (1, 0))).cumsum(0).cumsum(1)

    def at(table: np.ndarray, n: int) -> np.ndarray:
        edges = np.linspace(0, table.shape[0] - 1, n + 1)
        low = np.minimum(edges.astype(int), table.shape[0] - 2)
        return table[low] + (edges - low)[:, None] * (table[low + 1] - table[low])

    sums = np.diff(np.diff(at(at(s, height).T, width).T, axis=0), axis=1)
    return sums / (g.shape[0] / height * (g.shape[1] / width))


def fitted(g: np.ndarray, side: int) -> np.ndarray:
    """SRC-07. g with its longer side reduced to side, as whole numbers; a smaller picture stays."""
    scale = side / max(g.shape)
    return g if scale >= 1 else np.rint(area_resize(g, max(1, round(g.shape[0] * scale)), max(1, round(g.shape[1] * scale)))).astype(np.uint8)


def perceptual_hash(g: np.ndarray) -> int:
    """UDF-08. 64 bits: which of the 8 x 8 lowest cosine coefficients of a 32 x 32 reduction are over their median. As a signed long."""
    n = 32
    small = area_resize(g, n, n)
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:8, None] / (2 * n))
    low = basis @ small @ basis.T
    bits = (low > np.median(low)).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def cull_signals(g: np.ndarray) -> dict:
    hist = np.cumsum(np.bincount(g.ravel().astype(np.int64), minlength=256)) / g.size
    variance, whole = zone_variance(g)
    return {
        "std": float(g.std()),
        "zone_variance": variance,
        "whole_zone": whole,
        "edge_fraction": edge_fraction(g),
        "frequency": frequency_ratio(g),
        "highlight_pct": float((g >= 250).mean() * 100),
        "shadow_pct": float((g <= 5).mean() * 100),
        "tonal_range": float(np.searchsorted(hist, 0.99) - np.searchsorted(hist, 0.01)),
        "noise_level": float(np.median(np.abs(laplacian(g))) * 1.4826),
        "phash": perceptual_hash(g),
    }


SIGNALS = "std double, zone_variance double, whole_zone boolean, edge_fraction double, frequency double, highlight_pct double, shadow_pct double, tonal_range double, noise_level double, phash long"


def signals(images: DataFrame, key: str) -> DataFrame:
    """images: key, width, height, pixels (binary, a byte a pixel). One row each; error says why an image has no signals."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, w, h, data in zip(pdf[key], pdf["width"], pdf["height"], pdf["pixels"], strict=True):
                try:
                    g = np.frombuffer(data, np.uint8).reshape(int(h), int(w))
                    rows.append({key: k, **cull_signals(g), "error": None})
                except (ValueError, TypeError) as e:
                    rows.append({key: k, "error": str(e)[:200]})
            yield pd.DataFrame(rows, columns=[key, *(x.split(" ")[0] for x in SIGNALS.split(", ")), "error"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "width", "height", "pixels").mapInPandas(run, f"{key} {kind}, {SIGNALS}, error string")


def steps(x: Column, parts: list[tuple[Column, Column]], otherwise: Column) -> Column:
    first, *rest = parts
    out = F.when(first[0], first[1])
    for cond, value in rest:
        out = out.when(cond, value)
    return out.otherwise(otherwise)


def cull_scores(df: DataFrame) -> DataFrame:
    """The seven scores of 0 to 10 from the signals; blank is a standard deviation under 5."""
    ten = F.lit(10.0)
    v, d, r, n = F.col("zone_variance"), F.col("edge_fraction"), F.col("frequency"), F.col("noise_level")
    hi, lo, u = F.col("highlight_pct"), F.col("shadow_pct"), F.col("tonal_range")
    sharp = steps(v, [(F.col("whole_zone"), F.least(ten, v / 200 * 10)), (v > 500, F.least(ten, 8 + (v - 500) / 500 * 2)), (v > 200, 5 + (v - 200) / 300 * 3), (v > 50, 2 + (v - 50) / 150 * 3)], v / 50 * 2)
    frequency = steps(r, [(r.isNull(), F.lit(5.0)), (r > 2, F.least(ten, 7 + (r - 2))), (r > 0.5, 3 + (r - 0.5) / 1.5 * 4)], r / 0.5 * 3)
    highlight = steps(hi, [(hi < 1, ten), (hi < 5, 7 + (5 - hi) / 4 * 3), (hi < 15, 3 + (15 - hi) / 10 * 4), (hi < 30, (30 - hi) / 15 * 3)], F.lit(0.0))
    shadow = steps(lo, [(lo < 2, ten), (lo < 10, 7 + (10 - lo) / 8 * 3), (lo < 25, 4 + (25 - lo) / 15 * 3), (lo < 50, 1 + (50 - lo) / 25 * 3)], F.lit(1.0))
    tones = steps(u, [(u > 220, F.least(ten, 9 + (u - 220) / 35)), (u > 150, 6 + (u - 150) / 70 * 3), (u > 50, 3 + (u - 50) / 100 * 3)], u / 50 * 3)
    noise = steps(n, [(n < 3, 9 + (3 - n) / 3), (n < 8, 6 + (8 - n) / 5 * 3), (n < 15, 3 + (15 - n) / 7 * 3)], F.greatest(F.lit(0.0), 3 - (n - 15) / 10 * 3))
    out = {"zone_sharpness": sharp, "edge_density": F.least(ten, d * 100), "frequency_ratio": frequency, "highlight_clip": highlight, "shadow_clip": shadow, "dynamic_range": tones, "noise": noise}
    return df.withColumns(out | {"blank_frame": F.col("std") < 5})


def previews(images: DataFrame, key: str, side: int) -> DataFrame:
    """SRC-07. key, width, height, pixels of grey images whose longer side is side at most; null where an image can't be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, w, h, data in zip(pdf[key], pdf["width"], pdf["height"], pdf["pixels"], strict=True):
                try:
                    small = fitted(np.frombuffer(data, np.uint8).reshape(int(h), int(w)), side)
                    rows.append((k, small.shape[1], small.shape[0], small.tobytes()))
                except (ValueError, TypeError):
                    rows.append((k, None, None, None))
            yield pd.DataFrame(rows, columns=[key, "width", "height", "pixels"]).astype({"width": "Int32", "height": "Int32"})

    return images.select(key, "width", "height", "pixels").mapInPandas(run, f"{key} {images.schema[key].dataType.simpleString()}, width int, height int, pixels binary")
