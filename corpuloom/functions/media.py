"""Column functions over media metadata: tokens, windows, sampling, hashes, positions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_BASE, IMAGE_TILE, TILE = 85, 170, 512


def image_tokens(width: Column, height: Column) -> Column:
    """A base and so much for each 512-pixel tile; the base alone for unknown sizes."""
    tiles = F.ceil(width / TILE) * F.ceil(height / TILE)
    return F.coalesce(F.lit(IMAGE_BASE) + tiles * IMAGE_TILE, F.lit(IMAGE_BASE)).cast("bigint")


def kind_tokens(kind: Column, size: Column, width: Column, height: Column) -> Column:
    """By kind: images by tiles, video and audio the image base, all else bytes // 4."""
    return F.when(kind == "image", image_tokens(width, height)).when(kind.isin("video", "audio"), F.lit(IMAGE_BASE).cast("bigint")).otherwise(F.floor(size / 4).cast("bigint"))


def windows(duration: Column, length: float, overlap: float) -> Column:
    """Windows (start, end) over a duration: each begins length - overlap (at least 1) after the last, while inside."""
    step = max(length - overlap, 1)
    starts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(duration / step) - 1).cast("int")), lambda i: i * float(step))
    made = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + float(length), duration).alias("end")))
    return F.when(duration > 0, made).otherwise(F.expr("cast(array() as array<struct<start:double,end:double>>)"))


def uniform_times(duration: Column, n: int) -> Column:
    """n times at equal steps from 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * duration / F.lit(float(n)))


def midpoints(scenes: Column) -> Column:
    return F.transform(scenes, lambda s: (s["start"] + s["end"]) / 2)


def sampled(items: Column, n: int) -> Column:
    """n of the items at int(i * len / n), or all if there are no more."""
    picked = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(items, (F.floor(i * F.size(items) / n) + 1).cast("int")))
    return F.when(F.size(items) > n, picked).otherwise(items)


def decimated(items: Column, k: int) -> Column:
    """Beyond 8k items, each (len // 8k)-th; more than 8k may stay."""
    step = F.greatest(F.lit(1), F.floor(F.size(items) / (8 * k))).cast("int")
    return F.when(F.size(items) > 8 * k, F.filter(items, lambda x, i: i % step == 0)).otherwise(items)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def decimal_position(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds and N, S, E or W as signed decimal degrees."""
    return (degrees + minutes / 60 + seconds / 3600) * F.when(ref.isin("S", "W"), -1).otherwise(1)


def gps(latitude: Column, longitude: Column) -> Column:
    return F.format_string("%.6f,%.6f", latitude, longitude)


def fps(value: Column) -> Column:
    return F.round(value, 3)


def perceptual_hash(pixels: np.ndarray) -> str:
    """16 hex digits of a grey image: low 8x8 of its 2-D DCT against the upper median of the other 63."""
    grey = _resized(np.asarray(pixels, np.float64), 32)
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (basis @ grey @ basis.T)[:8, :8].ravel()
    median = np.sort(low[1:])[31]
    return f"{sum(1 << i for i in range(64) if low[i] > median):016x}"


def _resized(grey: np.ndarray, n: int) -> np.ndarray:
    """n x n by Lanczos of three lobes, along one axis and then the other."""
    for axis in (0, 1):
        size = grey.shape[axis]
        scale = max(1.0, size / n)
        centre = (np.arange(n) + 0.5) * size / n - 0.5
        at = (centre[:, None] - np.arange(size)[None, :]) / scale
        weight = np.where(np.abs(at) < 3, np.sinc(at) * np.sinc(at / 3), 0.0)
        weight /= weight.sum(1, keepdims=True)
        grey = weight @ grey if axis == 0 else grey @ weight.T
    return grey
