"""Perceptual hashes of decoded images, as signed 64-bit values; distances are in similarity.py."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNATURE = T.StructType([T.StructField(n, T.LongType()) for n in ("phash", "dhash", "chash")])


def resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means of a grid of cells; a cell takes the pixels it covers by share."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        low, high = np.maximum(edge[:-1, None], np.arange(n)[None, :]), np.minimum(edge[1:, None], np.arange(1, n + 1)[None, :])
        return np.maximum(high - low, 0) * m / n

    rows, columns = weights(pixels.shape[0], height), weights(pixels.shape[1], width)
    return np.einsum("ih,hw...,jw->ij...", rows, pixels, columns)


def _cosines(n: int) -> np.ndarray:
    out = np.cos(np.pi / n * (np.arange(n)[None, :] + 0.5) * np.arange(n)[:, None]) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


_C32 = _cosines(32)


def _packed(bits: np.ndarray) -> int:
    value = int("".join("1" if b else "0" for b in bits.ravel()), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def hashes(rgb: np.ndarray) -> tuple[int, int, int]:
    """phash, dhash and chash of an array (height, width, 3)."""
    grey = rgb @ np.array([0.299, 0.587, 0.114])
    low = (_C32 @ resized(grey, 32, 32) @ _C32.T)[:8, :8]
    small = resized(grey, 8, 9)
    cells = resized(rgb, 4, 4)
    colour = np.stack([cells[..., c] > np.median(cells[..., c]) for c in range(3)])
    return _packed(low > np.median(low.ravel()[1:])), _packed(small[:, 1:] > small[:, :-1]), _packed(colour)


@F.pandas_udf(SIGNATURE)
def signature(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
    """Of images as Spark's image source decodes them: rows of blue, green, red (and alpha, over white) or grey."""
    rows = []
    for h, w, c, raw in zip(height, width, channels, data, strict=True):
        pixels = np.frombuffer(raw, np.uint8).astype(float).reshape(h, w, c)
        if c == 1:
            pixels = np.repeat(pixels, 3, axis=2)
        elif c == 4:
            alpha = pixels[..., 3:] / 255
            pixels = pixels[..., :3] * alpha + 255 * (1 - alpha)
        rows.append(hashes(pixels[..., ::-1] if c > 1 else pixels))
    return pd.DataFrame(rows, columns=["phash", "dhash", "chash"])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, signature of readable images; broken files are left out."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path)
    return rows.select(F.col("image.origin").alias("path"), signature("image.height", "image.width", "image.nChannels", "image.data").alias("signature"))


def unreadable(spark: SparkSession, paths: DataFrame, read: DataFrame) -> DataFrame:
    """Wanted paths that could not be read."""
    return paths.join(read.select("path"), "path", "left_anti")
