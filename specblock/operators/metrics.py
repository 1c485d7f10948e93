"""Distances between pixel tables (image_id, row, col, r, g, b)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RGB = ("r", "g", "b")


def _both(pixels: DataFrame, pairs: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """Pixels of both images of pairs (a, b) side by side; a full join, so that a mismatch shows."""
    side = lambda name, c: pixels.select(F.col("image_id").alias(name), "row", "col", *(F.col(x).cast("double").alias(f"{c}_{x}") for x in channels))
    left = pairs.select("a", "b").join(side("a", "x"), "a")
    right = pairs.select("a", "b").join(side("b", "y"), "b")
    return left.join(right, ["a", "b", "row", "col"], "full")


def mse(pixels: DataFrame, pairs: DataFrame, channels: tuple[str, ...] = RGB) -> DataFrame:
    """(a, b, mse) of pairs (a, b); images of unlike shapes raise."""
    both = _both(pixels, pairs, channels)
    total = sum(((F.col(f"x_{c}") - F.col(f"y_{c}")) ** 2 for c in channels), F.lit(0.0)) / len(channels)
    lost = F.max(F.col(f"x_{channels[0]}").isNull() | F.col(f"y_{channels[0]}").isNull())
    found = both.groupBy("a", "b").agg(F.avg(total).alias("v"), lost.alias("lost"))
    return found.select("a", "b", F.when(F.col("lost"), F.raise_error("the images differ in shape").cast("double")).otherwise(F.col("v")).alias("mse"))


def psnr(pixels: DataFrame, pairs: DataFrame, max_value: float = 255.0, channels: tuple[str, ...] = RGB) -> DataFrame:
    """(a, b, psnr) in dB; infinite for equal images."""
    rate = F.when(F.col("mse") == 0, float("inf")).otherwise(10 * F.log10(F.lit(max_value**2) / F.col("mse")))
    return mse(pixels, pairs, channels).select("a", "b", rate.alias("psnr"))


def _filtered(x: np.ndarray, sigma: float = 1.5, truncate: float = 3.5) -> np.ndarray:
    """A separable Gaussian over rows and columns, edges reflected."""
    radius = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        padded = np.pad(x, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        x = sum(weight * np.take(padded, np.arange(k, k + x.shape[axis]), axis=axis) for k, weight in enumerate(w))
    return x


def ssim_plane(x: np.ndarray, y: np.ndarray) -> float:
    """Structural similarity of two planes of levels 0..255."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    mx, my = _filtered(x), _filtered(y)
    vx, vy, cov = _filtered(x * x) - mx * mx, _filtered(y * y) - my * my, _filtered(x * y) - mx * my
    s = (2 * mx * my + c1) * (2 * cov + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))
    return float((s[5:-5, 5:-5] if min(s.shape) > 10 else s).mean())


def ssim(pixels: DataFrame, pairs: DataFrame, channels: tuple[str, ...] = RGB) -> DataFrame:
    """(a, b, ssim): the mean over channels; a group holds the pixels of one pair."""

    def one(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row", "col"])
        shape = (rows["row"].max() + 1, rows["col"].max() + 1)
        if rows.isna().any().any() or len(rows) != shape[0] * shape[1]:
            raise ValueError("the images differ in shape")
        plane = lambda s, c: rows[f"{s}_{c}"].to_numpy(float).reshape(shape)
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "ssim": [np.mean([ssim_plane(plane("x", c), plane("y", c)) for c in channels])]})

    return _both(pixels, pairs, channels).groupBy("a", "b").applyInPandas(one, "a long, b long, ssim double")


def blockiness(pixels: DataFrame, column: str = "r", block: int = 8) -> DataFrame:
    """(image_id, blockiness): the mean jump at block borders less that inside blocks."""
    here = pixels.select("image_id", "row", "col", F.col(column).cast("double").alias("x"))
    jumps = []
    for axis in ("row", "col"):
        after = here.select("image_id", (F.col("row") - int(axis == "row")).alias("row"), (F.col("col") - int(axis == "col")).alias("col"), F.col("x").alias("y"))
        edge = (F.col(axis) + 1) % block == 0
        jumps.append(here.join(after, ["image_id", "row", "col"]).select("image_id", edge.alias("edge"), F.abs(F.col("y") - F.col("x")).alias("jump")))
    mean = lambda keep: F.coalesce(F.avg(F.when(keep, F.col("jump"))), F.lit(0.0))
    return jumps[0].union(jumps[1]).groupBy("image_id").agg((mean(F.col("edge")) - mean(~F.col("edge"))).alias("blockiness"))
