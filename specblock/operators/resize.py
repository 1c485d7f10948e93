"""Resampling of decoded pixels: separable filters as sparse weight joins.

A filter is a small table of (to, from, weight) for each axis; pixels meet it
in an equi-join and are summed up, rows first, then columns, rounding between
the passes as 8-bit resamplers do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specblock.frames import Frames
from specblock.functions.transform import from_array, to_pixels

FILTERS = {
    "lanczos": (3.0, lambda x: (math.sin(math.pi * x) / (math.pi * x)) * (math.sin(math.pi * x / 3) / (math.pi * x / 3)) if x else 1.0),
    "bilinear": (1.0, lambda x: 1.0 - abs(x)),
}


def axis_weights(size: int, new: int, kind: str) -> list[tuple[int, int, float]]:
    """(to, from, weight) of resampling size samples to new ones."""
    support, f = FILTERS[kind]
    scale = size / new
    wide = max(scale, 1.0)
    out = []
    for to in range(new):
        centre = (to + 0.5) * scale
        low, high = max(0, int(centre - support * wide + 0.5)), min(size, int(centre + support * wide + 0.5))
        weights = [f(x) if abs(x := (at + 0.5 - centre) / wide) < support else 0.0 for at in range(low, high)]
        total = sum(weights)
        out += [(to, low + i, w / total) for i, w in enumerate(weights) if w]
    return out


def _taps(sizes: DataFrame, kind: str) -> DataFrame:
    """(size, new, source, to, w): the weights of every distinct pair of sizes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, new in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                to, source, w = zip(*axis_weights(size, new, kind), strict=True)
                n = len(to)
                columns = [pa.array([x] * n, pa.int32()) for x in (size, new)] + [pa.array(source, pa.int32()), pa.array(to, pa.int32()), pa.array(w, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["size", "new", "source", "to", "w"])

    return sizes.distinct().mapInArrow(work, "size int, new int, source int, to int, w double")


def resize(pixels: DataFrame, sizes: DataFrame, kind: str) -> DataFrame:
    """pixels (image_id, row, col, r, g, b) resampled.

    sizes (image_id, height, width, new_height, new_width) has a row an image,
    each with a size of its own.
    """
    for axis, size, new in (("col", "width", "new_width"), ("row", "height", "new_height")):
        own = sizes.select("image_id", F.col(size).cast("int").alias("size"), F.col(new).cast("int").alias("new"))
        taps = _taps(own.select("size", "new"), kind)
        other = "row" if axis == "col" else "col"
        joined = pixels.join(own, "image_id").withColumnRenamed(axis, "source").join(taps, ["size", "new", "source"])
        level = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.sum(F.col(c) * F.col("w")) + 0.5))).cast("int")
        pixels = joined.groupBy("image_id", other, F.col("to").alias(axis)).agg(*(level(c).alias(c) for c in "rgb"))
    return pixels.select("image_id", "row", "col", "r", "g", "b")


def upscale(frames: Frames, factor: int = 2, quality: int = 85) -> Frames:
    """Decodes, enlarges by a power of two (Lanczos) and encodes again, chroma at full size."""
    if factor < 1 or factor & (factor - 1):
        raise ValueError("factor must be a power of two")
    if factor == 1:
        return frames
    sizes = frames.images.select("image_id", "height", "width", (F.col("height") * factor).alias("new_height"), (F.col("width") * factor).alias("new_width"))
    big = resize(to_pixels(frames), sizes, "lanczos")
    color = frames.images.where("num_components > 1").select("image_id")
    gray = frames.images.where("num_components = 1").select("image_id")
    parts = [from_array(big.join(color, "image_id", "left_semi"), quality), from_array(big.join(gray, "image_id", "left_semi").select("image_id", "row", "col", F.col("r").alias("y")), quality)]
    images = parts[0].images.unionByName(parts[1].images).drop("path", "label").join(frames.images.select("image_id", "path", "label"), "image_id")
    return Frames(images.select(frames.images.columns), parts[0].blocks.unionByName(parts[1].blocks))


def sized_thumbnail(thumbnail: DataFrame, frames: Frames, size: int) -> DataFrame:
    """A DC thumbnail with its longer side at size (bilinear)."""
    height, width = F.ceil(F.col("height") / 8), F.ceil(F.col("width") / 8)
    grid = frames.images.select("image_id", height.alias("height"), width.alias("width"))
    scaled = lambda n: F.greatest(F.lit(1), F.rint(F.col(n) * size / F.greatest("height", "width"))).cast("int")
    return resize(thumbnail, grid.withColumns({"new_height": scaled("height"), "new_width": scaled("width")}), "bilinear")
