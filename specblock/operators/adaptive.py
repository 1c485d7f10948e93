"""Operators that first look at a whole image, or at groups of its blocks.

Image-wide numbers come from aggregates by image, channel and position; they
combine before they shuffle, so no image is gathered.  A 2 x 2 merge of blocks
shuffles each block once to its group of four.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specblock import kernels
from specblock.frames import Frames, rounded


def vignette(frames: Frames, strength: float = 1.0) -> Frames:
    """Every coefficient of a block weakens with the square of its distance from the centre."""
    if strength == 0:
        return frames
    luma = frames.images.select("image_id", F.ceil(F.col("height") / 8).alias("lh"), F.ceil(F.col("width") / 8).alias("lw"))
    blocks = frames.blocks.join(luma, "image_id")

    def offset(at: str, n: str, whole: str):
        own = F.col(at) + 0.5
        # Chroma rows lie evenly between the middles of the first and the last luma row.
        spread = F.when(F.col(n) > 1, 0.5 + F.col(at) * ((F.col(whole) - 1.0) / (F.col(n) - 1))).otherwise(0.5)
        return F.when(F.col("channel") == "Y", own).otherwise(spread) - F.col(whole) / 2

    dy, dx = offset("brow", "bh", "lh"), offset("bcol", "bw", "lw")
    furthest = (F.col("lh") / 2) * (F.col("lh") / 2) + (F.col("lw") / 2) * (F.col("lw") / 2)
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - strength * ((dy * dy + dx * dx) / furthest))).cast("float")
    blocks = blocks.withColumn("__w", weight)
    coef = F.transform("coef", lambda c: rounded(c.cast("float") * F.col("__w")))
    return frames.with_blocks(blocks.withColumn("coef", coef).drop("__w", "lh", "lw"))


def channel_power(frames: Frames) -> DataFrame:
    """(image_id, channel, power): the mean square of each of the 64 positions, in order."""
    exploded = frames.blocks.select("image_id", "channel", F.posexplode("coef").alias("k", "c"))
    power = exploded.groupBy("image_id", "channel", "k").agg(F.avg(F.col("c").cast("double") * F.col("c")).alias("p"))
    ordered = F.array_sort(F.collect_list(F.struct("k", "p")))
    return power.groupBy("image_id", "channel").agg(F.transform(ordered, lambda x: x["p"]).alias("power"))


def wiener_denoise(frames: Frames, noise_variance: float = 5.0) -> Frames:
    """c P / (P + n) by position, P the mean square; DC stays, and a position without power is zero."""
    blocks = frames.blocks.join(channel_power(frames), ["image_id", "channel"])

    def weaken(c, p, k):
        w = F.when(k == 0, 1.0).when(p > 0, p / (p + noise_variance)).otherwise(0.0).cast("float")
        return rounded(c.cast("float") * w)

    numbered = F.transform("power", lambda p, k: F.struct(p.alias("p"), k.alias("k")))
    return frames.with_blocks(blocks.withColumn("coef", F.zip_with("coef", numbered, lambda c, x: weaken(c, x["p"], x["k"]))).drop("power"))


def posterize(frames: Frames, levels: int = 4) -> Frames:
    """Coefficients to multiples of the channel's largest magnitude / levels (1 at least)."""
    if levels < 1:
        raise ValueError("levels must be at least 1")
    largest = frames.blocks.groupBy("image_id", "channel").agg(F.max(F.array_max(F.transform("coef", lambda c: F.abs(c.cast("int"))))).alias("top"))
    step = F.greatest(F.lit(1.0), F.col("top") / float(levels)).cast("float")
    blocks = frames.blocks.join(largest, ["image_id", "channel"]).withColumn("__s", step)

    def level(c):
        return rounded(F.rint((c.cast("float") / F.col("__s")).cast("float")).cast("float") * F.col("__s"))

    return frames.with_blocks(blocks.withColumn("coef", F.transform("coef", level)).drop("top", "__s"))


def matrix_blocks(rows: DataFrame, work, schema: str) -> DataFrame:
    """rows through work(columns as arrays) in Arrow batches: for products of 8 x 8 matrices."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return rows.mapInArrow(batches_of, schema)


def matrices(column: pa.Array) -> np.ndarray:
    """n arrays of 64 as n 8 x 8 matrices in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 8, 8)


def coefficient_column(x: np.ndarray) -> pa.Array:
    """Rounded (half to even) matrices as arrays of 64; values beyond SMALLINT raise."""
    x = np.rint(x).reshape(len(x), -1)
    if x.size and (x.max() > 32767 or x.min() < -32768):
        raise OverflowError("a coefficient lies beyond 16 bits")
    flat = pa.array(x.astype(np.int16).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)), flat)


def _halved(blocks: DataFrame) -> DataFrame:
    """One level: groups of 2 x 2 blocks to one block; a missing one counts as zero."""
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    place = (F.col("brow") % 2) * 2 + F.col("bcol") % 2
    grid = {c: F.ceil(F.col(c) / 2).cast("int").alias(c) for c in ("bh", "bw")}
    keyed = blocks.select("image_id", "channel", half("brow").alias("brow"), half("bcol").alias("bcol"), *grid.values(), "q", "coef", place.alias("place"))
    quarters = [F.max(F.when(F.col("place") == p, F.col("coef"))).alias(f"c{p}") for p in range(4)]
    groups = keyed.groupBy("image_id", "channel", "brow", "bcol").agg(F.first("bh").alias("bh"), F.first("bw").alias("bw"), F.first("q").alias("q"), *quarters)
    zero = F.array_repeat(F.lit(0).cast("smallint"), 64)
    groups = groups.select("image_id", "channel", "brow", "bcol", "bh", "bw", "q", *(F.coalesce(f"c{p}", zero).alias(f"c{p}") for p in range(4)))
    left, right = kernels.downscale_sides()

    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        q = matrices(batch.column(6))
        total = np.zeros_like(q)
        for p in range(4):
            rows, cols = (left, right)[p // 2], (left, right)[p % 2]
            total += rows @ (matrices(batch.column(7 + p)) * q) @ cols.T
        # The precision that the reference results have: single, before it rounds.
        new = total.astype(np.float32) / q.astype(np.float32)
        return pa.RecordBatch.from_arrays([*batch.columns[:7], coefficient_column(new)], ["image_id", "channel", "brow", "bcol", "bh", "bw", "q", "coef"])

    return matrix_blocks(groups, merge, "image_id bigint, channel string, brow int, bcol int, bh int, bw int, q array<float>, coef array<smallint>")


def _power_of_two(factor: int) -> int:
    if factor < 1 or factor & (factor - 1):
        raise ValueError("factor must be a power of two")
    return factor.bit_length() - 1


def downscale(frames: Frames, factor: int = 2) -> Frames:
    """Shrinks by a power of two without decoding; each halving rounds and keeps the tables."""
    levels = _power_of_two(factor)
    blocks = frames.blocks
    for _ in range(levels):
        blocks = _halved(blocks)
    size = {c: F.greatest(F.lit(1), F.floor(F.col(c) / factor)).cast("int") for c in ("width", "height")}
    return frames if factor == 1 else Frames(frames.images.withColumns(size), blocks)
