"""Operators on a block and its eight neighbours.

Each block is sent to the (up to nine) blocks that see it and summed up there:
one shuffle on (image, channel, row, column), of which no group is larger than
nine rows.  A border outside the image is mid-gray.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specblock import kernels
from specblock.frames import Frames
from specblock.operators.adaptive import coefficient_column, matrices, matrix_blocks

_KEY = ["image_id", "channel", "brow", "bcol", "bh", "bw", "q"]
_KEY_SCHEMA = "image_id bigint, channel string, brow int, bcol int, bh int, bw int, q array<float>"


def neighbourhoods(blocks: DataFrame) -> DataFrame:
    """One row a block with n0..n8: the coefficients of its 3 x 3 neighbourhood, row by row, null outside."""
    shifts = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    seen = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(a).alias("a"), F.lit(b).alias("b")) for p, (a, b) in enumerate(shifts))))
    rows = blocks.withColumn("s", seen)
    # This block is neighbour (a, b) of the block at (brow - a, bcol - b).
    rows = rows.withColumns({"brow": F.col("brow") - F.col("s.a"), "bcol": F.col("bcol") - F.col("s.b"), "p": F.col("s.p")}).drop("s")
    rows = rows.where((F.col("brow") >= 0) & (F.col("brow") < F.col("bh")) & (F.col("bcol") >= 0) & (F.col("bcol") < F.col("bw")))
    near = [F.max(F.when(F.col("p") == p, F.col("coef"))).alias(f"n{p}") for p in range(9)]
    key = ["image_id", "channel", "brow", "bcol"]
    return rows.groupBy(*key).agg(*(F.first(c).alias(c) for c in ("bh", "bw", "q")), *near).select(*_KEY, *(F.coalesce(f"n{p}", F.array_repeat(F.lit(0).cast("smallint"), 64)).alias(f"n{p}") for p in range(9)))


def _scoped(frames: Frames, channels: str, work: Callable[[DataFrame], DataFrame]) -> Frames:
    scope = {"all": ("Y", "Cb", "Cr"), "luma": ("Y",), "chroma": ("Cb", "Cr")}.get(channels)
    if not scope:
        return frames
    done = work(frames.blocks.where(F.col("channel").isin(*scope)))
    rest = frames.blocks.where(~F.col("channel").isin(*scope))
    return frames.with_blocks(done if channels == "all" else done.unionByName(rest))


def cross_block_blur(frames: Frames, sigma: float = 3.0, channels: str = "all") -> Frames:
    """A spatial Gaussian over a block and its neighbours: a larger sigma blurs more.

    The filter is separable and linear, so it acts on coefficients: the sum of
    A_a C_ab A_b' over the neighbourhood, nothing decoded.
    """
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    sides = kernels.stencil_sides(sigma)

    def blend(batch: pa.RecordBatch) -> pa.RecordBatch:
        q = matrices(batch.column(6))
        total = np.zeros_like(q)
        for p in range(9):
            total += sides[p // 3] @ (matrices(batch.column(7 + p)) * q) @ sides[p % 3].T
        return pa.RecordBatch.from_arrays([*batch.columns[:7], coefficient_column(total / q)], [*_KEY, "coef"])

    return _scoped(frames, channels, lambda blocks: matrix_blocks(neighbourhoods(blocks), blend, f"{_KEY_SCHEMA}, coef array<smallint>"))


def patch_operation(frames: Frames, operation: Callable[[np.ndarray], np.ndarray], channels: str = "all") -> Frames:
    """A user's function of 24 x 24 pixel patches (level-shifted), applied around every block.

    operation takes and gives arrays (n, 24, 24): all patches of a batch at once.
    """
    d = kernels.dct_matrix()

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        q = matrices(batch.column(6))
        rows = [np.concatenate([d.T @ (matrices(batch.column(7 + 3 * a + b)) * q) @ d for b in range(3)], axis=2) for a in range(3)]
        done = np.asarray(operation(np.concatenate(rows, axis=1)))[:, 8:16, 8:16]
        return pa.RecordBatch.from_arrays([*batch.columns[:7], coefficient_column(d @ done @ d.T / q)], [*_KEY, "coef"])

    return _scoped(frames, channels, lambda blocks: matrix_blocks(neighbourhoods(blocks), apply, f"{_KEY_SCHEMA}, coef array<smallint>"))


def _absolute_laplacian(patches: np.ndarray) -> np.ndarray:
    p = np.pad(patches, ((0, 0), (1, 1), (1, 1)), mode="symmetric")
    return np.abs(p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * patches)


def cross_block_edges(frames: Frames, method: str = "laplacian") -> Frames:
    """The absolute Laplacian of the pixels, seam-free; luma only.  method is accepted and unused."""
    return patch_operation(frames.gray(), _absolute_laplacian)
