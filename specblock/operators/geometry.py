"""Flips, rotations, transposition and block crops: remapped coordinates, no pixel decoded.

They are exact for sizes that are multiples of the block (with chroma, of the
minimum coded unit); otherwise padding comes into view.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from specblock import kernels
from specblock.frames import Frames

_ODD_U = [1 - 2 * int(u % 2) for u in kernels.U]
_ODD_V = [1 - 2 * int(v % 2) for v in kernels.V]


def _signed(signs: list[int]):
    return F.zip_with("coef", F.lit(signs), lambda c, s: (c.cast("int") * s).cast("smallint"))


def horizontal_flip(frames: Frames) -> Frames:
    return frames.with_blocks(frames.blocks.withColumns({"bcol": F.col("bw") - 1 - F.col("bcol"), "coef": _signed(_ODD_V)}))


def vertical_flip(frames: Frames) -> Frames:
    return frames.with_blocks(frames.blocks.withColumns({"brow": F.col("bh") - 1 - F.col("brow"), "coef": _signed(_ODD_U)}))


def rotate180(frames: Frames) -> Frames:
    signs = [a * b for a, b in zip(_ODD_U, _ODD_V, strict=True)]
    return frames.with_blocks(frames.blocks.withColumns({"brow": F.col("bh") - 1 - F.col("brow"), "bcol": F.col("bw") - 1 - F.col("bcol"), "coef": _signed(signs)}))


def _turned(name):
    """An array of 64 with rows and columns swapped: plain element reads, which code generation compiles."""
    return F.array(*(name[int(8 * v + u)] for u, v in zip(kernels.U, kernels.V, strict=True)))


def transpose(frames: Frames) -> Frames:
    blocks = frames.blocks.select(
        "image_id",
        "channel",
        F.col("bcol").alias("brow"),
        F.col("brow").alias("bcol"),
        F.col("bw").alias("bh"),
        F.col("bh").alias("bw"),
        _turned(F.col("q")).alias("q"),
        _turned(F.col("coef")).alias("coef"),
    )
    info = F.transform("comp_info", lambda x: F.struct(x["v"].alias("h"), x["h"].alias("v"), x["qt"].alias("qt")))
    images = frames.images.withColumns(
        {"width": F.col("height"), "height": F.col("width"), "quant_tables": F.transform("quant_tables", _turned), "comp_info": info}
    )
    return Frames(images, blocks)


def rotate90(frames: Frames) -> Frames:
    return horizontal_flip(transpose(frames))


def rotate270(frames: Frames) -> Frames:
    return vertical_flip(transpose(frames))


def rotate(frames: Frames, degrees: int) -> Frames:
    turns = {0: lambda f: f, 90: rotate90, 180: rotate180, 270: rotate270}
    if degrees % 360 not in turns:
        raise ValueError("degrees must be a multiple of 90")
    return turns[degrees % 360](frames)


def block_crop(frames: Frames, block_row: int, block_col: int, block_rows: int, block_cols: int) -> Frames:
    """Blocks of the luma rectangle and of the chroma rectangle in proportion; an image too small raises."""
    if min(block_row, block_col) < 0 or min(block_rows, block_cols) < 1:
        raise ValueError("a crop starts at 0 or later and holds a block at least")
    sides = {}
    for axis, at, n, length in (("brow", block_row, block_rows, "bh"), ("bcol", block_col, block_cols, "bw")):
        # Chroma grids follow the luma grid by the ratio of the two, cut off.
        luma = F.col(f"luma_{length}")
        ratio = F.col(length) / luma
        first = F.when(F.col("channel") == "Y", at).otherwise(F.floor(at * ratio)).cast("int")
        size = F.when(F.col("channel") == "Y", n).otherwise(F.greatest(F.lit(1), F.floor(n * ratio))).cast("int")
        size = F.least(size, F.col(length) - first)
        fits = F.when(F.lit(at + n) > luma, F.raise_error(f"the crop exceeds {length}")).otherwise(F.lit(True)).cast("boolean")
        sides[axis] = (first, size, fits, length)
    luma = frames.images.select("image_id", F.ceil(F.col("height") / 8).cast("int").alias("luma_bh"), F.ceil(F.col("width") / 8).cast("int").alias("luma_bw"))
    blocks = frames.blocks.join(luma, "image_id")
    for axis, (first, size, fits, _) in sides.items():
        blocks = blocks.where(fits & (F.col(axis) >= first) & (F.col(axis) < first + size))
    moved = {axis: F.col(axis) - first for axis, (first, _, _, _) in sides.items()} | {length: size for _, size, _, length in sides.values()}
    blocks = blocks.withColumns(moved).drop("luma_bh", "luma_bw")
    return Frames(frames.images.withColumns({"width": F.lit(block_cols * 8), "height": F.lit(block_rows * 8)}), blocks)
