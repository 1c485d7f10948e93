"""Blocks and pixels: DCT, quantisation, color space, padding, the forward and the inverse path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from specblock import kernels
from specblock.frames import Frames, floats
from specblock.operators.adaptive import matrices
from specblock.operators.apps import channel_value, rgb_of

SUBSAMPLING = ("4:4:4", "4:2:2", "4:2:0")


def validate_subsampling(mode: str) -> None:
    if mode not in SUBSAMPLING:
        raise ValueError(f"subsampling must be one of {', '.join(SUBSAMPLING)}")


def chroma_dimensions(height: int, width: int, mode: str) -> tuple[int, int]:
    validate_subsampling(mode)
    return (height + 1) // 2 if mode == "4:2:0" else height, width if mode == "4:4:4" else (width + 1) // 2


def pixel_to_block(row: Column, col: Column) -> tuple[Column, Column]:
    return F.floor(row / 8).cast("int"), F.floor(col / 8).cast("int")


def block_to_pixel(brow: Column, bcol: Column) -> tuple[Column, Column]:
    return brow * 8, bcol * 8


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """BT.601, full range."""
    return 0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, ...]:
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), x))
    return tuple(map(clip, rgb_of(y, cb, cr)))


def quantize(coeffs: Column, table: Column) -> Column:
    """Rounded quotients, half to even, as ARRAY<FLOAT>."""
    return F.zip_with(coeffs, table, lambda c, q: F.rint((c.cast("float") / q.cast("float")).cast("float")).cast("float"))


def dequantize(coeffs: Column, table: Column) -> Column:
    return F.zip_with(coeffs, table, lambda c, q: c.cast("float") * q.cast("float"))


def scale_quant_table(table: Column, quality: int) -> Column:
    scale = kernels.quality_scale(quality)
    return F.transform(table, lambda t: F.greatest(F.lit(1.0), F.least(F.lit(255.0), F.floor(t.cast("double") * scale + 0.5).cast("double"))).cast("float"))


def _product(rows: DataFrame, column: str, out: str, inverse: bool) -> DataFrame:
    d = kernels.dct_matrix()
    left = d.T if inverse else d
    names = rows.columns
    at = names.index(column)

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                x = left @ matrices(batch.column(at)) @ left.T
                flat = pa.array(x.reshape(-1))
                done = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 64, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*batch.columns, done], [*names, out])

    return rows.mapInArrow(work, StructType([*rows.schema.fields, StructField(out, ArrayType(DoubleType()))]))


def dct2(rows: DataFrame, column: str = "block", out: str = "dct") -> DataFrame:
    """rows with out: the orthonormal 2-D DCT of column, an array of 64."""
    return _product(rows, column, out, inverse=False)


def idct2(rows: DataFrame, column: str = "dct", out: str = "block") -> DataFrame:
    return _product(rows, column, out, inverse=True)


def pixel_blocks(pixels: DataFrame, columns: list[str], size: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(image_id, channel, brow, bcol, bh, bw, block) of level-shifted values, padded with zero after the shift.

    pixels (image_id, row, col, columns): each column is a channel of its own.
    With strict, a size that is no multiple of 8 raises instead.
    """
    size = size or pixels.groupBy("image_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    brow, bcol = pixel_to_block(F.col("row"), F.col("col"))
    at = (F.col("row") % 8) * 8 + F.col("col") % 8
    rows = pixels.select("image_id", brow.alias("brow"), bcol.alias("bcol"), at.alias("k"), *columns)
    # 64 pixels to a group at most.
    groups = rows.groupBy("image_id", "brow", "bcol").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct(*columns).alias("x")))).alias("at"))
    places = F.sequence(F.lit(0), F.lit(63))
    of = lambda c: F.transform(places, lambda k: F.coalesce(F.try_element_at("at", k)[c].cast("double") - 128, F.lit(0.0)))
    channels = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), of(c).alias("block")) for c in columns)))
    whole = groups.select("image_id", "brow", "bcol", channels.alias("c")).select("image_id", "c.channel", "brow", "bcol", "c.block")
    if strict:
        whole_blocks = (F.col("height") % 8 == 0) & (F.col("width") % 8 == 0)
        size = size.withColumn("height", F.when(whole_blocks, F.col("height")).otherwise(F.raise_error("BlockBoundaryError: a size is no multiple of 8").cast("int")))
    grid = size.select("image_id", F.ceil(F.col("height") / 8).cast("int").alias("bh"), F.ceil(F.col("width") / 8).cast("int").alias("bw"))
    return whole.join(grid, "image_id").select("image_id", "channel", "brow", "bcol", "bh", "bw", "block")


def pad_to_blocks(pixels: DataFrame, column: str) -> DataFrame:
    """(image_id, row, col, column): zeros at the bottom and right up to multiples of 8."""
    up = lambda c: (F.ceil((F.max(c) + 1) / 8) * 8 - 1).cast("int")
    size = pixels.groupBy("image_id").agg(up("row").alias("h"), up("col").alias("w"))
    rows = size.select("image_id", "w", F.explode(F.sequence(F.lit(0), F.col("h"))).alias("row"))
    grid = rows.select("image_id", "row", F.explode(F.sequence(F.lit(0), F.col("w"))).alias("col"))
    return grid.join(pixels.select("image_id", "row", "col", column), ["image_id", "row", "col"], "left").withColumn(column, F.coalesce(column, F.lit(0)))


def from_array(pixels: DataFrame, quality: int = 85) -> Frames:
    """Frames of pixels (image_id, row, col, r, g, b, or row, col, y for gray); chroma at full size."""
    gray = "y" in pixels.columns
    luma, chroma = kernels.scaled_table(kernels.LUMINANCE, quality), kernels.scaled_table(kernels.CHROMINANCE, quality)
    size = pixels.groupBy("image_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    if gray:
        values, names = pixels.withColumnRenamed("y", "Y"), ["Y"]
    else:
        names = ["Y", "Cb", "Cr"]
        ycc = rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b"))
        values = pixels.select("image_id", "row", "col", *(x.alias(n) for n, x in zip(names, ycc, strict=True)))
    blocks = dct2(pixel_blocks(values, names, size))
    q = F.when(F.col("channel") == "Y", floats(luma)).otherwise(floats(chroma))
    blocks = blocks.withColumn("q", q)
    coef = F.transform(quantize(F.col("dct"), F.col("q")), lambda c: c.cast("smallint"))
    info = lambda qt: F.struct(F.lit(1).alias("h"), F.lit(1).alias("v"), F.lit(qt).alias("qt"))
    images = size.select(
        "image_id",
        F.lit(None).cast("string").alias("path"),
        F.lit(0).alias("label"),
        F.col("width").cast("int").alias("width"),
        F.col("height").cast("int").alias("height"),
        F.lit(1 if gray else 3).alias("num_components"),
        F.array(floats(luma), *([] if gray else [floats(chroma)])).alias("quant_tables"),
        F.array(info(0), *([] if gray else [info(1), info(1)])).alias("comp_info"),
        F.lit(None).cast("string").alias("source_path"),
    )
    return Frames(images, blocks.select("image_id", "channel", "brow", "bcol", "bh", "bw", "q", coef.alias("coef")))


def channel_pixels(frames: Frames) -> DataFrame:
    """(image_id, channel, bh, bw, row, col, x): decoded levels of each channel on its own grid, uncut."""
    rows = frames.blocks.select("image_id", "channel", "brow", "bcol", "bh", "bw", dequantize(F.col("coef"), F.col("q")).alias("dct"))
    values = idct2(rows, "dct", "block").select("image_id", "channel", "brow", "bcol", "bh", "bw", F.posexplode("block").alias("k", "x"))
    return values.select(
        "image_id",
        "channel",
        "bh",
        "bw",
        (F.col("brow") * 8 + F.floor(F.col("k") / 8)).cast("int").alias("row"),
        (F.col("bcol") * 8 + F.col("k") % 8).cast("int").alias("col"),
        (F.col("x") + 128).alias("x"),
    )


def to_pixels(frames: Frames) -> DataFrame:
    """(image_id, row, col, r, g, b): decoded pixels; gray images repeat their level.

    Chroma goes to the luma grid by its nearest sample; levels are cut to
    0..255 and truncated; padding is left out.
    """
    size = frames.images.select("image_id", "width", "height")
    planes = channel_pixels(frames)
    inside = lambda p: p.join(size, "image_id").where((F.col("row") < F.col("height")) & (F.col("col") < F.col("width")))
    y = inside(planes.where(F.col("channel") == "Y").withColumnsRenamed({"x": "y", "bh": "lh", "bw": "lw"}).drop("channel"))
    grid = frames.blocks.where((F.col("channel") == "Cb") & (F.col("brow") == 0) & (F.col("bcol") == 0)).select("image_id", "bh", "bw")
    factor = lambda of, n: F.ceil(F.col(of) / F.col(n))
    y = y.join(grid, "image_id", "left").withColumns({"crow": F.floor(F.col("row") / factor("lh", "bh")).cast("int"), "ccol": F.floor(F.col("col") / factor("lw", "bw")).cast("int")})
    pick = lambda c: F.max(F.when(F.col("channel") == c, F.col("x"))).alias(c.lower())
    chroma = planes.where(F.col("channel") != "Y").groupBy("image_id", F.col("row").alias("crow"), F.col("col").alias("ccol")).agg(pick("Cb"), pick("Cr"))
    both = y.join(chroma, ["image_id", "crow", "ccol"], "left")
    gray = F.col("cb").isNull()
    rgb = rgb_of(F.col("y"), F.col("cb"), F.col("cr"))
    return both.select("image_id", "row", "col", *(channel_value(F.when(gray, F.col("y")).otherwise(x)).alias(n) for n, x in zip("rgb", rgb, strict=True)))
