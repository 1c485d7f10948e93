"""Feature tensors of coefficients: channel-first arrays with their shape, one row an image.

A tensor holds one image, so its group is bounded by the image; rows are put
in order by an array sort, never by a global one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specblock.frames import CHANNELS, Frames

MODES = ("y_only", "ycbcr", "dc_only")


def _values(frames: Frames, mode: str) -> DataFrame:
    """(image_id, plane, brow, bcol, bh, bw, coef) on the luma grid; gray images have zeros for chroma in ycbcr."""
    y = frames.blocks.where(F.col("channel") == "Y").select("image_id", F.lit(0).alias("plane"), "brow", "bcol", "bh", "bw", "coef")
    if mode == "y_only":
        return y
    chroma = frames.blocks.where(F.col("channel") != "Y")
    grid = chroma.where((F.col("brow") == 0) & (F.col("bcol") == 0) & (F.col("channel") == "Cb")).select("image_id", F.col("bh").alias("ch"), F.col("bw").alias("cw"))
    places = y.drop("coef", "plane").join(grid, "image_id", "inner" if mode == "dc_only" else "left")
    # The chroma block that covers a luma block, for any grid.
    covering = lambda at, own, n: F.floor(F.col(at) / F.ceil(F.col(own) / F.col(n))).cast("int")
    places = places.withColumns({"cr": covering("brow", "bh", "ch"), "cc": covering("bcol", "bw", "cw")}).drop("ch", "cw")
    both = places.withColumn("channel", F.explode(F.array(F.lit("Cb"), F.lit("Cr"))))
    own = chroma.select("image_id", "channel", F.col("brow").alias("cr"), F.col("bcol").alias("cc"), "coef")
    both = both.join(own, ["image_id", "channel", "cr", "cc"], "left")
    plane = F.when(F.col("channel") == "Cb", 1).otherwise(2)
    zero = F.array_repeat(F.lit(0).cast("smallint"), 64)
    return y.unionByName(both.select("image_id", plane.alias("plane"), "brow", "bcol", "bh", "bw", F.coalesce("coef", zero).alias("coef")))


def tensors(frames: Frames, mode: str = "y_only", resize_blocks: tuple[int, int] | None = None) -> DataFrame:
    """(image_id, label, channels, height, width, features): features is (channels, height, width) in C order.

    resize_blocks cuts or zero-pads the grid at the bottom and right.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    rows = _values(frames, mode)
    if resize_blocks:
        rows = rows.where((F.col("brow") < resize_blocks[0]) & (F.col("bcol") < resize_blocks[1]))
        rows = rows.withColumns({"bh": F.lit(resize_blocks[0]), "bw": F.lit(resize_blocks[1])})
    key = F.struct("plane", "brow", "bcol").alias("at")
    kept = F.slice("coef", 1, 1) if mode == "dc_only" else F.col("coef")
    per = 1 if mode == "dc_only" else 64
    grouped = rows.select("image_id", "bh", "bw", key, kept.alias("coef")).groupBy("image_id", "bh", "bw").agg(F.map_from_entries(F.collect_list(F.struct("at", "coef"))).alias("by"), (F.max("at.plane") + 1).alias("planes"))

    def cell(plane: Column, k: Column, i: Column, j: Column) -> Column:
        here = F.struct(plane.cast("int").alias("plane"), i.cast("int").alias("brow"), j.cast("int").alias("bcol"))
        return F.coalesce(F.get(F.try_element_at("by", here), k), F.lit(0)).cast("float")

    size = F.col("bh") * F.col("bw")
    place = F.sequence(F.lit(0), F.col("planes") * per * size - 1)

    def value(n: Column) -> Column:
        channel, inside = F.floor(n / size), n % size
        return cell(F.floor(channel / per), (channel % per).cast("int"), F.floor(inside / F.col("bw")), inside % F.col("bw"))

    made = grouped.select("image_id", (F.col("planes") * per).alias("channels"), F.col("bh").alias("height"), F.col("bw").alias("width"), F.transform(place, value).alias("features"))
    return made.join(frames.images.select("image_id", "label"), "image_id").select("image_id", "label", "channels", "height", "width", "features")


def block_features(frames: Frames) -> DataFrame:
    """(image_id, channel, k, brow, bcol, value): the long form, which no group has to hold."""
    order = F.array_position(F.array(*map(F.lit, CHANNELS)), F.col("channel")) - 1
    return frames.blocks.select("image_id", order.cast("int").alias("plane"), "brow", "bcol", F.posexplode("coef").alias("k", "value"))


def normalised_pixels(pixels: DataFrame) -> DataFrame:
    """r, g and b as (x / 255 - 0.5) / 0.5."""
    return pixels.withColumns({c: (F.col(c) / 255.0 - 0.5) / 0.5 for c in "rgb"})
