"""Queries of several stages: duplicate groups, double compression, thumbnails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specblock.frames import Frames
from specblock.operators.analysis import luma, perceptual_hash
from specblock.operators.graph import connected_components
from specblock.session import cut

#: Positions (u, v) whose value combs tell of double compression.
COMB_POSITIONS = ((0, 1), (1, 0), (1, 1), (0, 2), (2, 0))
COMB_RANGE = 48
COMB_LEAST = 64


def band_masks(distance: int, bits: int = 64) -> list[int]:
    """distance + 1 disjoint bands of bits: two hashes that near agree in one of them.

    A band takes every (distance + 1)-th bit: neighbouring samples of an image
    are alike, or the very same block, and tell least when they stand together.
    """
    return [sum(1 << p for p in range(i, bits, distance + 1)) for i in range(distance + 1)]


def near_hash_pairs(hashes: DataFrame, distance: int) -> DataFrame:
    """(a, b), a < b: distinct values of h (bigint) whose bits differ in 1..distance places.

    No pair is missed: it shares a band.  Values are distinct first, so equal
    hashes make no pairs; a crowded band is split by AQE's skew handling.
    """
    if not 0 <= distance < 16:
        raise ValueError("distance must lie in 0..15: narrower bands would pair everything")
    signed = [m - (1 << 64) if m >> 63 else m for m in band_masks(distance)]
    band = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col("h").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed))))
    keyed = hashes.select("h").distinct().select("h", band.alias("band")).select("h", "band.i", "band.bits")
    left, right = keyed.select("i", "bits", F.col("h").alias("a")), keyed.select("i", "bits", F.col("h").alias("b"))
    pairs = left.join(right, ["i", "bits"]).where(F.col("a") < F.col("b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b").distinct()


def find_duplicates(frames: Frames, max_distance: int = 5) -> DataFrame:
    """(path, group_id): images in groups of two or more whose 64-bit hashes chain within max_distance.

    group_id is the group's smallest path.
    """
    hashes = cut(frames.images.select("image_id", "path").join(perceptual_hash(frames), "image_id").select("path", F.col("phash").alias("h")))
    joined = connected_components(near_hash_pairs(hashes, max_distance))
    named = hashes.join(joined, hashes["h"] == joined["node"], "left").select("path", F.coalesce("component", "h").alias("label"))
    groups = named.groupBy("label").agg(F.min("path").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return named.join(groups, "label").select("path", "group_id")


def hash_folder(spark, root: str, hash_size: int = 8) -> DataFrame:
    """(path, phash_hex, phash) of the images of a folder and those below it; unreadable files are left out."""
    from specblock.sources.images import convert_to_dct, read_jpeg

    jpeg, other = read_jpeg(spark, root, permissive=True), convert_to_dct(spark, root)
    rest = other.images.join(jpeg.images.select("image_id"), "image_id", "left_anti")
    both = Frames(jpeg.images.unionByName(rest), jpeg.blocks.unionByName(other.blocks.join(rest.select("image_id"), "image_id", "left_semi")))
    return both.images.select("image_id", "path").join(perceptual_hash(both, hash_size), "image_id").select("path", "phash_hex", "phash")


def duplicate_groups(frames: Frames, max_distance: int = 5) -> DataFrame:
    """(group_id, paths): each group as one row of sorted paths."""
    return find_duplicates(frames, max_distance).groupBy("group_id").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def comb_scores(frames: Frames) -> DataFrame:
    """(image_id, k, score): how comb-like the values of each position are.

    The sum of the absolute second differences of the histogram of values
    within COMB_RANGE, over its largest count; 0 for under COMB_LEAST values.
    """
    places = [8 * u + v for u, v in COMB_POSITIONS]
    values = luma(frames).select("image_id", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("coef")[k].cast("int").alias("c")) for k in places))).alias("x"))
    values = values.select("image_id", "x.k", "x.c").where(F.abs("c") <= COMB_RANGE)
    counts = values.groupBy("image_id", "k", "c").agg(F.count("*").alias("n"))
    # At most 97 counts to a group.
    packed = counts.groupBy("image_id", "k").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("at"), F.sum("n").alias("total"), F.max("n").alias("top"))
    of = lambda c: F.coalesce(F.get(F.map_values(F.map_filter("at", lambda k, _: k == c)), F.lit(0)), F.lit(0))
    dense = packed.withColumn("hist", F.transform(F.sequence(F.lit(-COMB_RANGE), F.lit(COMB_RANGE)), of))
    inner = F.sequence(F.lit(1), F.lit(2 * COMB_RANGE - 1))
    bend = F.transform(inner, lambda i: F.abs(F.get("hist", i + 1) - 2 * F.get("hist", i) + F.get("hist", i - 1)))
    whole = F.aggregate(bend, F.lit(0).cast("long"), lambda a, x: a + x)
    found = dense.select("image_id", "k", F.when(F.col("total") < COMB_LEAST, 0.0).otherwise(whole / (F.col("top") + 1e-9)).alias("score"))
    every = frames.images.select("image_id", F.explode(F.array(*map(F.lit, places))).alias("k"))
    return every.join(found, ["image_id", "k"], "left").select("image_id", "k", F.coalesce("score", F.lit(0.0)).alias("score"))


def detect_double_compression(frames: Frames, threshold: float = 12.0) -> DataFrame:
    """(image_id, score, is_double, per_position): the mean comb score, over the threshold or not."""
    scores = comb_scores(frames)
    name = F.concat(F.lit("("), F.floor(F.col("k") / 8).cast("string"), F.lit(", "), (F.col("k") % 8).cast("string"), F.lit(")"))
    grouped = scores.groupBy("image_id").agg(
        F.avg("score").alias("mean"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("p"), F.bround("score", 3).alias("s"))))).alias("per_position")
    )
    return grouped.select("image_id", F.bround("mean", 3).alias("score"), (F.col("mean") > threshold).alias("is_double"), "per_position")


def channel_value(x: Column) -> Column:
    """A level cut to 0..255 and truncated."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), x)).cast("int")


def rgb_of(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    return y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)


def dc_thumbnail(frames: Frames) -> DataFrame:
    """(image_id, row, col, r, g, b): one pixel a luma block, from DC alone; gray images repeat their level.

    Chroma is taken from the block that covers the luma block, for any grid.
    """
    level = F.col("coef")[0] * F.col("q")[0].cast("double") / 8 + 128
    dc = frames.blocks.select("image_id", "channel", "brow", "bcol", "bh", "bw", level.alias("x"))
    y = dc.where(F.col("channel") == "Y").select("image_id", F.col("brow").alias("row"), F.col("bcol").alias("col"), F.col("bh").alias("lh"), F.col("bw").alias("lw"), F.col("x").alias("y"))
    grid = dc.where(F.col("channel") == "Cb").where((F.col("brow") == 0) & (F.col("bcol") == 0)).select("image_id", "bh", "bw")
    y = y.join(grid, "image_id", "left")
    scaled = lambda at, n, of: F.floor(F.col(at) / F.ceil(F.col(of) / F.col(n))).cast("int")
    y = y.withColumns({"brow": scaled("row", "bh", "lh"), "bcol": scaled("col", "bw", "lw")})
    chroma = dc.where(F.col("channel") != "Y").groupBy("image_id", "brow", "bcol").agg(F.max(F.when(F.col("channel") == "Cb", F.col("x"))).alias("cb"), F.max(F.when(F.col("channel") == "Cr", F.col("x"))).alias("cr"))
    both = y.join(chroma, ["image_id", "brow", "bcol"], "left")
    gray = F.col("cb").isNull()
    rgb = rgb_of(F.col("y"), F.col("cb"), F.col("cr"))
    return both.select("image_id", "row", "col", *(channel_value(F.when(gray, F.col("y")).otherwise(x)).alias(n) for n, x in zip("rgb", rgb, strict=True)))
