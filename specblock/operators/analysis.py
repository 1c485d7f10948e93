"""Statistics of luma coefficients: aggregates by image that combine before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specblock import kernels
from specblock.frames import Frames, floats


def luma(frames: Frames) -> DataFrame:
    return frames.blocks.where(F.col("channel") == "Y")


def luma_values(frames: Frames) -> DataFrame:
    """(image_id, brow, bcol, bw, k, c) of every luma coefficient."""
    return luma(frames).select("image_id", "brow", "bcol", "bw", F.posexplode("coef").alias("k", "c"))


def _sum_squares(column: str, keep) -> Column:
    return F.aggregate(F.filter(column, keep), F.lit(0).cast("long"), lambda a, c: a + c.cast("long") * c.cast("long"))


def dct_stats(frames: Frames) -> DataFrame:
    """(image_id, dc_mean, dc_std, ac_energy, num_nonzero_ac, total_ac)."""
    dc = F.col("coef")[0].cast("double")
    ac = F.slice("coef", 2, 63)
    rows = luma(frames).select("image_id", dc.alias("dc"), ac.alias("ac"))
    nonzero = F.size(F.filter("ac", lambda c: c != 0))
    return rows.groupBy("image_id").agg(
        F.avg("dc").alias("dc_mean"),
        F.stddev_pop("dc").alias("dc_std"),
        F.sum(_sum_squares("ac", lambda c: c != 0)).cast("double").alias("ac_energy"),
        F.sum(nonzero).alias("num_nonzero_ac"),
        (F.count("*") * 63).alias("total_ac"),
    )


def estimate_quality(frames: Frames) -> DataFrame:
    """(image_id, quality): from the median ratio of the first table to the standard one; 1..100."""
    ratios = F.array_sort(F.zip_with(F.col("quant_tables")[0], floats(kernels.LUMINANCE), lambda q, k: q.cast("double") / k.cast("double")))
    middle = (ratios[31] + ratios[32]) / 2
    estimate = F.rint(F.when(middle > 1, 50 / middle).otherwise(100 - 50 * middle))
    return frames.images.select("image_id", F.least(F.lit(100), F.greatest(F.lit(1), estimate.cast("int"))).alias("quality"))


def detect_blur(frames: Frames) -> DataFrame:
    """(image_id, blur): one less the share of high frequencies in the energy without DC; 1 if there is none."""
    high = [bool(u >= 4 or v >= 4) for u, v in zip(kernels.U, kernels.V, strict=True)]
    picked = F.aggregate(F.zip_with("coef", F.lit(high), lambda c, h: F.when(h, c.cast("long") * c.cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = luma(frames).withColumn("ac", F.slice("coef", 2, 63)).select("image_id", picked.alias("high"), _sum_squares("ac", lambda c: c != 0).alias("all"))
    total = F.sum("all").cast("double")
    return rows.groupBy("image_id").agg(F.when(total > 0, 1 - F.sum("high") / total).otherwise(1.0).alias("blur"))


def estimate_noise(frames: Frames) -> DataFrame:
    """(image_id, noise): the population deviation of the highest frequencies."""
    places = [int(8 * u + v) for u, v in zip(kernels.U, kernels.V, strict=True) if u >= 6 and v >= 6]
    rows = luma(frames).select("image_id", F.explode(F.array(*(F.col("coef")[p] for p in places))).alias("c"))
    return rows.groupBy("image_id").agg(F.stddev_pop(F.col("c").cast("double")).alias("noise"))


def texture_complexity(frames: Frames) -> DataFrame:
    """(image_id, texture): the share of nonzero coefficients without DC."""
    stats = dct_stats(frames)
    share = F.when(F.col("total_ac") > 0, F.col("num_nonzero_ac") / F.col("total_ac")).otherwise(0.0)
    return stats.select("image_id", share.alias("texture"))


def histogram_from_dct(frames: Frames, bins: int = 64) -> DataFrame:
    """(image_id, bin, n): DC values in equal bins over each image's own range, empty bins included."""
    dc = luma(frames).select("image_id", F.col("coef")[0].cast("double").alias("dc"))
    span = dc.groupBy("image_id").agg(F.min("dc").alias("low"), F.max("dc").alias("high"))
    flat = F.col("low") == F.col("high")
    span = span.select("image_id", F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"), F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"))
    place = F.least(F.lit(bins - 1), F.floor((F.col("dc") - F.col("low")) * bins / (F.col("high") - F.col("low")))).cast("int")
    counts = dc.join(span, "image_id").groupBy("image_id", place.alias("bin")).agg(F.count("*").alias("n"))
    every = span.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, ["image_id", "bin"], "left").select("image_id", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def image_similarity(frames: Frames, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs (a, b): Pearson's r of the common flat length, mapped to 0..1."""
    flat = luma(frames).select("image_id", (F.col("brow") * F.col("bw") + F.col("bcol")).alias("at"), "coef")
    left = pairs.join(flat.select(F.col("image_id").alias("a"), "at", F.col("coef").alias("x")), "a")
    both = left.join(flat.select(F.col("image_id").alias("b"), "at", F.col("coef").alias("y")), ["b", "at"])
    values = both.select("a", "b", F.explode(F.arrays_zip("x", "y")).alias("p")).select("a", "b", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    n, sx, sy = F.count("*"), F.sum("x"), F.sum("y")
    sums = values.groupBy("a", "b").agg(
        (n * F.sum(F.col("x") * F.col("y")) - sx * sy).alias("cov"),
        (n * F.sum(F.col("x") * F.col("x")) - sx * sx).alias("vx"),
        (n * F.sum(F.col("y") * F.col("y")) - sy * sy).alias("vy"),
        F.max(F.abs(F.col("x") - F.col("y")) - (1e-8 + 1e-5 * F.abs(F.col("y")))).alias("apart"),
    )
    scale = F.sqrt(F.col("vx")) * F.sqrt(F.col("vy"))
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("cov") / scale + 1) / 2))
    return sums.select("a", "b", F.when(scale > 0, r).otherwise(F.when(F.col("apart") <= 0, 1.0).otherwise(0.0)).alias("similarity"))


def perceptual_hash(frames: Frames, hash_size: int = 8) -> DataFrame:
    """(image_id, phash_hex, phash): bits of DC above the median over a hash_size grid, first bit highest.

    phash is the bit pattern as a BIGINT where it has 64 bits, else null.
    """
    if hash_size < 1:
        raise ValueError("hash_size must be at least 1")
    steps = F.sequence(F.lit(0), F.lit(hash_size - 1))

    def samples(n: str):
        last = F.col(n) - 1
        return F.transform(steps, lambda i: F.when(i == hash_size - 1, last).otherwise(F.floor(i * (last / float(max(1, hash_size - 1))))).cast("int") if hash_size > 1 else F.lit(0))

    at = lambda name, n, of: F.explode(F.filter(F.transform(samples(n), lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: x["s"] == F.col(of))).alias(name)
    rows = luma(frames).select("image_id", "brow", "bcol", "bh", "bw", F.col("coef")[0].alias("dc"))
    rows = rows.select("image_id", "bcol", "bw", "dc", at("r", "bh", "brow")).select("image_id", "dc", "r", at("c", "bw", "bcol"))
    grid = rows.select("image_id", (F.col("r.i") * hash_size + F.col("c.i")).alias("i"), "dc")
    # hash_size squared values of an image: a bounded group.
    packed = grid.groupBy("image_id").agg(F.median("dc").alias("middle"), F.array_sort(F.collect_list(F.struct("i", "dc"))).alias("v"))
    bits = F.array_join(F.transform("v", lambda x: F.when(x["dc"] > F.col("middle"), "1").otherwise("0")), "")
    n = hash_size * hash_size
    padded = F.lpad(bits, -(-n // 4) * 4, "0")
    digits = [F.lower(F.conv(F.substring(padded, 1 + 4 * d, 4), 2, 16)) for d in range(-(-n // 4))]
    whole = F.conv(bits, 2, -10).cast("bigint") if n == 64 else F.lit(None).cast("bigint")
    return packed.select("image_id", F.concat(*digits).alias("phash_hex"), whole.alias("phash"))


def hamming_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
