"""Filters that look at one coefficient at a time: projections of the block table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specblock import kernels
from specblock.frames import Frames, floats, pointwise, rounded, weighted


def _number(x: float) -> Column:
    return F.lit(float(x)).cast("float")


def blur(frames: Frames, sigma: float, channels: str = "all", cross_block: bool = False) -> Frames:
    """Gaussian envelope over frequencies: a larger sigma blurs less.

    With cross_block the blur is spatial instead, and a larger sigma blurs more.
    """
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    if cross_block:
        from specblock.operators.stencil import cross_block_blur

        return cross_block_blur(frames, sigma, channels)
    scope = {"all": ("Y", "Cb", "Cr"), "luma": ("Y",), "chroma": ("Cb", "Cr")}.get(channels)
    return frames.with_coef(weighted(kernels.gaussian_envelope(sigma)), *scope) if scope else frames


def sharpen(frames: Frames, amount: float = 1.5) -> Frames:
    if amount <= 0:
        raise ValueError("amount must be positive")
    return frames if amount == 1.0 else frames.with_coef(weighted(kernels.sharpen_weights(amount)), "Y")


def unsharp_mask(frames: Frames, sigma: float = 2.0, amount: float = 1.5) -> Frames:
    return frames.with_coef(weighted(kernels.unsharp_weights(sigma, amount)), "Y")


def box_blur(frames: Frames, radius: int = 2) -> Frames:
    return frames.with_coef(weighted(kernels.box_weights(radius)))


def emboss(frames: Frames, angle: float = 45.0) -> Frames:
    return frames.gray().with_coef(weighted(kernels.emboss_weights(angle)))


def sobel(frames: Frames, direction: str = "both") -> Frames:
    """`horizontal` weighs u, the vertical frequency, and `vertical` v."""
    return frames.gray().with_coef(weighted(kernels.sobel_weights(direction)))


def scharr(frames: Frames, direction: str = "both") -> Frames:
    return frames.gray().with_coef(weighted(kernels.scharr_weights(direction)))


def detect_edges(frames: Frames, method: str = "laplacian") -> Frames:
    if method == "laplacian":
        return frames.gray().with_coef(weighted(kernels.laplacian_weights()))
    if method != "gradient":
        raise ValueError("method must be laplacian or gradient")

    def gradient(c: Column, w) -> Column:
        h, v = c * w["u"], c * w["v"]
        return rounded(F.sqrt(h * h + v * v).cast("float"))

    sides = F.arrays_zip(floats(kernels.U / 7).alias("u"), floats(kernels.V / 7).alias("v"))
    return frames.gray().with_coef(F.zip_with("coef", sides, lambda c, w: gradient(c.cast("float"), w)))


def bandpass(frames: Frames, low_cutoff: int = 1, high_cutoff: int = 6) -> Frames:
    if low_cutoff > high_cutoff:
        raise ValueError("low_cutoff must not exceed high_cutoff")
    band = [max(u, v) for u, v in zip(kernels.U, kernels.V, strict=True)]
    kept = [1.0 if low_cutoff <= b <= high_cutoff else 0.0 for b in band]
    return frames.with_coef(F.zip_with("coef", floats(kept), lambda c, w: F.when(w == 1, c).otherwise(F.lit(0).cast("smallint"))))


def _shift_dc(step: Column) -> Column:
    """DC moved by step; the other coefficients are copied as one slice."""
    return F.concat(F.array((F.col("coef")[0].cast("int") + step.cast("int")).cast("smallint")), F.slice("coef", 2, 63))


def adjust_brightness(frames: Frames, offset: float) -> Frames:
    """offset in pixel levels; one level is 8 / q of the DC coefficient."""
    return frames if offset == 0 else frames.with_coef(_shift_dc(F.rint(_number(offset * 8.0) / F.col("q")[0])), "Y")


def adjust_contrast(frames: Frames, factor: float) -> Frames:
    if factor < 0:
        raise ValueError("factor must not be negative")
    if factor == 1.0:
        return frames
    return frames.with_coef(pointwise(lambda c, k: F.when(k == 0, c).otherwise(c * _number(factor))), "Y")


def adjust_color_temperature(frames: Frames, shift: float) -> Frames:
    """Cr rises and Cb falls by shift / q of the DC coefficient; rows of gray images are refused."""
    if shift == 0:
        return frames
    step = F.rint(_number(shift) / F.col("q")[0])
    warm = F.when(F.col("channel") == "Cr", _shift_dc(step)).when(F.col("channel") == "Cb", _shift_dc(-step)).otherwise(F.col("coef"))
    colored = F.when(F.col("num_components") == 1, F.raise_error("color temperature needs a color image")).otherwise(F.col("num_components")).cast("int")
    return Frames(frames.images.withColumn("num_components", colored), frames.blocks.withColumn("coef", warm))


def adjust_saturation(frames: Frames, factor: float) -> Frames:
    if factor < 0:
        raise ValueError("factor must not be negative")
    return frames if factor == 1.0 else frames.with_coef(pointwise(lambda c, _: c * _number(factor)), "Cb", "Cr")


def jpeg_deblock(frames: Frames, strength: float = 1.0) -> Frames:
    return frames.with_coef(weighted(kernels.deblock_weights(strength)))


def sepia(frames: Frames) -> Frames:
    """Chroma to a tenth, then DC to fixed quantised tints."""
    tint = F.when(F.col("channel") == "Cb", -3.0).otherwise(4.0).cast("float")
    return frames.with_coef(pointwise(lambda c, k: F.when(k == 0, tint).otherwise(c * _number(0.1))), "Cb", "Cr")


def grayscale(frames: Frames) -> Frames:
    return frames.gray()


def solarize(frames: Frames, threshold: int = 10) -> Frames:
    return frames.with_coef(F.transform("coef", lambda c: F.when(F.abs(c.cast("int")) > threshold, -c.cast("int")).otherwise(c.cast("int")).cast("smallint")))


def prune_coefficients(frames: Frames, threshold: int = 2) -> Frames:
    if threshold == 0:
        return frames
    zero = F.lit(0).cast("smallint")
    return frames.with_coef(F.transform("coef", lambda c, k: F.when((k > 0) & (F.abs(c.cast("int")) <= threshold), zero).otherwise(c)))


def requantize(frames: Frames, quality: int) -> Frames:
    """Coefficients re-expressed in the standard tables of a quality."""
    luma = floats(kernels.scaled_table(kernels.LUMINANCE, quality))
    chroma = floats(kernels.scaled_table(kernels.CHROMINANCE, quality))
    new_q = F.when(F.col("channel") == "Y", luma).otherwise(chroma)
    pairs = F.arrays_zip(F.col("q").alias("old"), new_q.alias("new"))
    coef = F.zip_with("coef", pairs, lambda c, p: rounded((c.cast("float") * p["old"] / p["new"]).cast("float")))
    color = F.col("num_components") > 1
    info = F.transform("comp_info", lambda x, i: F.struct(x["h"].alias("h"), x["v"].alias("v"), F.least(i, F.lit(1)).cast("int").alias("qt")))
    images = frames.images.withColumns({"quant_tables": F.when(color, F.array(luma, chroma)).otherwise(F.array(luma)), "comp_info": info})
    return Frames(images, frames.blocks.withColumns({"coef": coef, "q": new_q}))
