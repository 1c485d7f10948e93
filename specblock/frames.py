"""The value that operators take and give: a table of images and one of blocks.

images(image_id, path, label, width, height, num_components, quant_tables,
       comp_info, source_path)
blocks(image_id, channel, brow, bcol, bh, bw, q, coef)

A block row holds 64 quantised coefficients, k = 8 u + v, with u the vertical
and v the horizontal frequency.  The grid of its channel (bh x bw) and its
quantisation table q stand beside it: they repeat within an image, cost next
to nothing in Parquet and are pruned where unused, and with them pointwise
and geometric operators are projections that neither join nor shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGES = (
    "image_id bigint, path string, label int, width int, height int, num_components int, "
    "quant_tables array<array<float>>, comp_info array<struct<h:int,v:int,qt:int>>, source_path string"
)
BLOCKS = "image_id bigint, channel string, brow int, bcol int, bh int, bw int, q array<float>, coef array<smallint>"
CHANNELS = ("Y", "Cb", "Cr")


@dataclass(frozen=True)
class Frames:
    images: DataFrame
    blocks: DataFrame

    def with_blocks(self, blocks: DataFrame) -> Frames:
        return replace(self, blocks=blocks)

    def with_coef(self, coef: Column, *channels: str) -> Frames:
        """New coefficients for the channels named (all, if none is)."""
        if channels:
            coef = F.when(F.col("channel").isin(*channels), coef).otherwise(F.col("coef"))
        return self.with_blocks(self.blocks.withColumn("coef", coef))

    def gray(self) -> Frames:
        """Luma alone, with its own table first and only."""
        info = F.array(F.struct(F.lit(1).alias("h"), F.lit(1).alias("v"), F.lit(0).alias("qt")))
        own = F.coalesce(F.get(F.col("comp_info"), F.lit(0))["qt"], F.lit(0))
        first = F.get("quant_tables", F.least(own, F.size("quant_tables") - 1))
        images = self.images.withColumns({"num_components": F.lit(1), "quant_tables": F.array(first), "comp_info": info})
        return Frames(images, self.blocks.where(F.col("channel") == "Y"))


def floats(values: np.ndarray) -> Column:
    """A literal ARRAY<FLOAT>."""
    return F.lit(np.asarray(values, np.float32).reshape(-1))


def rounded(x: Column) -> Column:
    """Half to even, as SMALLINT; a value beyond it raises under ANSI rules."""
    return F.rint(x).cast("smallint")


def pointwise(f: Callable[[Column, Column], Column]) -> Column:
    """coef through f(c as FLOAT, k), which must stay FLOAT, then rounded."""
    return F.transform("coef", lambda c, k: rounded(f(c.cast("float"), k)))


def weighted(weights: np.ndarray) -> Column:
    return F.zip_with("coef", floats(weights), lambda c, w: rounded(c.cast("float") * w))
