"""Block corpora made from the driver's numeric tables, and their DuckDB twins.

G8: gray images of 8 x 8 blocks, 64 vectors each.  GALL: one gray image of all
vectors, 20 blocks wide.  G5: gray images of 5 x 5.  C420: color images of 24
vectors, 16 luma blocks (4 x 4) and 4 of each chroma (2 x 2).  PIX: one
64 x 64 RGB pixel grid per 4,096 line items.  Only whole images are kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specblock import kernels
from specblock.frames import Frames, floats
from specblock.session import cut

QUALITY = 85
LUMA = kernels.scaled_table(kernels.LUMINANCE, QUALITY)
CHROMA = kernels.scaled_table(kernels.CHROMINANCE, QUALITY)


def _info(n: int, h: int = 1) -> Column:
    of = lambda h, qt: F.struct(F.lit(h).alias("h"), F.lit(h).alias("v"), F.lit(qt).alias("qt"))
    return F.array(*([of(1, 0)] if n == 1 else [of(h, 0), of(1, 1), of(1, 1)]))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    hundred = F.lit(100.0).cast("float")
    coef = F.transform("embedding", lambda x: F.rint(x * hundred).cast("smallint"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", coef.alias("coef"))


def _images(blocks: DataFrame, width: Column | int, height: Column | int, n: int, h: int = 1) -> DataFrame:
    size = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("int")
    tables = F.array(floats(LUMA), *([floats(CHROMA)] if n > 1 else []))
    first = blocks.where((F.col("channel") == "Y") & (F.col("brow") == 0) & (F.col("bcol") == 0))
    return first.select(
        "image_id",
        F.concat(F.lit("image-"), F.col("image_id").cast("string")).alias("path"),
        (F.col("image_id") % 2).cast("int").alias("label"),
        size(width).alias("width"),
        size(height).alias("height"),
        F.lit(n).alias("num_components"),
        tables.alias("quant_tables"),
        _info(n, h).alias("comp_info"),
        F.lit(None).cast("string").alias("source_path"),
    )


def _gray(spark: SparkSession, sf_dir: str, side: int) -> Frames:
    rows, per = _vectors(spark, sf_dir), side * side
    at = F.col("vec_id") % per
    blocks = rows.select(
        F.expr(f"vec_id div {per}").alias("image_id"),
        F.lit("Y").alias("channel"),
        F.floor(at / side).cast("int").alias("brow"),
        (at % side).cast("int").alias("bcol"),
        F.lit(side).alias("bh"),
        F.lit(side).alias("bw"),
        floats(LUMA).alias("q"),
        "coef",
    )
    whole = rows.count() // per
    blocks = blocks.where(F.col("image_id") < whole)
    return Frames(_images(blocks, 8 * side, 8 * side, 1), blocks)


def g8(spark: SparkSession, sf_dir: str) -> Frames:
    return _gray(spark, sf_dir, 8)


def g5(spark: SparkSession, sf_dir: str) -> Frames:
    return _gray(spark, sf_dir, 5)


def gall(spark: SparkSession, sf_dir: str) -> Frames:
    rows = _vectors(spark, sf_dir)
    bh = rows.count() // 20
    blocks = rows.where(F.col("vec_id") < 20 * bh).select(
        F.lit(0).cast("long").alias("image_id"),
        F.lit("Y").alias("channel"),
        F.expr("vec_id div 20").cast("int").alias("brow"),
        (F.col("vec_id") % 20).cast("int").alias("bcol"),
        F.lit(bh).alias("bh"),
        F.lit(20).alias("bw"),
        floats(LUMA).alias("q"),
        "coef",
    )
    return Frames(_images(blocks, 160, 8 * bh, 1), blocks)


def c420(spark: SparkSession, sf_dir: str) -> Frames:
    rows = _vectors(spark, sf_dir)
    j = F.col("vec_id") % 24
    luma = j < 16
    side = F.when(luma, 4).otherwise(2)
    at = F.when(luma, j).otherwise((j - 16) % 4)
    blocks = rows.where(F.expr("vec_id div 24") < rows.count() // 24).select(
        F.expr("vec_id div 24").alias("image_id"),
        F.when(luma, "Y").when(j < 20, "Cb").otherwise("Cr").alias("channel"),
        F.floor(at / side).cast("int").alias("brow"),
        (at % side).cast("int").alias("bcol"),
        side.alias("bh"),
        side.alias("bw"),
        F.when(luma, floats(LUMA)).otherwise(floats(CHROMA)).alias("q"),
        "coef",
    )
    return Frames(_images(blocks, 32, 32, 3, 2), blocks)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, row, col, r, g, b): 64 x 64 pixels to an image."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*order, "l_quantity", "l_discount", "l_tax")
    # Numbered by a distributed sort: a row's number is its partition's offset and its place within.
    placed = cut(items.repartitionByRange(*order).sortWithinPartitions(*order).select("l_quantity", "l_discount", "l_tax", F.monotonically_increasing_id().alias("id")))
    placed = placed.select(F.shiftright("id", 33).alias("part"), F.expr("id & 8589934591").alias("place"), *(F.col(f"l_{c}").alias(c) for c in ("quantity", "discount", "tax")))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    numbered = placed.join(offsets, "part").withColumn("n", F.col("offset") + F.col("place"))
    whole = items.count() // 4096
    n = F.col("n")
    level = lambda c, top: F.floor(F.col(c) * (255.0 / top)).cast("int")
    return numbered.where(n < whole * 4096).select(
        F.expr("n div 4096").alias("image_id"),
        F.expr("n % 4096 div 64").cast("int").alias("row"),
        (n % 64).cast("int").alias("col"),
        level("quantity", 50.0).alias("r"),
        level("discount", 0.1).alias("g"),
        level("tax", 0.08).alias("b"),
    )


def sql_list(values, kind: str = "FLOAT") -> str:
    """A DuckDB list literal with the very numbers of the Spark literal."""
    return "[" + ",".join(repr(float(np.float32(v))) for v in values) + f"]::{kind}[]"


_VECTOR_SQL = "vectors AS (SELECT vec_id, list_transform(embedding, lambda x: round_even(x * 100::FLOAT, 0)::SMALLINT) AS coef FROM embeddings), total AS (SELECT count(*) AS n FROM embeddings)"


def _gray_sql(side: int) -> str:
    per = side * side
    return f"""{_VECTOR_SQL}, blocks AS (
  SELECT vec_id // {per} AS image_id, 'Y' AS channel, ((vec_id % {per}) // {side})::INTEGER AS brow, (vec_id % {side})::INTEGER AS bcol,
         {side} AS bh, {side} AS bw, {sql_list(LUMA)} AS q, coef
  FROM vectors, total WHERE vec_id // {per} < n // {per})"""


SQL = {
    "g8": _gray_sql(8),
    "g5": _gray_sql(5),
    "gall": f"""{_VECTOR_SQL}, blocks AS (
  SELECT 0::BIGINT AS image_id, 'Y' AS channel, (vec_id // 20)::INTEGER AS brow, (vec_id % 20)::INTEGER AS bcol,
         (n // 20)::INTEGER AS bh, 20 AS bw, {sql_list(LUMA)} AS q, coef
  FROM vectors, total WHERE vec_id < 20 * (n // 20))""",
    "c420": f"""{_VECTOR_SQL}, parts AS (
  SELECT vec_id // 24 AS image_id, vec_id % 24 AS j, coef FROM vectors, total WHERE vec_id // 24 < n // 24), blocks AS (
  SELECT image_id, CASE WHEN j < 16 THEN 'Y' WHEN j < 20 THEN 'Cb' ELSE 'Cr' END AS channel,
         (CASE WHEN j < 16 THEN j // 4 ELSE (j - 16) % 4 // 2 END)::INTEGER AS brow, (CASE WHEN j < 16 THEN j % 4 ELSE (j - 16) % 2 END)::INTEGER AS bcol,
         CASE WHEN j < 16 THEN 4 ELSE 2 END AS bh, CASE WHEN j < 16 THEN 4 ELSE 2 END AS bw,
         CASE WHEN j < 16 THEN {sql_list(LUMA)} ELSE {sql_list(CHROMA)} END AS q, coef FROM parts)""",
    "pix": """pixels AS (
  SELECT n // 4096 AS image_id, (n % 4096 // 64)::INTEGER AS row, (n % 64)::INTEGER AS col,
         floor(l_quantity * (255.0::DOUBLE / 50.0))::INTEGER AS r, floor(l_discount * (255.0::DOUBLE / 0.1))::INTEGER AS g, floor(l_tax * (255.0::DOUBLE / 0.08))::INTEGER AS b
  FROM (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS n, * FROM lineitem)
  WHERE n < (SELECT count(*) // 4096 * 4096 FROM lineitem))""",
}
