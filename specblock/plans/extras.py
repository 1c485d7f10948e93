"""Queries of sources, features, resampling and augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specblock.frames import Frames
from specblock.functions import transform
from specblock.operators import augment, features, pointwise, resize
from specblock.operators.apps import dc_thumbnail
from specblock.plans import corpora
from specblock.plans.registry import ORACLE_SQL, QUERIES
from specblock.plans.twins import CORPUS, register
from specblock.session import stored
from specblock.sources import images

_SAME = "SELECT image_id, channel, brow, bcol, array_to_string(coef, ',') AS coef FROM blocks"


def _kept(f: Frames) -> Frames:
    return Frames(stored(f.images), stored(f.blocks))


def source_queries() -> None:
    for corpus in ("c420", "g5"):
        register(f"jpeg_roundtrip_{corpus}", corpus, lambda f: images.decoded(stored(images.encoded_jpeg(f))), _SAME)
    register("block_store_c420", "c420", _kept, _SAME)

    def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = images.encoded_jpeg(corpora.c420(spark, sf_dir))
        return images.validate_jpeg_files(files).select("image_id", images.detect_format(F.col("content")).alias("format"), "valid")

    QUERIES["detect_format_c420"] = formats
    ORACLE_SQL["detect_format_c420"] = f"WITH {corpora.SQL['c420']}\nSELECT DISTINCT image_id, 'jpeg' AS format, true AS valid FROM blocks"

    def one_block(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = corpora.c420(spark, sf_dir)
        at = f.blocks.where((F.col("brow") == F.when(F.col("channel") == "Y", 2).otherwise(1)) & (F.col("bcol") == F.when(F.col("channel") == "Y", 3).otherwise(1)))
        return at.select("image_id", "channel", "brow", "bcol", F.array_join("coef", ",").alias("coef"))

    QUERIES["inspect_block_c420"] = one_block
    ORACLE_SQL["inspect_block_c420"] = f"WITH {corpora.SQL['c420']}\n{_SAME} WHERE CASE WHEN channel = 'Y' THEN brow = 2 AND bcol = 3 ELSE brow = 1 AND bcol = 1 END"

    def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
        return transform.pad_to_blocks(corpora.pixels(spark, sf_dir).where("row < 61 and col < 50"), "r")

    QUERIES["pad_pix"] = padded
    ORACLE_SQL["pad_pix"] = f"""WITH {corpora.SQL['pix']}, small AS (SELECT * FROM pixels WHERE "row" < 61 AND col < 50)
SELECT i.image_id, y."row"::INTEGER AS "row", x.col::INTEGER AS col, coalesce(s.r, 0)::INTEGER AS r
FROM (SELECT DISTINCT image_id FROM small) i CROSS JOIN range(64) y("row") CROSS JOIN range(56) x(col) LEFT JOIN small s ON s.image_id = i.image_id AND s."row" = y."row" AND s.col = x.col"""


def feature_queries() -> None:
    def shown(mode: str, size: tuple[int, int] | None):
        def run(f: Frames) -> DataFrame:
            rows = features.tensors(f, mode, size)
            text = F.array_join(F.transform("features", lambda x: x.cast("int")), ",")
            return rows.select("image_id", "label", F.col("channels").cast("int").alias("channels"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), text.alias("features"))

        return run

    def sql(planes: str, per: int, n: int, h: int, w: int) -> str:
        return f"""planes AS ({planes}),
cells AS (SELECT image_id, plane * {per} + k AS ch, brow, bcol, coef[k + 1] AS c FROM planes, range({per}) t(k)),
dense AS (SELECT i.image_id, a.ch, y.brow, x.bcol, coalesce(c.c, 0) AS c FROM (SELECT DISTINCT image_id FROM blocks) i CROSS JOIN range({n}) a(ch) CROSS JOIN range({h}) y(brow) CROSS JOIN range({w}) x(bcol)
  LEFT JOIN cells c ON c.image_id = i.image_id AND c.ch = a.ch AND c.brow = y.brow AND c.bcol = x.bcol)
SELECT image_id, (image_id % 2)::INTEGER AS label, {n} AS channels, {h} AS height, {w} AS width, string_agg(c::INTEGER::VARCHAR, ',' ORDER BY ch, brow, bcol) AS features FROM dense GROUP BY image_id"""

    luma = "SELECT image_id, 0 AS plane, brow, bcol, coef FROM blocks WHERE channel = 'Y'"
    color = luma + """ UNION ALL SELECT y.image_id, CASE c.channel WHEN 'Cb' THEN 1 ELSE 2 END, y.brow, y.bcol, c.coef
  FROM blocks y JOIN blocks c ON c.image_id = y.image_id AND c.channel <> 'Y' AND c.brow = y.brow // 2 AND c.bcol = y.bcol // 2 WHERE y.channel = 'Y'"""
    for name, corpus, mode, size, text in (
        ("tensor_y_only_g5", "g5", "y_only", None, sql(luma, 64, 64, 5, 5)),
        ("tensor_y_only_resized_g5", "g5", "y_only", (3, 7), sql(luma, 64, 64, 3, 7)),
        ("tensor_ycbcr_c420", "c420", "ycbcr", None, sql(color, 64, 192, 4, 4)),
        ("tensor_ycbcr_gray_g5", "g5", "ycbcr", None, sql(luma, 64, 192, 5, 5)),
        ("tensor_dc_only_c420", "c420", "dc_only", None, sql(color, 1, 3, 4, 4)),
        ("tensor_dc_only_g5", "g5", "dc_only", (8, 8), sql(luma, 1, 1, 8, 8)),
    ):
        QUERIES[name] = lambda spark, sf_dir, c=corpus, m=mode, s=size: shown(m, s)(CORPUS[c](spark, sf_dir))
        ORACLE_SQL[name] = f"WITH {corpora.SQL[corpus]}, {text}"
    QUERIES["block_features_c420"] = lambda spark, sf_dir: features.block_features(corpora.c420(spark, sf_dir))
    ORACLE_SQL["block_features_c420"] = f"WITH {corpora.SQL['c420']}\nSELECT image_id, CASE channel WHEN 'Y' THEN 0 WHEN 'Cb' THEN 1 ELSE 2 END AS plane, brow, bcol, (generate_subscripts(coef, 1) - 1)::INTEGER AS k, unnest(coef) AS value FROM blocks"
    QUERIES["normalised_pixels_pix"] = lambda spark, sf_dir: features.normalised_pixels(corpora.pixels(spark, sf_dir)).select("image_id", "row", "col", *(F.round(c, 6).alias(c) for c in "rgb"))
    ORACLE_SQL["normalised_pixels_pix"] = f"WITH {corpora.SQL['pix']}\nSELECT image_id, \"row\", col, " + ", ".join(f"round(({c} / 255.0::DOUBLE - 0.5::DOUBLE) / 0.5::DOUBLE, 6) AS {c}" for c in "rgb") + " FROM pixels"


def resampling_queries() -> None:
    register("upscale_c420", "c420", lambda f: resize.upscale(f), None)
    QUERIES["sized_thumbnail_c420"] = lambda spark, sf_dir: resize.sized_thumbnail(dc_thumbnail(f := corpora.c420(spark, sf_dir)), f, 7)
    weights = resize.axis_weights(4, 7, "bilinear")
    taps = "(VALUES " + ", ".join(f"({to}, {at}, {w!r}::DOUBLE)" for to, at, w in weights) + ")"
    level = lambda c, s: f"greatest(0, least(255, floor(sum({c} * w) + 0.5::DOUBLE)))::INTEGER AS {c}"
    ORACLE_SQL["sized_thumbnail_c420"] = f"""WITH {ORACLE_SQL['dc_thumbnail_c420'].removeprefix('WITH ').replace('SELECT y.image_id', 'thumb AS (SELECT y.image_id', 1).replace(')' + chr(10) + 'thumb', '),' + chr(10) + 'thumb', 1)}),
wide AS (SELECT image_id, "row", t.c AS col, {', '.join(level(c, 'wide') for c in 'rgb')} FROM thumb JOIN {taps} t(c, s, w) ON thumb.col = t.s GROUP BY ALL)
SELECT image_id, t.c AS "row", col, {', '.join(level(c, 'tall') for c in 'rgb')} FROM wide JOIN {taps} t(c, s, w) ON wide."row" = t.s GROUP BY ALL"""


def augmentation_queries() -> None:
    register("brightness_jitter_c420", "c420", lambda f: augment.brightness_jitter(f, 30.0, 7), None)
    register("contrast_jitter_c420", "c420", lambda f: augment.contrast_jitter(f, 0.3, 7), None)
    register("gaussian_noise_c420", "c420", lambda f: augment.gaussian_noise(f, 3.0, 7), None)
    specs = ["hflip:p=0.5", "brightness_jitter:max_offset=20", "contrast_jitter:max_factor=0.3,p=0.7", "noise:sigma=2", "crop:block_rows=2,block_cols=2"]
    register("augmentation_pipeline_c420", "c420", augment.AugmentationPipeline(specs, 7), None)
    register("augmentation_flips_c420", "c420", augment.AugmentationPipeline(["hflip", "vflip", "no_such_thing"], 7), None)
    ORACLE_SQL["augmentation_flips_c420"] = ORACLE_SQL["rotate180_c420"]
    register("chained_filters_g8", "g8", lambda f: pointwise.adjust_contrast(pointwise.sharpen(pointwise.blur(f, 2.0)), 1.5), None)


def chained_sql() -> None:
    """Three filters, each rounded by itself."""
    from specblock import kernels

    step = lambda w, of: f"list_transform({of}, lambda c, i: round_even(c::FLOAT * ({corpora.sql_list(w)})[i], 0)::SMALLINT)"
    inner = step(kernels.sharpen_weights(1.5), step(kernels.gaussian_envelope(2.0), "coef"))
    last = f"list_transform({inner}, lambda c, i: (CASE WHEN i = 1 THEN c ELSE round_even(c::FLOAT * 1.5::FLOAT, 0) END)::SMALLINT)"
    ORACLE_SQL["chained_filters_g8"] = f"WITH {corpora.SQL['g8']}\nSELECT image_id, channel, brow, bcol, array_to_string({last}, ',') AS coef FROM blocks"


source_queries()
feature_queries()
resampling_queries()
augmentation_queries()
chained_sql()
