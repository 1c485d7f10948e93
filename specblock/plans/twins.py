"""Queries of block operators with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specblock import kernels
from specblock.frames import Frames
from specblock.operators import geometry, pointwise
from specblock.plans import corpora
from specblock.plans.corpora import sql_list
from specblock.plans.registry import ORACLE_SQL, QUERIES

CORPUS = {"g8": corpora.g8, "g5": corpora.g5, "c420": corpora.c420, "gall": corpora.gall}


def block_rows(frames: Frames) -> DataFrame:
    """The block table in a form that compares by value: coefficients as text."""
    return frames.blocks.select("image_id", "channel", "brow", "bcol", F.array_join("coef", ",").alias("coef"))


def image_rows(frames: Frames) -> DataFrame:
    """Blocks beside the size and the first table of their image."""
    images = frames.images.select("image_id", "width", "height", "num_components", F.array_join(F.transform(F.col("quant_tables")[0], lambda x: x.cast("int")), ",").alias("table_0"))
    return block_rows(frames).join(images, "image_id")


def register(name: str, corpus: str, op: Callable[[Frames], Frames], sql: str | None, show: Callable[[Frames], DataFrame] = block_rows) -> None:
    """A query of op over a corpus; sql selects its rows from `blocks`."""
    QUERIES[name] = lambda spark, sf_dir: show(op(CORPUS[corpus](spark, sf_dir)))
    if sql:
        ORACLE_SQL[name] = f"WITH {corpora.SQL[corpus]}\n{sql}"


def _mapped(expression: str, where: str = "", scope: str | None = None) -> str:
    """SQL that maps coefficients: c is the value, i its place from 1."""
    new = f"list_transform(coef, lambda c, i: ({expression})::SMALLINT)"
    if scope:
        new = f"CASE WHEN {scope} THEN {new} ELSE coef END"
    return f"SELECT image_id, channel, brow, bcol, array_to_string({new}, ',') AS coef FROM blocks {where}"


def _weighted(weights, where: str = "", scope: str | None = None) -> str:
    return _mapped(f"round_even(c::FLOAT * ({sql_list(weights)})[i], 0)", where, scope)


def pointwise_queries() -> None:
    p, k = pointwise, kernels
    luma = "WHERE channel = 'Y'"
    is_y, is_chroma = "channel = 'Y'", "channel <> 'Y'"
    register("blur_g8", "g8", lambda f: p.blur(f, 2.0), _weighted(k.gaussian_envelope(2.0)))
    register("blur_chroma_c420", "c420", lambda f: p.blur(f, 3.0, "chroma"), _weighted(k.gaussian_envelope(3.0), scope=is_chroma))
    register("blur_luma_c420", "c420", lambda f: p.blur(f, 3.0, "luma"), _weighted(k.gaussian_envelope(3.0), scope=is_y))
    register("sharpen_g8", "g8", lambda f: p.sharpen(f), _weighted(k.sharpen_weights(1.5)))
    register("sharpen_c420", "c420", lambda f: p.sharpen(f), _weighted(k.sharpen_weights(1.5), scope=is_y))
    register("unsharp_mask_g8", "g8", lambda f: p.unsharp_mask(f), _weighted(k.unsharp_weights(2.0, 1.5)))
    register("box_blur_g8", "g8", lambda f: p.box_blur(f), _weighted(k.box_weights(2)))
    register("emboss_c420", "c420", lambda f: p.emboss(f), _weighted(k.emboss_weights(45.0), luma))
    for direction in ("both", "horizontal", "vertical"):
        register(f"sobel_{direction}_g8", "g8", lambda f, d=direction: p.sobel(f, d), _weighted(k.sobel_weights(direction)))
        register(f"scharr_{direction}_g8", "g8", lambda f, d=direction: p.scharr(f, d), _weighted(k.scharr_weights(direction)))
    register("edges_laplacian_c420", "c420", lambda f: p.detect_edges(f), _weighted(k.laplacian_weights(), luma))
    side = lambda name: f"(c::FLOAT * ({sql_list(name)})[i])"
    h, v = side(k.U / 7), side(k.V / 7)
    register("edges_gradient_g8", "g8", lambda f: p.detect_edges(f, "gradient"), _mapped(f"round_even(sqrt(({h} * {h} + {v} * {v})::DOUBLE)::FLOAT, 0)"))
    register("bandpass_g8", "g8", lambda f: p.bandpass(f), _mapped("CASE WHEN greatest((i - 1) // 8, (i - 1) % 8) BETWEEN 1 AND 6 THEN c ELSE 0 END"))
    dc = lambda new, scope=None: _mapped(f"CASE WHEN i = 1 THEN {new} ELSE c END", scope=scope)
    register("brightness_g8", "g8", lambda f: p.adjust_brightness(f, 30.0), dc("c + round_even(240::FLOAT / q[1], 0)::INTEGER"))
    register("brightness_c420", "c420", lambda f: p.adjust_brightness(f, -17.0), dc("c + round_even(-136::FLOAT / q[1], 0)::INTEGER", is_y))
    register("contrast_g8", "g8", lambda f: p.adjust_contrast(f, 1.5), _mapped("CASE WHEN i = 1 THEN c ELSE round_even(c::FLOAT * 1.5::FLOAT, 0) END"))
    warm = "CASE channel WHEN 'Cr' THEN 1 WHEN 'Cb' THEN -1 ELSE 0 END * round_even(40::FLOAT / q[1], 0)::INTEGER"
    register("color_temperature_c420", "c420", lambda f: p.adjust_color_temperature(f, 40.0), dc(f"c + {warm}"))
    register("saturation_c420", "c420", lambda f: p.adjust_saturation(f, 1.5), _mapped("round_even(c::FLOAT * 1.5::FLOAT, 0)", scope=is_chroma))
    register("deblock_c420", "c420", lambda f: p.jpeg_deblock(f, 0.7), _weighted(k.deblock_weights(0.7)))
    tint = "CASE WHEN i = 1 THEN CASE channel WHEN 'Cb' THEN -3 ELSE 4 END ELSE round_even(c::FLOAT * 0.1::FLOAT, 0) END"
    register("sepia_c420", "c420", p.sepia, _mapped(tint, scope=is_chroma))
    register("grayscale_c420", "c420", p.grayscale, _mapped("c", luma))
    register("solarize_g8", "g8", lambda f: p.solarize(f), _mapped("CASE WHEN abs(c) > 10 THEN -c ELSE c END"))
    register("prune_g8", "g8", lambda f: p.prune_coefficients(f), _mapped("CASE WHEN i > 1 AND abs(c) <= 2 THEN 0 ELSE c END"))
    new_q = f"(CASE WHEN channel = 'Y' THEN {sql_list(k.scaled_table(k.LUMINANCE, 50))} ELSE {sql_list(k.scaled_table(k.CHROMINANCE, 50))} END)[i]"
    register("requantize_c420", "c420", lambda f: p.requantize(f, 50), _mapped(f"round_even(c::FLOAT * q[i] / {new_q}, 0)"))


def geometry_queries() -> None:
    g = geometry

    def remapped(brow: str, bcol: str, coef: str, where: str = "") -> str:
        return f"SELECT image_id, channel, ({brow})::INTEGER AS brow, ({bcol})::INTEGER AS bcol, array_to_string({coef}, ',') AS coef FROM blocks {where}"

    odd_u, odd_v = "((i - 1) // 8) % 2 = 1", "(i - 1) % 2 = 1"
    sign = lambda cond: f"list_transform(coef, lambda c, i: CASE WHEN {cond} THEN -c ELSE c END)"
    turned = "list_transform(coef, lambda c, i: coef[8 * ((i - 1) % 8) + (i - 1) // 8 + 1])"
    turned_sign = lambda cond: f"list_transform(coef, lambda c, i: CASE WHEN {cond} THEN -coef[8 * ((i - 1) % 8) + (i - 1) // 8 + 1] ELSE coef[8 * ((i - 1) % 8) + (i - 1) // 8 + 1] END)"
    register("horizontal_flip_c420", "c420", g.horizontal_flip, remapped("brow", "bw - 1 - bcol", sign(odd_v)))
    register("vertical_flip_c420", "c420", g.vertical_flip, remapped("bh - 1 - brow", "bcol", sign(odd_u)))
    register("rotate180_c420", "c420", g.rotate180, remapped("bh - 1 - brow", "bw - 1 - bcol", sign(f"({odd_u}) <> ({odd_v})")))
    table = "'" + ",".join(str(int(corpora.LUMA[8 * v + u])) for u, v in zip(kernels.U, kernels.V, strict=True)) + "'"
    sized = remapped("bcol", "brow", turned).replace(" FROM blocks", f", 160::INTEGER AS width, (8 * bh)::INTEGER AS height, 1::INTEGER AS num_components, {table} AS table_0 FROM blocks")
    register("transpose_gall", "gall", g.transpose, sized.replace("160::INTEGER AS width, (8 * bh)::INTEGER AS height", "(8 * bh)::INTEGER AS width, 160::INTEGER AS height"), image_rows)
    register("rotate90_c420", "c420", g.rotate90, remapped("bcol", "bh - 1 - brow", turned_sign(odd_v)))
    register("rotate270_c420", "c420", lambda f: g.rotate(f, -90), remapped("bw - 1 - bcol", "brow", turned_sign(odd_u)))
    register("block_crop_g5", "g5", lambda f: g.block_crop(f, 1, 2, 3, 2), remapped("brow - 1", "bcol - 2", "coef", "WHERE brow BETWEEN 1 AND 3 AND bcol BETWEEN 2 AND 3"))
    inside = "WHERE CASE WHEN channel = 'Y' THEN brow BETWEEN 1 AND 3 AND bcol BETWEEN 2 AND 3 ELSE brow = 0 AND bcol = 1 END"
    cut = "CASE WHEN channel = 'Y' THEN {} ELSE {} END"
    register("block_crop_c420", "c420", lambda f: g.block_crop(f, 1, 2, 3, 2), remapped(cut.format("brow - 1", "brow"), cut.format("bcol - 2", "bcol - 1"), "coef", inside))


pointwise_queries()
geometry_queries()
