"""Queries of aggregates, applications and kernels with their SQL twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specblock import kernels
from specblock.frames import Frames, floats
from specblock.functions import transform
from specblock.operators import adaptive, analysis, apps, metrics, pointwise, stencil
from specblock.plans import corpora
from specblock.plans.corpora import sql_list
from specblock.plans.registry import ORACLE_SQL, QUERIES
from specblock.plans.twins import CORPUS, block_rows, register

_COEF = "array_to_string({}, ',') AS coef"


def report(name: str, corpus: str, op, sql: str) -> None:
    """A query whose result is a report of op over frames, not frames."""
    QUERIES[name] = lambda spark, sf_dir: op(CORPUS[corpus](spark, sf_dir))
    ORACLE_SQL[name] = f"WITH {corpora.SQL[corpus]}\n{sql}"


def six(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded to six digits: sums differ in order between engines."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


_VALUES = "values_ AS (SELECT image_id, channel, brow, bcol, q, unnest(coef)::DOUBLE AS c, generate_subscripts(coef, 1) AS i FROM blocks)"


def adaptive_queries() -> None:
    out = "SELECT image_id, channel, brow, bcol, " + _COEF
    away = "CASE WHEN channel = 'Y' OR {n} = 1 THEN {at} + 0.5::DOUBLE ELSE 0.5::DOUBLE + {at} * (({whole} - 1)::DOUBLE / ({n} - 1)) END - {whole} / 2::DOUBLE"
    for corpus, whole in (("g5", 5), ("c420", 4)):
        dy, dx = away.format(at="brow", n="bh", whole=whole), away.format(at="bcol", n="bw", whole=whole)
        furthest = float(2 * (whole / 2) ** 2)
        weight = f"greatest(0::DOUBLE, least(1::DOUBLE, 1 - 0.7::DOUBLE * ((({dy}) * ({dy}) + ({dx}) * ({dx})) / {furthest}::DOUBLE)))::FLOAT"
        sql = f"SELECT image_id, channel, brow, bcol, {_COEF.format(f'list_transform(coef, lambda c: round_even(c::FLOAT * w, 0)::SMALLINT)')} FROM (SELECT *, {weight} AS w FROM blocks)"
        register(f"vignette_{corpus}", corpus, lambda f: adaptive.vignette(f, 0.7), sql)
    power = f"WITH {corpora.SQL['c420']}, {_VALUES}, power AS (SELECT image_id, channel, list(p ORDER BY i) AS p FROM (SELECT image_id, channel, i, avg(c * c) AS p FROM values_ GROUP BY ALL) GROUP BY ALL)\n"
    wiener = "list_transform(coef, lambda c, i: round_even(c::FLOAT * (CASE WHEN i = 1 THEN 1 WHEN p[i] > 0 THEN p[i] / (p[i] + 5::DOUBLE) ELSE 0 END)::FLOAT, 0)::SMALLINT)"
    register("wiener_c420", "c420", lambda f: adaptive.wiener_denoise(f), None)
    ORACLE_SQL["wiener_c420"] = power + out.format(wiener) + " FROM blocks JOIN power USING (image_id, channel)"
    level = "list_transform(coef, lambda c: round_even(round_even((c::FLOAT / s)::FLOAT, 0)::FLOAT * s, 0)::SMALLINT)"
    top = "SELECT *, greatest(1::DOUBLE, max(list_max(list_transform(coef, lambda c: abs(c)))) OVER (PARTITION BY image_id, channel) / 4::DOUBLE)::FLOAT AS s FROM blocks"
    register("posterize_c420", "c420", lambda f: adaptive.posterize(f), out.format(level) + f" FROM ({top})")


def two_sided(sides: list[np.ndarray], source: str, key: str) -> str:
    """SQL of CTEs that turn source (key, pr, pc, a, b, x) into out (key, u, v, z): the sum of S_pr X S_pc'."""
    lists = "[" + ",".join(sql_list_double(s) for s in sides) + "]"
    return f"""sides AS (SELECT {lists} AS s),
rows_ AS (SELECT {key}, pc, u, b, sum(s[pr + 1][u * 8 + a + 1] * x) AS y FROM {source}, sides, range(8) t(u) GROUP BY ALL),
out AS (SELECT {key}, u, v, sum(s[pc + 1][v * 8 + b + 1] * y) AS z FROM rows_, sides, range(8) t(v) GROUP BY ALL)"""


def sql_list_double(values) -> str:
    return "[" + ",".join(repr(float(v)) + "::DOUBLE" for v in np.asarray(values).reshape(-1)) + "]"


def kernel_queries() -> None:
    left, right = kernels.downscale_sides()
    key = "image_id, channel, brow, bcol, q"
    cells = f"{_VALUES}, cells AS (SELECT image_id, channel, (brow // 2)::INTEGER AS brow, (bcol // 2)::INTEGER AS bcol, q, (brow % 2)::INTEGER AS pr, (bcol % 2)::INTEGER AS pc, (i - 1) // 8 AS a, (i - 1) % 8 AS b, c * q[i] AS x FROM values_)"
    coef = "string_agg(round_even((z / q[u * 8 + v + 1])::FLOAT, 0)::INTEGER::VARCHAR, ',' ORDER BY u * 8 + v) AS coef"
    for corpus in ("g5", "c420"):
        register(f"downscale_{corpus}", corpus, lambda f: adaptive.downscale(f), None)
        ORACLE_SQL[f"downscale_{corpus}"] = f"WITH {corpora.SQL[corpus]}, {cells}, {two_sided([left, right], 'cells', key)}\nSELECT image_id, channel, brow, bcol, {coef} FROM out GROUP BY image_id, channel, brow, bcol"
    near = f"""{_VALUES}, cells AS (SELECT v.image_id, v.channel, (v.brow - da)::INTEGER AS brow, (v.bcol - db)::INTEGER AS bcol, v.q, (da + 1)::INTEGER AS pr, (db + 1)::INTEGER AS pc, (i - 1) // 8 AS a, (i - 1) % 8 AS b, c * v.q[i] AS x
  FROM values_ v, (VALUES (-1), (0), (1)) s(da), (VALUES (-1), (0), (1)) t(db)
  WHERE EXISTS (SELECT 1 FROM blocks o WHERE o.image_id = v.image_id AND o.channel = v.channel AND o.brow = v.brow - da AND o.bcol = v.bcol - db))"""
    for corpus, name in (("g8", "g8"), ("c420", "c420")):
        register(f"cross_block_blur_{name}", corpus, lambda f: stencil.cross_block_blur(f, 2.0), None)
        ORACLE_SQL[f"cross_block_blur_{name}"] = f"WITH {corpora.SQL[corpus]}, {near}, {two_sided(kernels.stencil_sides(2.0), 'cells', key)}\nSELECT image_id, channel, brow, bcol, {coef.replace('::FLOAT', '')} FROM out GROUP BY image_id, channel, brow, bcol"
    d = kernels.dct_matrix()
    decode = f"{_VALUES}, cells AS (SELECT image_id, channel, brow, bcol, q, 0 AS pr, 0 AS pc, (i - 1) // 8 AS a, (i - 1) % 8 AS b, c * q[i] AS x FROM values_), {two_sided([d.T], 'cells', key)}"
    again = two_sided([d], "bent", key).replace("sides AS", "sides2 AS").replace("sides,", "sides2,").replace("rows_", "rows2_").replace("out AS", "out2 AS")
    edges = f"""{decode}, px AS (SELECT image_id, channel, q, brow * 8 + u AS r, bcol * 8 + v AS c, z FROM out),
bent AS (SELECT p.image_id, p.channel, (p.r // 8)::INTEGER AS brow, (p.c // 8)::INTEGER AS bcol, p.q, 0 AS pr, 0 AS pc, p.r % 8 AS a, p.c % 8 AS b,
  abs(coalesce(n.z, 0) + coalesce(s.z, 0) + coalesce(w.z, 0) + coalesce(e.z, 0) - 4 * p.z) AS x
  FROM px p LEFT JOIN px n ON n.image_id = p.image_id AND n.r = p.r - 1 AND n.c = p.c LEFT JOIN px s ON s.image_id = p.image_id AND s.r = p.r + 1 AND s.c = p.c
  LEFT JOIN px w ON w.image_id = p.image_id AND w.r = p.r AND w.c = p.c - 1 LEFT JOIN px e ON e.image_id = p.image_id AND e.r = p.r AND e.c = p.c + 1), {again}"""
    register("cross_block_edges_g8", "g8", lambda f: stencil.cross_block_edges(f), None)
    ORACLE_SQL["cross_block_edges_g8"] = f"WITH {corpora.SQL['g8']}, {edges}\nSELECT image_id, channel, brow, bcol, {coef.replace('::FLOAT', '')} FROM out2 GROUP BY image_id, channel, brow, bcol"

    def decoded(f: Frames) -> DataFrame:
        rows = f.blocks.select("image_id", "channel", "brow", "bcol", transform.dequantize(F.col("coef"), F.col("q")).alias("dct"))
        return transform.idct2(rows).select("image_id", "channel", "brow", "bcol", F.posexplode("block").alias("k", "x")).withColumn("x", F.round("x", 4))

    report("idct_c420", "c420", decoded, f", {decode}\nSELECT image_id, channel, brow, bcol, (u * 8 + v)::INTEGER AS k, round(z, 4) AS x FROM out")
    ORACLE_SQL["idct_c420"] = f"WITH {corpora.SQL['c420']}, {decode}\nSELECT image_id, channel, brow, bcol, (u * 8 + v)::INTEGER AS k, round(z, 4) AS x FROM out"
    planes = f"""ycc AS (SELECT image_id, row, col, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS y, 128 - 0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b AS cb,
  128 + 0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b AS cr FROM pixels)"""

    def ycc(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = corpora.pixels(spark, sf_dir)
        names = zip(("y", "cb", "cr"), transform.rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b")), strict=True)
        return p.select("image_id", "row", "col", *(F.round(x, 4).alias(n) for n, x in names))

    QUERIES["rgb_to_ycbcr_pix"] = ycc
    ORACLE_SQL["rgb_to_ycbcr_pix"] = f"WITH {corpora.SQL['pix']}, {planes}\nSELECT image_id, row, col, round(y, 4) AS y, round(cb, 4) AS cb, round(cr, 4) AS cr FROM ycc"

    def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = corpora.pixels(spark, sf_dir)
        names = zip(("red", "green", "blue"), transform.ycbcr_to_rgb(F.col("r"), F.col("g"), F.col("b")), strict=True)
        return p.select("image_id", "row", "col", *(F.round(x, 4).alias(n) for n, x in names))

    clip = lambda x, n: f"round(greatest(0::DOUBLE, least(255::DOUBLE, {x})), 4) AS {n}"
    back = [("r + 1.402::DOUBLE * (b - 128)", "red"), ("r - 0.344136::DOUBLE * (g - 128) - 0.714136::DOUBLE * (b - 128)", "green"), ("r + 1.772::DOUBLE * (g - 128)", "blue")]
    QUERIES["ycbcr_to_rgb_pix"] = rgb
    ORACLE_SQL["ycbcr_to_rgb_pix"] = f"WITH {corpora.SQL['pix']}\nSELECT image_id, row, col, {', '.join(clip(x, n) for x, n in back)} FROM pixels"

    shifted = f"""cells AS (SELECT image_id, channel, (row // 8)::INTEGER AS brow, (col // 8)::INTEGER AS bcol, 0 AS pr, 0 AS pc, row % 8 AS a, col % 8 AS b, x - 128 AS x
  FROM (SELECT image_id, row, col, unnest([y, cb, cr]) AS x, unnest(['Y', 'Cb', 'Cr']) AS channel FROM ycc)), {two_sided([d], 'cells', 'image_id, channel, brow, bcol')}"""
    table = f"(CASE WHEN channel = 'Y' THEN {sql_list(corpora.LUMA)} ELSE {sql_list(corpora.CHROMA)} END)"
    QUERIES["from_array_pix"] = lambda spark, sf_dir: block_rows(transform.from_array(corpora.pixels(spark, sf_dir)))
    ORACLE_SQL["from_array_pix"] = f"""WITH {corpora.SQL['pix']}, {planes}, {shifted}
SELECT image_id, channel, brow, bcol, string_agg(round_even((z::FLOAT / {table}[u * 8 + v + 1])::FLOAT, 0)::INTEGER::VARCHAR, ',' ORDER BY u * 8 + v) AS coef FROM out GROUP BY ALL"""

    def forward(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = corpora.pixels(spark, sf_dir).withColumnRenamed("r", "y")
        rows = transform.dct2(transform.pixel_blocks(p.select("image_id", "row", "col", "y"), ["y"]))
        return rows.select("image_id", "brow", "bcol", F.posexplode("dct").alias("k", "x")).withColumn("x", F.round("x", 4) + 0.0)

    QUERIES["dct_pix"] = forward
    one = f"cells AS (SELECT image_id, (row // 8)::INTEGER AS brow, (col // 8)::INTEGER AS bcol, 0 AS pr, 0 AS pc, row % 8 AS a, col % 8 AS b, r - 128::DOUBLE AS x FROM pixels), {two_sided([d], 'cells', 'image_id, brow, bcol')}"
    ORACLE_SQL["dct_pix"] = f"WITH {corpora.SQL['pix']}, {one}\nSELECT image_id, brow, bcol, (u * 8 + v)::INTEGER AS k, round(z, 4) + 0 AS x FROM out"
    lists = lambda f: f.blocks.select("image_id", "channel", "brow", "bcol", F.array_join(F.transform(transform.quantize(F.col("coef"), F.col("q")), lambda x: x.cast("int")), ",").alias("quantized"), F.array_join(F.transform(transform.dequantize(F.col("coef"), F.col("q")), lambda x: x.cast("int")), ",").alias("dequantized"))
    report("quantize_c420", "c420", lists, "SELECT image_id, channel, brow, bcol, array_to_string(list_transform(coef, lambda c, i: round_even((c::FLOAT / q[i])::FLOAT, 0)::INTEGER), ',') AS quantized, array_to_string(list_transform(coef, lambda c, i: (c * q[i])::INTEGER), ',') AS dequantized FROM blocks")

    def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey")
        scaled = [F.array_join(F.transform(transform.scale_quant_table(floats(kernels.LUMINANCE), q), lambda x: x.cast("int")), ",").alias(f"q{q}") for q in (10, 50, 85)]
        return part.select("r_regionkey", *scaled)

    scaled = lambda q: f"array_to_string(list_transform({sql_list(kernels.LUMINANCE)}, lambda t: greatest(1, least(255, floor(t::DOUBLE * {kernels.quality_scale(q)!r}::DOUBLE + 0.5::DOUBLE)))::INTEGER), ',') AS q{q}"
    QUERIES["scale_quant_table"] = tables
    ORACLE_SQL["scale_quant_table"] = f"SELECT r_regionkey, {', '.join(map(scaled, (10, 50, 85)))} FROM region"

    def decoded_pixels(f: Frames) -> DataFrame:
        return transform.to_pixels(f)

    up = f"""{decode}, planes AS (SELECT image_id, channel, brow * 8 + u AS r, bcol * 8 + v AS c, z + 128 AS x FROM out),
joined AS (SELECT y.image_id, y.r, y.c, y.x AS y, b.x - 128 AS cb, d.x - 128 AS cr FROM planes y JOIN planes b ON b.image_id = y.image_id AND b.channel = 'Cb' AND b.r = y.r // 2 AND b.c = y.c // 2
  JOIN planes d ON d.image_id = y.image_id AND d.channel = 'Cr' AND d.r = y.r // 2 AND d.c = y.c // 2 WHERE y.channel = 'Y')"""
    level = lambda x, n: f"trunc(greatest(0::DOUBLE, least(255::DOUBLE, {x})))::INTEGER AS {n}"
    report("to_pixels_c420", "c420", decoded_pixels, "")
    ORACLE_SQL["to_pixels_c420"] = f"""WITH {corpora.SQL['c420']}, {up}
SELECT image_id, r::INTEGER AS "row", c::INTEGER AS col, {level('y + 1.402::DOUBLE * cr', 'r')}, {level('y - 0.344136::DOUBLE * cb - 0.714136::DOUBLE * cr', 'g')}, {level('y + 1.772::DOUBLE * cb', 'b')} FROM joined"""


def analysis_queries() -> None:
    a = analysis
    luma = "SELECT image_id, {} FROM blocks WHERE channel = 'Y' GROUP BY image_id"
    squares = "sum(list_sum(list_transform(coef, lambda c, i: CASE WHEN {} THEN c::BIGINT * c ELSE 0 END)))"
    nonzero = "sum(list_sum(list_transform(coef, lambda c, i: CASE WHEN i > 1 AND c <> 0 THEN 1 ELSE 0 END)))::BIGINT"
    stats = f"round(avg(coef[1]), 6) AS dc_mean, round(stddev_pop(coef[1]), 6) AS dc_std, {squares.format('i > 1')}::DOUBLE AS ac_energy, {nonzero} AS num_nonzero_ac, (count(*) * 63)::BIGINT AS total_ac"
    report("dct_stats_g8", "g8", lambda f: six(a.dct_stats(f), "dc_mean", "dc_std"), luma.format(stats))
    report("estimate_quality_c420", "c420", a.estimate_quality, f"SELECT DISTINCT image_id, greatest(1, least(100, round_even(CASE WHEN m > 1 THEN 50 / m ELSE 100 - 50 * m END, 0)))::INTEGER AS quality FROM blocks, (SELECT median(t) AS m FROM (SELECT unnest(list_transform({sql_list(corpora.LUMA)}, lambda q, i: q::DOUBLE / ({sql_list(kernels.LUMINANCE)})[i]::DOUBLE)) AS t))")
    high = squares.format("(i - 1) // 8 >= 4 OR (i - 1) % 8 >= 4")
    report("blur_score_g8", "g8", lambda f: six(a.detect_blur(f), "blur"), luma.format(f"round(CASE WHEN {squares.format('i > 1')} > 0 THEN 1 - {high}::DOUBLE / {squares.format('i > 1')} ELSE 1 END, 6) AS blur"))
    corner = "SELECT image_id, round(stddev_pop(c), 6) AS noise FROM (SELECT image_id, unnest([coef[55], coef[56], coef[63], coef[64]])::DOUBLE AS c FROM blocks WHERE channel = 'Y') GROUP BY image_id"
    report("noise_g8", "g8", lambda f: six(a.estimate_noise(f), "noise"), corner)
    report("texture_g8", "g8", lambda f: six(a.texture_complexity(f), "texture"), luma.format(f"round({nonzero}::DOUBLE / (count(*) * 63), 6) AS texture"))
    report(
        "dc_histogram_g8",
        "g8",
        lambda f: a.histogram_from_dct(f, 16),
        """, span AS (SELECT image_id, CASE WHEN min(coef[1]) = max(coef[1]) THEN min(coef[1]) - 0.5 ELSE min(coef[1]) END::DOUBLE AS low, CASE WHEN min(coef[1]) = max(coef[1]) THEN max(coef[1]) + 0.5 ELSE max(coef[1]) END::DOUBLE AS high FROM blocks WHERE channel = 'Y' GROUP BY 1),
counts AS (SELECT image_id, least(15, floor((coef[1] - low) * 16 / (high - low)))::INTEGER AS bin, count(*) AS n FROM blocks JOIN span USING (image_id) GROUP BY ALL)
SELECT s.image_id, b.bin::INTEGER AS bin, coalesce(n, 0)::BIGINT AS n FROM span s CROSS JOIN range(16) b(bin) LEFT JOIN counts c ON c.image_id = s.image_id AND c.bin = b.bin""",
    )
    ORACLE_SQL["dc_histogram_g8"] = ORACLE_SQL["dc_histogram_g8"].replace("\n, span", ", span")
    pairs = lambda f: f.images.select(F.col("image_id").alias("a"), (F.col("image_id") + 1).alias("b")).join(f.images.select(F.col("image_id").alias("b")), "b").select("a", "b")
    report("similarity_g8", "g8", lambda f: six(a.image_similarity(f, pairs(f)), "similarity"), "SELECT a, a + 1 AS b, round(greatest(0, least(1, (r + 1) / 2)), 6) AS similarity FROM (SELECT x.image_id AS a, corr(x.c, y.c) AS r FROM v x JOIN v y ON y.image_id = x.image_id + 1 AND y.brow = x.brow AND y.bcol = x.bcol AND y.i = x.i GROUP BY 1)")
    ORACLE_SQL["similarity_g8"] = f"WITH {corpora.SQL['g8']}, {_VALUES.replace('values_', 'v')}\n" + ORACLE_SQL["similarity_g8"].split("\n")[-1]
    for corpus, bh, bw in (("g8", "7", "7"), ("g5", "4", "4"), ("gall", "bh - 1", "19")):
        hashes = _hash_sql("blocks", bh, bw)
        report(f"phash_{corpus}", corpus, a.perceptual_hash, "")
        ORACLE_SQL[f"phash_{corpus}"] = f"WITH {corpora.SQL[corpus]}, {hashes}\nSELECT image_id, printf('%016x', h) AS phash_hex, {_SIGNED} AS phash FROM hashes"

    def distances(f: Frames) -> DataFrame:
        h = a.perceptual_hash(f)
        other = h.select(F.col("image_id").alias("b"), F.col("phash").alias("other"))
        return h.join(other, F.col("b") == F.col("image_id") + 1).select(F.col("image_id").alias("a"), "b", a.hamming_distance(F.col("phash"), F.col("other")).alias("distance"))

    report("hamming_g5", "g5", distances, "")
    ORACLE_SQL["hamming_g5"] = f"WITH {corpora.SQL['g5']}, {_hash_sql('blocks', '4', '4')}\nSELECT x.image_id AS a, y.image_id AS b, bit_count(xor(x.h, y.h))::INTEGER AS distance FROM hashes x JOIN hashes y ON y.image_id = x.image_id + 1"


_SIGNED = "CASE WHEN h >= 9223372036854775808 THEN (h::HUGEINT - 18446744073709551616)::BIGINT ELSE h::BIGINT END"


def _hash_sql(blocks: str, last_row: str, last_col: str) -> str:
    place = lambda i, last: f"(CASE WHEN {i} = 7 THEN {last} ELSE floor({i} * (({last}) / 7.0::DOUBLE)) END)"
    return f"""grid AS (SELECT image_id, i * 8 + j AS slot, coef[1] AS dc FROM {blocks}, range(8) r(i), range(8) c(j) WHERE channel = 'Y' AND brow = {place('i', last_row)} AND bcol = {place('j', last_col)}),
middles AS (SELECT image_id, median(dc) AS m FROM grid GROUP BY 1),
hashes AS (SELECT image_id, sum(CASE WHEN dc > m THEN (1::UBIGINT << (63 - slot)::UBIGINT)::HUGEINT ELSE 0 END)::UBIGINT AS h FROM grid JOIN middles USING (image_id) GROUP BY 1)"""


def with_copies(f: Frames) -> Frames:
    """Images, brighter copies (id + 1000) and strongly sharpened ones (id + 2000): duplicates to find.

    Over 1,000 images would meet their copies' ids there; these move by as many
    whole thousands as keep every id apart (the SQL twin fails on such tables).
    """
    step = 1000 * (1 + (f.images.agg(F.max("image_id")).first()[0] or 0) // 1000)

    def moved(g: Frames, by: int) -> Frames:
        number = F.col("image_id") + by
        path = F.concat(F.lit("image-"), number.cast("string"))
        return Frames(g.images.withColumns({"image_id": number, "path": path}), g.blocks.withColumn("image_id", number))

    parts = [f, moved(pointwise.adjust_brightness(f, 20.0), step), moved(pointwise.sharpen(f, 3.0), 2 * step)]
    union = lambda get: get(parts[0]).unionByName(get(parts[1])).unionByName(get(parts[2]))
    return Frames(union(lambda p: p.images), union(lambda p: p.blocks))


def app_queries() -> None:
    copies = f"""{corpora.SQL['g5']}, copies AS (SELECT image_id, channel, brow, bcol, coef FROM blocks
  UNION ALL SELECT image_id + 1000, channel, brow, bcol, list_transform(coef, lambda c, i: (CASE WHEN i = 1 THEN c + round_even(160::FLOAT / q[1], 0)::INTEGER ELSE c END)::SMALLINT) FROM blocks
  UNION ALL SELECT image_id + 2000, channel, brow, bcol, coef FROM blocks)"""
    chain = f"""links AS (SELECT x.image_id AS a, y.image_id AS b FROM hashes x JOIN hashes y ON bit_count(xor(x.h, y.h)) <= 5),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)"""
    sql = f"WITH RECURSIVE {copies}, {_hash_sql('copies', '4', '4')}, {chain}\nSELECT 'image-' || a AS path, min('image-' || b) AS group_id FROM reach GROUP BY a HAVING count(*) > 1"
    QUERIES["find_duplicates_g5"] = lambda spark, sf_dir: apps.find_duplicates(with_copies(corpora.g5(spark, sf_dir)))
    ORACLE_SQL["find_duplicates_g5"] = sql
    QUERIES["duplicate_groups_g5"] = lambda spark, sf_dir: apps.duplicate_groups(with_copies(corpora.g5(spark, sf_dir))).withColumn("paths", F.array_join("paths", ","))
    ORACLE_SQL["duplicate_groups_g5"] = f"WITH {sql.removeprefix('WITH ').split(chr(10) + 'SELECT')[0]}\nSELECT group_id, string_agg(path, ',' ORDER BY path) AS paths FROM (SELECT{sql.split(chr(10) + 'SELECT')[-1]}) GROUP BY group_id"
    combs = f"""{corpora.SQL['gall']}, v AS (SELECT image_id, unnest([1, 8, 9, 2, 16]) AS k, unnest([coef[2], coef[9], coef[10], coef[3], coef[17]])::INTEGER AS c FROM blocks WHERE channel = 'Y'),
counts AS (SELECT k, c, count(*) AS n FROM v WHERE abs(c) <= 48 GROUP BY ALL), ks AS (SELECT unnest([1, 8, 9, 2, 16]) AS k),
dense AS (SELECT ks.k, s.c, coalesce(n, 0) AS n FROM ks CROSS JOIN range(-48, 49) s(c) LEFT JOIN counts ON counts.k = ks.k AND counts.c = s.c),
bends AS (SELECT k, c, n, lead(n) OVER w - 2 * n + lag(n) OVER w AS bend FROM dense WINDOW w AS (PARTITION BY k ORDER BY c)),
scores AS (SELECT 0::BIGINT AS image_id, k, CASE WHEN sum(n) < 64 THEN 0 ELSE sum(abs(bend)) / (max(n) + 1e-9::DOUBLE) END AS score FROM bends GROUP BY k)"""
    report("comb_scores_gall", "gall", lambda f: six(apps.comb_scores(f), "score"), "")
    ORACLE_SQL["comb_scores_gall"] = f"WITH {combs}\nSELECT image_id, k::INTEGER AS k, round(score, 6) AS score FROM scores"
    report("forensics_gall", "gall", lambda f: apps.detect_double_compression(f, 5.0).withColumn("per_position", F.to_json("per_position")).drop("per_position"), "")
    ORACLE_SQL["forensics_gall"] = f"WITH {combs}\nSELECT image_id, round_even(avg(score), 3) AS score, avg(score) > 5 AS is_double FROM scores GROUP BY image_id"
    dc = "SELECT image_id, channel, brow, bcol, coef[1] * q[1]::DOUBLE / 8 + 128 AS x FROM blocks"
    level = lambda x, n: f"trunc(greatest(0::DOUBLE, least(255::DOUBLE, {x})))::INTEGER AS {n}"
    report("dc_thumbnail_c420", "c420", apps.dc_thumbnail, "")
    ORACLE_SQL["dc_thumbnail_c420"] = f"""WITH {corpora.SQL['c420']}, dc AS ({dc})
SELECT y.image_id, y.brow AS "row", y.bcol AS col, {level('y.x + 1.402::DOUBLE * (d.x - 128)', 'r')}, {level('y.x - 0.344136::DOUBLE * (b.x - 128) - 0.714136::DOUBLE * (d.x - 128)', 'g')}, {level('y.x + 1.772::DOUBLE * (b.x - 128)', 'b')}
FROM dc y JOIN dc b ON b.image_id = y.image_id AND b.channel = 'Cb' AND b.brow = y.brow // 2 AND b.bcol = y.bcol // 2
JOIN dc d ON d.image_id = y.image_id AND d.channel = 'Cr' AND d.brow = y.brow // 2 AND d.bcol = y.bcol // 2 WHERE y.channel = 'Y'"""
    report("dc_thumbnail_g5", "g5", apps.dc_thumbnail, "SELECT image_id, brow AS \"row\", bcol AS col, " + ", ".join(level("coef[1] * q[1]::DOUBLE / 8 + 128", n) for n in "rgb") + " FROM blocks")


def metric_queries() -> None:
    def pairs(pixels: DataFrame) -> DataFrame:
        ids = pixels.select("image_id").distinct()
        return ids.select(F.col("image_id").alias("a"), (F.col("image_id") + 1).alias("b")).join(ids.withColumnRenamed("image_id", "b"), "b").select("a", "b")

    def of(metric):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            p = corpora.pixels(spark, sf_dir)
            return six(metric(p, pairs(p)), metric.__name__)

        return run

    sums = "avg(((x.r - y.r) ** 2 + (x.g - y.g) ** 2 + (x.b - y.b) ** 2) / 3.0::DOUBLE)"
    joined = "FROM pixels x JOIN pixels y ON y.image_id = x.image_id + 1 AND y.row = x.row AND y.col = x.col GROUP BY 1, 2"
    for metric, value in ((metrics.mse, sums), (metrics.psnr, f"10 * log10(65025 / {sums})")):
        QUERIES[f"{metric.__name__}_pix"] = of(metric)
        ORACLE_SQL[f"{metric.__name__}_pix"] = f"WITH {corpora.SQL['pix']}\nSELECT x.image_id AS a, y.image_id AS b, round({value}, 6) AS {metric.__name__} {joined}"
    QUERIES["ssim_pix"] = of(metrics.ssim)
    QUERIES["blockiness_pix"] = lambda spark, sf_dir: six(metrics.blockiness(corpora.pixels(spark, sf_dir)), "blockiness")
    ORACLE_SQL["blockiness_pix"] = f"""WITH {corpora.SQL['pix']}, jumps AS (
  SELECT x.image_id, (x.row + 1) % 8 = 0 AS edge, abs(y.r - x.r) AS jump FROM pixels x JOIN pixels y ON y.image_id = x.image_id AND y.row = x.row + 1 AND y.col = x.col
  UNION ALL SELECT x.image_id, (x.col + 1) % 8 = 0, abs(y.r - x.r) FROM pixels x JOIN pixels y ON y.image_id = x.image_id AND y.row = x.row AND y.col = x.col + 1)
SELECT image_id, round(avg(jump) FILTER (WHERE edge) - avg(jump) FILTER (WHERE NOT edge), 6) AS blockiness FROM jumps GROUP BY image_id"""


adaptive_queries()
kernel_queries()
analysis_queries()
app_queries()
metric_queries()
