"""Block operators against numpy models, identities and argument checks."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specblock import kernels
from specblock.functions import transform
from specblock.operators import adaptive, analysis, augment, features, geometry, metrics, pointwise, resize, stencil
from specblock.plans import corpora


@pytest.fixture(scope="module")
def color(spark, sf_dir):
    return corpora.c420(spark, sf_dir)


@pytest.fixture(scope="module")
def gray(spark, sf_dir):
    return corpora.g5(spark, sf_dir)


def values(frames):
    return sorted((r.image_id, r.channel, r.brow, r.bcol, tuple(r.coef)) for r in frames.blocks.collect())


def grid(frames, number=0, channel="Y"):
    rows = frames.blocks.where((F.col("image_id") == number) & (F.col("channel") == channel)).collect()
    out = np.zeros((rows[0].bh, rows[0].bw, 8, 8))
    for r in rows:
        out[r.brow, r.bcol] = np.array(r.coef).reshape(8, 8)
    return out, np.array(rows[0].q).reshape(8, 8)


def decoded(coef, q):
    d = kernels.dct_matrix()
    x = d.T @ (coef * q) @ d
    return x.transpose(0, 2, 1, 3).reshape(coef.shape[0] * 8, coef.shape[1] * 8)


def test_dct_matrix_is_orthonormal():
    d = kernels.dct_matrix()
    assert np.allclose(d @ d.T, np.eye(8))
    assert np.isclose((d @ np.ones((8, 8)) @ d.T)[0, 0], 8)


@pytest.mark.parametrize("quality", [0, 101, -5])
def test_quality_range(quality):
    with pytest.raises(ValueError):
        kernels.quality_scale(quality)


@pytest.mark.parametrize(
    "call",
    [
        lambda f: pointwise.blur(f, 0),
        lambda f: pointwise.sharpen(f, 0),
        lambda f: pointwise.box_blur(f, 0),
        lambda f: pointwise.sobel(f, "diagonal"),
        lambda f: pointwise.detect_edges(f, "canny"),
        lambda f: pointwise.bandpass(f, 5, 2),
        lambda f: pointwise.adjust_contrast(f, -1),
        lambda f: pointwise.adjust_saturation(f, -1),
        lambda f: pointwise.requantize(f, 0),
        lambda f: adaptive.posterize(f, 0),
        lambda f: adaptive.downscale(f, 3),
        lambda f: resize.upscale(f, 3),
        lambda f: stencil.cross_block_blur(f, 0),
        lambda f: geometry.rotate(f, 45),
        lambda f: geometry.block_crop(f, -1, 0, 1, 1),
        lambda f: features.tensors(f, "pixels"),
        lambda f: analysis.perceptual_hash(f, 0),
    ],
)
def test_bad_arguments(call, gray):
    with pytest.raises(ValueError):
        call(gray)


@pytest.mark.parametrize(
    "same",
    [
        lambda f: pointwise.sharpen(f, 1.0),
        lambda f: pointwise.adjust_brightness(f, 0),
        lambda f: pointwise.adjust_contrast(f, 1.0),
        lambda f: pointwise.adjust_saturation(f, 1.0),
        lambda f: pointwise.prune_coefficients(f, 0),
        lambda f: pointwise.blur(f, 2.0, "none of these"),
        lambda f: adaptive.vignette(f, 0),
        lambda f: adaptive.downscale(f, 1),
        lambda f: augment.gaussian_noise(f, 0),
        lambda f: geometry.rotate(geometry.rotate(geometry.rotate(geometry.rotate(f, 90), 90), 90), 90),
        lambda f: geometry.transpose(geometry.transpose(f)),
        lambda f: geometry.rotate180(geometry.horizontal_flip(geometry.vertical_flip(f))),
        lambda f: pointwise.solarize(pointwise.solarize(f)),
        lambda f: pointwise.requantize(f, corpora.QUALITY),
    ],
)
def test_identities(same, color):
    assert values(same(color)) == values(color)


def test_too_large_a_crop_raises(gray):
    with pytest.raises(Exception, match="exceeds"):
        geometry.block_crop(gray, 3, 3, 3, 3).blocks.collect()


def test_temperature_refuses_gray(gray):
    with pytest.raises(Exception, match="color image"):
        pointwise.adjust_color_temperature(gray, 10).images.collect()


@pytest.mark.parametrize("turn", ["horizontal_flip", "vertical_flip", "transpose", "rotate180", "rotate90", "rotate270"])
def test_turns_equal_pixel_turns(turn, gray):
    model = {"horizontal_flip": np.fliplr, "vertical_flip": np.flipud, "transpose": np.transpose, "rotate180": lambda x: np.rot90(x, 2), "rotate90": lambda x: np.rot90(x, -1), "rotate270": np.rot90}[turn]
    assert np.allclose(decoded(*grid(getattr(geometry, turn)(gray))), model(decoded(*grid(gray))))


def test_downscale_means_pixels(gray):
    small, q = grid(adaptive.downscale(gray))
    big, _ = grid(gray)
    big = np.pad(big, ((0, 1), (0, 1), (0, 0), (0, 0)))
    mean = decoded(big, q).reshape(24, 2, 24, 2).mean(axis=(1, 3))
    d = kernels.dct_matrix()
    model = np.rint(d @ mean.reshape(3, 8, 3, 8).transpose(0, 2, 1, 3) @ d.T / q)
    assert np.abs(small - model).max() <= 1 and (small != model).mean() < 0.005  # a tie may fall either way


@pytest.mark.parametrize("sigma", [0.5, 2.0, 8.0])
def test_cross_block_blur_filters_patches(sigma, gray):
    done, q = grid(stencil.cross_block_blur(gray, sigma))
    pixels = np.pad(decoded(*grid(gray)), 8)
    g, d = kernels.reflected_gaussian(sigma), kernels.dct_matrix()
    for i, j in ((0, 0), (2, 3), (4, 4)):
        patch = g @ pixels[8 * i : 8 * i + 24, 8 * j : 8 * j + 24] @ g.T
        model = np.rint(d @ patch[8:16, 8:16] @ d.T / q)
        assert np.abs(done[i, j] - model).max() <= 1 and (done[i, j] != model).mean() < 0.05


def test_reflected_gaussian_reflects():
    g = kernels.reflected_gaussian(1.0)
    assert np.allclose(g.sum(axis=1), 1) and g[0, 0] > g[12, 12]


def test_patch_operation_identity(color):
    assert values(stencil.patch_operation(color, lambda p: p)) == values(color)


def test_wiener_without_noise_or_power(spark, gray):
    flat = gray.with_blocks(gray.blocks.withColumn("coef", F.transform("coef", lambda c, k: F.when(k == 3, 0).otherwise(c).cast("smallint"))))
    assert values(adaptive.wiener_denoise(flat, 0.0)) == values(flat)


def test_overflow_raises(gray):
    with pytest.raises(Exception, match="CAST_OVERFLOW|overflow"):
        pointwise.adjust_contrast(gray, 5000.0).blocks.collect()


def test_pixels_round_trip(spark):
    rng = np.random.default_rng(1)
    rows = [(7, int(y), int(x), int(r), int(g), int(b)) for y in range(13) for x in range(21) for r, g, b in [rng.integers(60, 190, 3)]]
    pixels = spark.createDataFrame(rows, "image_id long, row int, col int, r int, g int, b int")
    frames = transform.from_array(pixels, 100)
    assert frames.images.select("width", "height", "num_components").first()[:] == (21, 13, 3)
    back = transform.to_pixels(frames)
    assert back.count() == len(rows)
    pair = spark.createDataFrame([(7, 8)], "a long, b long")
    both = pixels.unionByName(back.withColumn("image_id", F.lit(8).cast("long")))
    assert metrics.psnr(both, pair).first().psnr > 40
    assert metrics.ssim(both, pair).first().ssim > 0.98
    same = pixels.unionByName(pixels.withColumn("image_id", F.lit(8).cast("long")))
    assert metrics.psnr(same, pair).first().psnr == float("inf")
    assert metrics.ssim(same, pair).first().ssim == pytest.approx(1.0)
    with pytest.raises(Exception, match="differ in shape"):
        metrics.mse(pixels.unionByName(same.where("image_id = 8 and row < 5")), pair).collect()


def test_gray_round_trip_and_odd_sizes(spark):
    rows = [(1, y, x, 2 * x + 3 * y) for y in range(19) for x in range(10)]
    frames = transform.from_array(spark.createDataFrame(rows, "image_id long, row int, col int, y int"), 100)
    back = {(r.row, r.col): r.r for r in transform.to_pixels(frames).collect()}
    assert all(abs(back[y, x] - v) <= 2 for _, y, x, v in rows) and len(back) == len(rows)


def test_brightness_is_calibrated(spark):
    rows = [(1, y, x, 100) for y in range(16) for x in range(16)]
    frames = transform.from_array(spark.createDataFrame(rows, "image_id long, row int, col int, y int"), 100)
    mean = transform.to_pixels(pointwise.adjust_brightness(frames, 30)).agg(F.avg("r")).first()[0]
    assert abs(mean - 130) <= 2


@pytest.mark.parametrize(("mode", "size"), [("4:4:4", (77, 101)), ("4:2:2", (77, 51)), ("4:2:0", (39, 51))])
def test_chroma_dimensions(mode, size):
    assert transform.chroma_dimensions(77, 101, mode) == size


def test_bad_subsampling():
    with pytest.raises(ValueError):
        transform.validate_subsampling("4:1:0")


def test_odd_grid_thumbnail_and_tensor(spark, sf_dir):
    """A luma grid of 5 x 5 over chroma of 3 x 3: each luma block takes the chroma block that covers it."""
    from specblock.frames import Frames, floats
    from specblock.operators import apps

    base = corpora.g5(spark, sf_dir)
    chroma = base.blocks.where("brow < 3 and bcol < 3").withColumns({"bh": F.lit(3), "bw": F.lit(3), "q": floats(corpora.CHROMA)})
    frames = Frames(base.images, base.blocks.unionByName(chroma.withColumn("channel", F.lit("Cb"))).unionByName(chroma.withColumn("channel", F.lit("Cr"))))
    assert apps.dc_thumbnail(frames).groupBy("image_id").count().where("count <> 25").isEmpty()
    row = features.tensors(frames, "dc_only").where("image_id = 0").first()
    cube = np.array(row.features).reshape(row.channels, row.height, row.width)
    cb = {(r.brow, r.bcol): r.coef[0] for r in chroma.where("image_id = 0").collect()}
    assert row.channels == 3 and all(cube[1, i, j] == cb[i // 2, j // 2] for i in range(5) for j in range(5))


def test_histogram_of_constant_image(spark, gray):
    flat = gray.with_blocks(gray.blocks.withColumn("coef", F.transform("coef", lambda c: F.lit(5).cast("smallint"))))
    counts = {r.bin: r.n for r in analysis.histogram_from_dct(flat, 4).where("image_id = 0").collect()}
    assert counts == {0: 0, 1: 0, 2: 25, 3: 0}


def test_flat_images_scores(gray):
    zero = gray.with_blocks(gray.blocks.withColumn("coef", F.array_repeat(F.lit(0).cast("smallint"), 64)))
    assert analysis.detect_blur(zero).first().blur == 1.0
    assert analysis.texture_complexity(zero).first().texture == 0.0
    pair = zero.images.where("image_id = 0").select(F.col("image_id").alias("a"), (F.col("image_id") + 1).alias("b"))
    assert analysis.image_similarity(zero, pair).first().similarity == 1.0


@pytest.mark.parametrize("size", [1, 2, 5, 8, 11])
def test_hash_sizes(size, gray):
    row = analysis.perceptual_hash(gray, size).where("image_id = 3").first()
    dc = grid(gray, 3)[0][:, :, 0, 0]
    at = [int(i * (4 / (size - 1))) if i < size - 1 else 4 for i in range(size)] if size > 1 else [0]
    picked = dc[np.ix_(at, at)].reshape(-1)
    bits = "".join("1" if x else "0" for x in picked > np.median(picked))
    assert row.phash_hex == format(int(bits, 2), f"0{-(-size * size // 4)}x")


def test_augmentations_depend_on_seed_and_image_only(color):
    pipeline = augment.AugmentationPipeline(["noise:sigma=2", "brightness_jitter", "crop:block_rows=2,block_cols=2"], 3)
    once = values(pipeline(color))
    shuffled = color.with_blocks(color.blocks.repartition(7))
    assert once == values(pipeline(shuffled))
    pipeline.reseed(4)
    assert once != values(pipeline(color))
    assert pipeline(color).images.where("width <> 16 or height <> 16").isEmpty()


def test_probability_splits_images(color):
    flipped = augment.AugmentationPipeline(["hflip:p=0.5"], 1)(color)
    changed = {a[0] for a, b in zip(values(flipped), values(color), strict=True) if a != b}
    assert 0 < len(changed) < color.images.count()


@given(st.text("abc", min_size=1, max_size=5), st.dictionaries(st.sampled_from(["p", "sigma", "seed"]), st.integers(0, 9) | st.floats(0, 9, width=16), max_size=3))
@settings(max_examples=30, deadline=None)
def test_spec_parser(name, numbers):
    text = name + (":" + ",".join(f"{k}={v}" for k, v in numbers.items()) if numbers else "")
    parsed = augment.parse_augmentation(text)
    assert parsed == {"name": name} | numbers
    assert all(isinstance(v, int) == float(v).is_integer() for k, v in parsed.items() if k != "name")


def test_resize_keeps_constants_and_means(spark):
    rows = [(1, y, x, 90, 10 * x, 10 * y) for y in range(8) for x in range(8)]
    rows += [(2, y, x, 90, 1, 1) for y in range(3) for x in range(5)]
    sizes = spark.createDataFrame([(1, 8, 8, 16, 16), (2, 3, 5, 2, 9)], "image_id long, height int, width int, new_height int, new_width int")
    done = resize.resize(spark.createDataFrame(rows, "image_id long, row int, col int, r int, g int, b int"), sizes, "lanczos").collect()
    assert {(p.row, p.col) for p in done if p.image_id == 2} == {(y, x) for y in range(2) for x in range(9)}
    big = [p for p in done if p.image_id == 1]
    assert len(big) == 256 and all(p.r == 90 for p in big)
    assert abs(np.mean([p.g for p in big]) - 35) < 1


def test_strict_blocks_and_profiling(spark):
    from specblock import profiling

    rows = [(1, y, x, 7) for y in range(8) for x in range(9)]
    pixels = spark.createDataFrame(rows, "image_id long, row int, col int, y int")
    with pytest.raises(Exception, match="BlockBoundaryError"):
        transform.pixel_blocks(pixels, ["y"], strict=True).collect()
    assert transform.pixel_blocks(pixels.where("col < 8"), ["y"], strict=True).count() == 1
    assert profiling.time_plan("pixels", lambda: pixels, repeats=1, rows=72).rows_per_second > 0
    assert profiling.configure_logging("INFO").name == "specblock"


def test_models(spark, color):
    from specblock.operators import learn

    bright = color.with_blocks(color.blocks.withColumn("coef", F.when(F.col("image_id") % 2 == 1, F.transform("coef", lambda c: (c * 3).cast("smallint"))).otherwise(F.col("coef"))))
    rows = learn.spectrum_features(bright).cache()
    assert learn.accuracy(learn.fit_linear(rows), rows) > 0.95

    def make():
        return lambda x: x.reshape(len(x), -1).mean(axis=1, keepdims=True)

    told = learn.predictions(color, make, "dc_only").collect()
    tensors = {r.image_id: np.mean(r.features) for r in features.tensors(color, "dc_only").collect()}
    assert len(told) == len(tensors) and all(r.prediction[0] == pytest.approx(tensors[r.image_id], abs=1e-3) for r in told)


def test_noise_is_normal_and_keyed():
    n = np.arange(2000)
    x = augment.block_normals(5, 0, n, n % 7, n % 11)
    assert abs(x.mean()) < 0.01 and abs(x.std() - 1) < 0.01 and abs((x**3).mean()) < 0.05 and abs((x**4).mean() - 3) < 0.1
    assert abs(np.corrcoef(x[:, 3], x[:, 35])[0, 1]) < 0.1 and len(np.unique(x)) == x.size
    assert (augment.block_normals(5, 0, n[::-1], n[::-1] % 7, n[::-1] % 11)[::-1] == x).all()
    assert (augment.block_normals(6, 0, n, n % 7, n % 11) != x).mean() > 0.99
