"""JPEG coding against the JVM's own codec, readers, writers, the command line and streams."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from specblock import cli, kernels
from specblock.errors import BlockError, CodecError, InvalidImageError, UnsupportedFormatError
from specblock.operators import apps, pointwise
from specblock.sources import images, jpeg_codec
from specblock.streaming import ingest


def jvm_image(spark, pixels):
    """A BufferedImage of an array (h, w, 3) or (h, w)."""
    jvm, gray = spark._jvm, pixels.ndim == 2
    kind = jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY if gray else jvm.java.awt.image.BufferedImage.TYPE_3BYTE_BGR
    image = jvm.java.awt.image.BufferedImage(pixels.shape[1], pixels.shape[0], kind)
    raw = pixels if gray else pixels[:, :, ::-1]
    data = image.getRaster().getDataBuffer()
    for i, x in enumerate(raw.reshape(-1).tolist()):
        data.setElem(i, x)
    return image


def jvm_write(spark, pixels, path, kind="jpeg", quality=0.9, progressive=False):
    jvm = spark._jvm
    if kind != "jpeg":
        assert jvm.javax.imageio.ImageIO.write(jvm_image(spark, pixels), kind, jvm.java.io.File(path))
        return
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)  # explicit
    param.setCompressionQuality(quality)
    if progressive:
        param.setProgressiveMode(1)  # the writer's default scans
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(path))
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(jvm_image(spark, pixels), None, None), param)
    stream.close()


def jvm_read(spark, path):
    image = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.File(path))
    w, h = image.getWidth(), image.getHeight()
    if image.getRaster().getNumBands() == 1:  # getRGB would apply a gamma to gray levels
        level = np.array(list(image.getRaster().getSamples(0, 0, w, h, 0, spark.sparkContext._gateway.new_array(spark._jvm.int, w * h)))).reshape(h, w)
        return np.stack([level] * 3, axis=-1)
    rgb = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w)
    return np.stack([rgb >> 16 & 255, rgb >> 8 & 255, rgb & 255], axis=-1)


def smooth(h, w, seed=0):
    y, x = np.mgrid[0:h, 0:w]
    rng = np.random.default_rng(seed)
    waves = [127 + 90 * np.sin(x / (5 + 3 * c) + seed) * np.cos(y / (4 + 2 * c)) + rng.normal(0, 4, (h, w)) for c in range(3)]
    return np.clip(np.stack(waves, axis=-1), 0, 255).astype(np.uint8)


def decoded(jpeg):
    d = kernels.dct_matrix()
    out = []
    for c in jpeg.components:
        q = np.array(jpeg.tables[c.qt]).reshape(8, 8)
        x = d.T @ (c.grid.reshape(*c.grid.shape[:2], 8, 8) * q) @ d + 128
        out.append(x.transpose(0, 2, 1, 3).reshape(c.grid.shape[0] * 8, c.grid.shape[1] * 8))
    y = out[0][: jpeg.height, : jpeg.width]
    if len(out) == 1:
        return np.clip(np.stack([y] * 3, axis=-1), 0, 255)
    rows, cols = np.arange(jpeg.height), np.arange(jpeg.width)
    cb, cr = (p[np.ix_(rows * c.v // jpeg.components[0].v, cols * c.h // jpeg.components[0].h)] - 128 for p, c in zip(out[1:], jpeg.components[1:], strict=True))
    return np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1), 0, 255)


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("size", [(64, 64), (77, 101), (8, 8), (5, 3)])
def test_decoder_agrees_with_the_jvm(progressive, size, spark, tmp_path):
    path = str(tmp_path / "x.jpg")
    jvm_write(spark, smooth(*size), path, progressive=progressive)
    with open(path, "rb") as f:
        jpeg = jpeg_codec.parse(f.read())
    assert (jpeg.height, jpeg.width) == size
    # The luma channel is free of the upsampling that decoders choose.
    ours, theirs = decoded(jpeg), jvm_read(spark, path)
    luma = lambda p: p @ np.array([0.299, 0.587, 0.114])
    assert np.abs(luma(ours) - luma(theirs)).mean() < 2.5


def test_progressive_and_baseline_files_hold_the_same_coefficients(spark, tmp_path):
    grids = []
    for progressive in (False, True):
        path = str(tmp_path / f"{progressive}.jpg")
        jvm_write(spark, smooth(50, 70), path, progressive=progressive)
        with open(path, "rb") as f:
            grids.append([c.grid for c in jpeg_codec.parse(f.read()).components])
    assert all((a == b).all() for a, b in zip(*grids, strict=True))


@pytest.mark.parametrize("shape", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)]])
def test_encoder_round_trip_and_jvm_reads_it(shape, spark, tmp_path):
    rng = np.random.default_rng(2)
    height, width = 37, 53
    top_v, top_h = max(v for _, v in shape), max(h for h, _ in shape)
    up = lambda n, own, top: -(-n * own // (8 * top))
    tables = [kernels.scaled_table(kernels.LUMINANCE, 80), kernels.scaled_table(kernels.CHROMINANCE, 80)]
    grids = [(h, v, min(i, 1), np.rint(rng.laplace(0, 2 if i == 0 else 0.4, (up(height, v, top_v), up(width, h, top_h), 64)) * (rng.random(64) < 0.3)).astype(np.int16)) for i, (h, v) in enumerate(shape)]
    content = jpeg_codec.encode(width, height, tables, grids)
    back = jpeg_codec.parse(content)
    assert all((c.grid == g[3]).all() for c, g in zip(back.components, grids, strict=True))
    assert [back.tables[i] for i in range(2)] == tables
    path = str(tmp_path / "x.jpg")
    with open(path, "wb") as f:
        f.write(content)
    theirs, luma = jvm_read(spark, path), np.array([0.299, 0.587, 0.114])
    assert np.abs(decoded(back) @ luma - theirs @ luma).mean() < 3


def test_bad_files():
    with pytest.raises(InvalidImageError):
        jpeg_codec.parse(b"")
    with pytest.raises(InvalidImageError):
        jpeg_codec.parse(b"\xff\xd8\xff\xd9")
    with pytest.raises(UnsupportedFormatError):
        jpeg_codec.parse(b"\xff\xd8\xff\xc9\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00")
    with pytest.raises(CodecError):
        jpeg_codec.encode(8, 8, [[1.0] * 64], [(1, 1, 0, np.full((1, 1, 64), 2000, np.int16))])
    with pytest.raises(InvalidImageError):
        images.require_jpeg("/no/such/file")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    for i, name in enumerate(["cat/a.jpg", "cat/b.jpg", "dog/c.jpg"]):
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        jvm_write(spark, smooth(40, 48, i if i != 1 else 0), str(root / name))
    (root / "dog/broken.jpg").write_bytes(b"\xff\xd8 no image")
    jvm_write(spark, smooth(20, 24), str(root / "dog/d.png"), "png")
    jvm_write(spark, smooth(20, 24)[:, :, 0], str(root / "dog/e.bmp"), "bmp")
    return str(root)


def test_readers(spark, folder):
    files = images.binary_files(spark, folder)
    kinds = {os.path.basename(r.path): r.kind for r in files.select("path", images.detect_format(F.col("content")).alias("kind")).collect()}
    assert kinds == {"a.jpg": "jpeg", "b.jpg": "jpeg", "c.jpg": "jpeg", "broken.jpg": "jpeg", "d.png": "png", "e.bmp": "bmp"}
    frames = images.read_jpeg(spark, f"{folder}/cat")
    assert frames.images.count() == 2 and frames.blocks.where("channel = 'Y'").count() == 60
    loose = images.read_jpeg(spark, folder, permissive=True)
    assert loose.images.where("width is not null").count() == 3
    labels = {os.path.basename(r.path): r.label for r in images.labelled(loose.images).collect()}
    assert labels == {"a.jpg": 0, "b.jpg": 0, "c.jpg": 1}
    errors = images.jpeg_errors(spark, folder).where("path like '%broken%'").collect()
    assert len(errors) == 1 and "InvalidImageError" in errors[0].error
    with pytest.raises(Exception, match="InvalidImageError|no frame"):
        images.read_jpeg(spark, folder).blocks.count()
    info = {r.extension: (r.files, r.classes) for r in images.dataset_info(files).collect()}
    assert info == {"jpg": (4, 2), "png": (1, 1), "bmp": (1, 1)}


def test_convert_and_store(spark, folder, tmp_path):
    frames = images.convert_to_dct(spark, f"{folder}/dog", 90)
    assert {(os.path.basename(r.path), r.num_components) for r in frames.images.collect()} >= {("d.png", 3)}
    images.write_store(frames, str(tmp_path / "store"))
    back = images.read_store(spark, str(tmp_path / "store"))
    key = lambda f: sorted((r.image_id, r.channel, r.brow, r.bcol, tuple(r.coef)) for r in f.blocks.collect())
    assert key(back) == key(frames) and back.images.columns == frames.images.columns


def test_writer_keeps_coefficients(spark, folder, tmp_path):
    frames = pointwise.sharpen(images.read_jpeg(spark, f"{folder}/cat"))
    written = images.write_jpeg(frames, str(tmp_path / "out")).collect()
    assert len(written) == 2
    back = images.read_jpeg(spark, str(tmp_path / "out"))
    key = lambda f: sorted((r.channel, r.brow, r.bcol, tuple(r.coef)) for r in f.blocks.collect())
    assert key(back) == key(frames)
    images.write_jpeg(frames, str(tmp_path / "low"), quality=20).collect()
    assert images.read_jpeg(spark, str(tmp_path / "low")).images.first().quant_tables[0] == kernels.scaled_table(kernels.LUMINANCE, 20)


def test_command_line(spark, folder, tmp_path, capsys):
    cat = f"{folder}/cat"
    out = str(tmp_path / "out")
    for words in (["blur", cat, "-o", out, "--sigma", "3"], ["rotate", cat, "-o", out, "--degrees", "270", "--timing"], ["augment", cat, "-o", out, "--flip", "h", "--noise", "2"], ["convert", f"{folder}/dog/d.png", "-o", out]):
        assert cli.main(words, spark) == 0
    capsys.readouterr()
    for words, keys in (
        (["info", cat, "--json"], {"width", "quality", "dc_mean", "blur", "noise"}),
        (["inspect", cat, "--block", "1,2", "--json"], {"channel", "coef"}),
        (["apps", "dedup", cat, "--json"], {"group_id", "paths"}),
        (["apps", "forensics", cat, "--json"], {"score", "is_double"}),
        (["dataset", "info", cat, "--json"], {"extension", "files"}),
    ):
        assert cli.main(words, spark) == 0
        lines = capsys.readouterr().out.strip().splitlines()
        assert lines and keys <= set(json.loads(lines[0]))
    assert cli.main(["quality", cat], spark) == 0
    assert cli.main(["dataset", "prepare", cat, "--output", str(tmp_path / "store")], spark) == 0
    assert cli.main(["dataset", "bench", cat], spark) == 0
    assert cli.main(["apps", "thumbnail", cat, "--output", str(tmp_path / "thumb"), "--size", "4"], spark) == 0
    assert sorted(jvm_read(spark, str(p)).shape for p in (tmp_path / "thumb").glob("*.png")) == [(3, 4, 3)] * 2
    assert cli.main(["sharpen", cat, "-o", out, "--amount", "-1"], spark) == 1
    assert cli.main(["downscale", cat, "-o", out, "--factor", "3"], spark) == 1
    with pytest.raises(SystemExit):
        cli.main(["no-such-command"], spark)
    assert issubclass(CodecError, BlockError)


def test_png_and_folder_hashes(spark, folder, tmp_path):
    rgb = smooth(9, 14, 3)
    rows = [(5, y, x, *map(int, rgb[y, x])) for y in range(9) for x in range(14)]
    pixels = spark.createDataFrame(rows, "image_id long, row int, col int, r int, g int, b int")
    assert images.write_png(pixels, str(tmp_path / "png")).count() == 1
    assert (jvm_read(spark, str(tmp_path / "png/5.png")) == rgb).all()
    hashes = {os.path.basename(r.path): r.phash for r in apps.hash_folder(spark, folder).collect()}
    assert set(hashes) == {"a.jpg", "b.jpg", "c.jpg", "d.png", "e.bmp"} and hashes["a.jpg"] == hashes["b.jpg"] != hashes["c.jpg"]


def test_stream_of_files(spark, folder, tmp_path):
    hashed = ingest.hashed_stream(ingest.file_stream(spark, f"{folder}/*"))
    for name, frame in (("first", ingest.first_of_each(hashed)), ("counts", ingest.windowed_counts(hashed))):
        query = frame.writeStream.format("memory").queryName(name).outputMode("append" if name == "first" else "update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.table("first").count() == 2  # a.jpg and b.jpg hold the same picture
    assert spark.table("counts").agg(F.sum("files"), F.sum("unreadable")).first()[0] >= 4
