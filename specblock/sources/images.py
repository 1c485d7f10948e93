"""Readers and writers of image files and of block tables."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specblock import kernels
from specblock.errors import BlockError, InvalidImageError
from specblock.frames import BLOCKS, CHANNELS, IMAGES, Frames
from specblock.sources import jpeg_codec

PATTERN = "*.{jpg,jpeg,png,bmp,JPG,JPEG,PNG,BMP}"


def detect_format(content: Column) -> Column:
    """png, jpeg, bmp or tiff by the first bytes, else null."""
    first = lambda n: F.hex(F.substring(content, 1, n))
    return (
        F.when(first(8) == "89504E470D0A1A0A", "png").when(first(2) == "FFD8", "jpeg").when(first(2) == "424D", "bmp").when(first(4).isin("49492A00", "4D4D002A"), "tiff")
    )


def binary_files(spark: SparkSession, path: str, pattern: str = PATTERN) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def validate_jpeg_files(files: DataFrame) -> DataFrame:
    """files with valid: whether each holds two bytes at least and starts as a JPEG file does."""
    return files.withColumn("valid", F.coalesce(detect_format(F.col("content")) == "jpeg", F.lit(False)))


def image_id(path: Column) -> Column:
    return F.xxhash64(path)


def labelled(images: DataFrame, root: str | None = None) -> DataFrame:
    """images with label: the rank of the parent folder among the classes; 0 where all lie in one folder."""
    named = images.withColumn("class", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    classes = sorted(r[0] for r in named.select("class").distinct().collect())
    rank = F.coalesce(*(F.when(F.col("class") == c, i) for i, c in enumerate(classes)), F.lit(0)).cast("int")
    return named.withColumn("label", rank).drop("class")


def _meta(jpeg: jpeg_codec.Jpeg) -> dict:
    idents = sorted(jpeg.tables)
    place = {ident: i for i, ident in enumerate(idents)}
    return {
        "width": jpeg.width,
        "height": jpeg.height,
        "num_components": 3 if len(jpeg.components) >= 3 else 1,
        "quant_tables": [jpeg.tables[i] for i in idents],
        "comp_info": [{"h": c.h, "v": c.v, "qt": place.get(c.qt, 0)} for c in jpeg.components],
    }


def _grid_batch(number: int, channel: str, grid: np.ndarray, q: list[float]) -> pa.RecordBatch:
    bh, bw = grid.shape[:2]
    n = bh * bw
    lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * n + 1, 64, dtype=np.int32)), pa.array(values, kind))
    columns = [
        pa.array(np.full(n, number)),
        pa.array([channel] * n, pa.string()),
        pa.array(np.repeat(np.arange(bh, dtype=np.int32), bw)),
        pa.array(np.tile(np.arange(bw, dtype=np.int32), bh)),
        pa.array(np.full(n, bh, np.int32)),
        pa.array(np.full(n, bw, np.int32)),
        lists(np.tile(np.asarray(q, np.float32), n), pa.float32()),
        lists(grid.reshape(-1).astype(np.int16), pa.int16()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["image_id", "channel", "brow", "bcol", "bh", "bw", "q", "coef"])


def read_jpeg(spark: SparkSession, path: str, permissive: bool = False) -> Frames:
    """Frames of JPEG files, decoded to coefficients on the executors.

    A file that cannot be read raises; with permissive it is left out, and
    `jpeg_errors` tells why.  A fourth component is dropped.
    """
    files = binary_files(spark, path)
    return decoded(files.select(image_id(F.col("path")).alias("image_id"), "path", "content"), permissive)


def decoded(files: DataFrame, permissive: bool = False) -> Frames:
    """Frames of JPEG contents: files (image_id, path, content)."""
    files = files.select("image_id", "path", "content")

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows.append({"image_id": number, "path": name, "label": 0, "source_path": name} | _meta(jpeg_codec.parse(content, headers_only=True)))
                except BlockError:
                    if not permissive:
                        raise
            yield pa.RecordBatch.from_pylist(rows, schema)

    def grids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    jpeg = jpeg_codec.parse(content)
                except BlockError:
                    if not permissive:
                        raise
                    continue
                for channel, c in zip(CHANNELS, jpeg.components if len(jpeg.components) >= 3 else jpeg.components[:1], strict=False):
                    q = jpeg.tables.get(c.qt) or next(iter(jpeg.tables.values()), kernels.LUMINANCE)
                    yield _grid_batch(number, channel, c.grid, q)

    schema = pa.schema(
        [
            ("image_id", pa.int64()),
            ("path", pa.string()),
            ("label", pa.int32()),
            ("width", pa.int32()),
            ("height", pa.int32()),
            ("num_components", pa.int32()),
            ("quant_tables", pa.list_(pa.list_(pa.float32()))),
            ("comp_info", pa.list_(pa.struct([("h", pa.int32()), ("v", pa.int32()), ("qt", pa.int32())]))),
            ("source_path", pa.string()),
        ]
    )
    return Frames(files.mapInArrow(headers, IMAGES), files.mapInArrow(grids, BLOCKS))


def jpeg_errors(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) of the files that cannot be decoded."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    jpeg_codec.parse(content)
                except BlockError as e:
                    found.append((name, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], ["path", "error"])

    return binary_files(spark, path).select("path", "content").mapInArrow(work, "path string, error string")


def convert_to_dct(spark: SparkSession, path: str, quality: int = 85) -> Frames:
    """Frames of images of any format that the JVM decodes, through pixels; alpha is dropped, gray stays gray."""
    rows = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)
    rows = rows.select(image_id(F.col("image.origin")).alias("image_id"), F.col("image.origin").alias("path"), *(F.col(f"image.{c}") for c in ("width", "height", "nChannels", "data")))
    luma, chroma = kernels.scaled_table(kernels.LUMINANCE, quality), kernels.scaled_table(kernels.CHROMINANCE, quality)
    d = kernels.dct_matrix()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, _, width, height, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bgr = np.frombuffer(data, np.uint8).reshape(height, width, n).astype(np.float64)
                for channel, plane in zip(CHANNELS, planes(bgr), strict=False):
                    q = np.asarray(luma if channel == "Y" else chroma)
                    grid = forward(plane, q, d)
                    yield _grid_batch(number, channel, grid, q.tolist())

    tables = lambda *t: F.array(*(F.lit(np.asarray(x, np.float32)) for x in t))
    gray = F.col("nChannels") == 1
    info = lambda *qt: F.array(*(F.struct(F.lit(1).alias("h"), F.lit(1).alias("v"), F.lit(x).alias("qt")) for x in qt))
    images = rows.select(
        "image_id",
        "path",
        F.lit(0).alias("label"),
        "width",
        "height",
        F.when(gray, 1).otherwise(3).alias("num_components"),
        F.when(gray, tables(luma)).otherwise(tables(luma, chroma)).alias("quant_tables"),
        F.when(gray, info(0)).otherwise(info(0, 1, 1)).alias("comp_info"),
        F.lit(None).cast("string").alias("source_path"),
    )
    return Frames(images, rows.mapInArrow(work, BLOCKS))


def planes(bgr: np.ndarray) -> list[np.ndarray]:
    """Luma, or luma and chroma, of an array with blue first."""
    if bgr.shape[2] == 1:
        return [bgr[:, :, 0]]
    b, g, r = bgr[:, :, 0], bgr[:, :, 1], bgr[:, :, 2]
    return [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]


def forward(plane: np.ndarray, q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Quantised coefficients (rows, columns, 64) of levels, padded to blocks with mid-gray."""
    h, w = plane.shape
    x = np.pad(plane - 128, ((0, -h % 8), (0, -w % 8)))
    blocks = x.reshape(x.shape[0] // 8, 8, x.shape[1] // 8, 8).transpose(0, 2, 1, 3)
    return np.rint((d @ blocks @ d.T).reshape(*blocks.shape[:2], 64) / q).astype(np.int16)


def encoded_jpeg(frames: Frames) -> DataFrame:
    """(image_id, path, content): each image as a baseline file with its own header and tables.

    A group holds the blocks of one image.
    """
    meta = frames.images.select("image_id", "path", "width", "height", "quant_tables", "comp_info")
    rows = frames.blocks.select("image_id", "channel", "brow", "bcol", "bh", "bw", "coef").join(meta, "image_id")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows.iloc[0]
        components = []
        for i, channel in enumerate(c for c in CHANNELS if (rows["channel"] == c).any()):
            own = rows[rows["channel"] == channel]
            grid = np.zeros((int(own["bh"].iloc[0]), int(own["bw"].iloc[0]), 64), np.int16)
            grid[own["brow"].to_numpy(), own["bcol"].to_numpy()] = np.stack(own["coef"].to_numpy())
            info = head["comp_info"][i]
            components.append((int(info["h"]), int(info["v"]), int(info["qt"]), grid))
        content = jpeg_codec.encode(int(head["width"]), int(head["height"]), [list(t) for t in head["quant_tables"]], components)
        return pd.DataFrame({"image_id": [head["image_id"]], "path": [head["path"]], "content": [content]})

    return rows.groupBy("image_id").applyInPandas(one, "image_id long, path string, content binary")


def write_jpeg(frames: Frames, folder: str, quality: int | None = None) -> DataFrame:
    """Writes <image_id>.jpg files to a folder that all executors mount; (path, bytes) of each.

    With quality, coefficients are requantised first.  Files are written under
    a temporary name and renamed, so a task that runs again does no harm.
    """
    from specblock.operators.pointwise import requantize

    return _write_files(encoded_jpeg(frames if quality is None else requantize(frames, quality)), folder, "jpg")


def _write_files(encoded: DataFrame, folder: str, ending: str) -> DataFrame:
    os.makedirs(folder, exist_ok=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes = [], []
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = os.path.join(folder, f"{number}.{ending}")
                part = f"{name}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, name)
                names.append(name)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return encoded.select("image_id", "content").mapInArrow(work, "path string, bytes long")


def png_bytes(rgb: np.ndarray) -> bytes:
    """A PNG file of an array (height, width, 3) of levels."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width, _ = rgb.shape
    lines = np.concatenate((np.zeros((height, 1), np.uint8), rgb.astype(np.uint8).reshape(height, -1)), axis=1)
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def encoded_png(pixels: DataFrame) -> DataFrame:
    """(image_id, content): each image of pixels (image_id, row, col, r, g, b) as a PNG file."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rgb = np.zeros((rows["row"].max() + 1, rows["col"].max() + 1, 3), np.uint8)
        rgb[rows["row"], rows["col"]] = rows[["r", "g", "b"]].to_numpy()
        return pd.DataFrame({"image_id": [rows["image_id"].iloc[0]], "content": [png_bytes(rgb)]})

    return pixels.groupBy("image_id").applyInPandas(one, "image_id long, content binary")


def write_png(pixels: DataFrame, folder: str) -> DataFrame:
    """Writes <image_id>.png files to a folder that all executors mount; (path, bytes) of each."""
    return _write_files(encoded_png(pixels), folder, "png")


def write_store(frames: Frames, folder: str) -> None:
    """The block store: Parquet with dc as a column of its own, images partitioned by label."""
    frames.blocks.withColumn("dc", F.col("coef")[0]).sortWithinPartitions("image_id", "channel", "brow", "bcol").write.mode("overwrite").parquet(f"{folder}/blocks")
    frames.images.write.mode("overwrite").partitionBy("label").parquet(f"{folder}/images")


def read_store(spark: SparkSession, folder: str) -> Frames:
    images = spark.read.parquet(f"{folder}/images")
    columns = [c.split()[0] for c in IMAGES.replace("array<struct<h:int,v:int,qt:int>>", "x").replace("array<array<float>>", "x").split(", ")]
    return Frames(images.select(columns), spark.read.parquet(f"{folder}/blocks").drop("dc"))


def dataset_info(files: DataFrame) -> DataFrame:
    """(extension, files, classes, megabytes) of a table with path and length."""
    rows = files.select(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("class"), "length")
    return rows.groupBy("extension").agg(F.count("*").alias("files"), F.count_distinct("class").alias("classes"), F.round(F.sum("length") / 1e6, 2).alias("megabytes"))


def require_jpeg(path: str) -> None:
    """Raises unless a local path is a JPEG file."""
    try:
        with open(path, "rb") as f:
            start = f.read(2)
    except OSError as e:
        raise InvalidImageError(f"cannot read {path}") from e
    if start != b"\xff\xd8":
        raise InvalidImageError(f"{path} is no JPEG file")
