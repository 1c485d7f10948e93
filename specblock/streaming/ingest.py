"""Files that land in a folder, hashed as they come.

An extension beyond the block operators: the state is one row a perceptual
hash, kept until the watermark passes, so repeats within that time are told.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specblock.errors import BlockError
from specblock.sources import jpeg_codec

_FILES = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.jpg", per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream (path, modificationTime, length, content)."""
    reader = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger)
    return reader.load(folder)


def file_hash(content: bytes, size: int = 8) -> int | None:
    """The perceptual hash of a file's luma DC values as a signed 64-bit pattern; null if unreadable."""
    try:
        grid = jpeg_codec.parse(content).components[0].grid[:, :, 0]
    except BlockError:
        return None
    at = [np.floor(np.arange(size) * ((n - 1) / (size - 1))).astype(int) for n in grid.shape]
    for a, n in zip(at, grid.shape, strict=True):
        a[-1] = n - 1
    dc = grid[np.ix_(*at)].reshape(-1)
    bits = int("".join("1" if x else "0" for x in dc > np.median(dc)), 2)
    return bits - (1 << 64) if bits >> 63 else bits


def hashed_stream(files: DataFrame) -> DataFrame:
    """(path, modificationTime, phash) of a stream of files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [file_hash(c) for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.int64())], ["path", "modificationTime", "phash"])

    return files.select("path", "modificationTime", "content").mapInArrow(work, "path string, modificationTime timestamp, phash long")


def first_of_each(hashed: DataFrame, within: str = "1 hour") -> DataFrame:
    """The first file of each hash within the watermark."""
    return hashed.where(F.col("phash").isNotNull()).withWatermark("modificationTime", within).dropDuplicatesWithinWatermark(["phash"])


def windowed_counts(hashed: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, files, unreadable) by time of modification."""
    return hashed.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window)).agg(F.count("*").alias("files"), F.count_if(F.col("phash").isNull()).alias("unreadable"))
