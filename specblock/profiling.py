"""How long a plan takes, and what its tasks used."""

from __future__ import annotations

import logging
import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class BenchmarkResult:
    name: str
    seconds: float
    rows_per_second: float | None = None


def run_to_end(df: DataFrame) -> None:
    """Every row of df is made and none kept."""
    df.write.format("noop").mode("overwrite").save()


def time_plan(name: str, make: Callable[[], DataFrame], warmup: int = 1, repeats: int = 3, rows: int | None = None) -> BenchmarkResult:
    """The median time of running make()'s plan to its last row."""
    for _ in range(warmup):
        run_to_end(make())
    times = []
    for _ in range(repeats):
        began = time.perf_counter()
        run_to_end(make())
        times.append(time.perf_counter() - began)
    seconds = statistics.median(times)
    return BenchmarkResult(name, seconds, rows / seconds if rows else None)


def configure_logging(level: int | str = logging.INFO) -> logging.Logger:
    """The library's logger, writing to standard error once."""
    logger = logging.getLogger("specblock")
    if not logger.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        logger.addHandler(handler)
    logger.setLevel(level)
    return logger
