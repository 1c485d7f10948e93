"""Distributed prefix sums over a range-sorted table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from specblock.llm.common import shuffle_partitions
from specblock.session import cut


def prefix_sums(df: DataFrame, group: str | None, order: list[Column], value: str, name: str) -> DataFrame:
    """df with name: the sum of value over the rows before, in its group."""
    return prefix_folds(df, group, order, {value: name})


def prefix_folds(df: DataFrame, group: str | None, order: list[Column], values: dict[str, str], xor: bool = False) -> DataFrame:
    """df with, for each value (long, not null), its sum or xor over the rows before, in its group.

    Rows are dealt out by ranges of (group, order) and sorted, so one hot group
    spreads over many partitions.  Each partition folds what it holds of each
    group; the totals of partitions, at most one for each partition and group
    that it meets, give the offsets.  Ties of order sit in any one order, which
    a checkpoint fixes.  The result is written once (cut) before it is used.
    """
    key = [F.col(group).asc_nulls_last()] if group else []
    placed = df.repartitionByRange(shuffle_partitions(df), *key, *order).sortWithinPartitions(*key, *order)
    names = placed.columns
    at_values, at_group = [names.index(v) for v in values], names.index(group) if group else None
    fold, back = (np.bitwise_xor, np.bitwise_xor) if xor else (np.add, np.subtract)
    before_names = [f"__before_{v}" for v in values]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, [0] * len(at_values)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            change = np.zeros(n, bool)
            if at_group is not None:
                codes = batch.column(at_group).dictionary_encode(null_encoding="encode").indices.to_numpy()
                change[1:] = codes[1:] != codes[:-1]
                now = (batch.column(at_group)[0].as_py(),)
                change[0] = last is not None and now != last
                last = (batch.column(at_group)[n - 1].as_py(),)
            starts, part = np.flatnonzero(change), np.cumsum(change)
            found = []
            for k, at in enumerate(at_values):
                own = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
                before = fold(back(fold.accumulate(own), own), np.int64(carried[k]))
                if len(starts):
                    before = back(before, np.concatenate(([np.int64(0)], before[starts]))[part])
                carried[k] = int(fold(before[-1], own[-1]))
                found.append(pa.array(before))
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*names, *before_names])

    schema = StructType([*placed.schema.fields, *(StructField(b, LongType()) for b in before_names)])
    placed = cut(placed.mapInArrow(work, schema).withColumn("__part", F.spark_partition_id()))
    by = [F.col(group)] if group else []
    total = F.bit_xor if xor else F.sum
    totals = placed.groupBy(*by, "__part").agg(*(total(v).alias(v) for v in values))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offset = lambda v: F.coalesce(total(v).over(earlier), F.lit(0))
    offsets = totals.select(*([F.col(group).alias("__group")] if group else []), F.col("__part").alias("__p"), *(offset(v).alias(f"__offset_{v}") for v in values))
    on = placed["__part"] == offsets["__p"]
    if group:
        on = on & placed[group].eqNullSafe(offsets["__group"])
    whole = lambda v: F.col(f"__before_{v}").bitwiseXOR(F.col(f"__offset_{v}")) if xor else F.col(f"__before_{v}") + F.col(f"__offset_{v}")
    return placed.join(offsets, on).select(*names, *(whole(v).alias(n) for v, n in values.items()))
