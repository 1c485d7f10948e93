"""Feature tables into models.

Networks need a library that is not part of this one: `predictions` runs any
batch function over tensors on the executors.  `fit_linear` is a stand-in that
needs Spark alone, on mean DC and spectrum features of bounded width.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from specblock.frames import CHANNELS, Frames
from specblock.operators.features import tensors


def spectrum_features(frames: Frames) -> DataFrame:
    """(image_id, label, features): the mean magnitude of each position of each channel; 192 numbers, zero where absent."""
    values = frames.blocks.select("image_id", "channel", F.posexplode("coef").alias("k", "c"))
    plane = F.array_position(F.array(*map(F.lit, CHANNELS)), F.col("channel")) - 1
    means = values.groupBy("image_id", (plane * 64 + F.col("k")).cast("int").alias("at")).agg(F.avg(F.abs(F.col("c").cast("double"))).alias("m"))
    packed = means.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "m"))).alias("by"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(191)), lambda i: F.coalesce(F.try_element_at("by", i), F.lit(0.0)))
    return packed.join(frames.images.select("image_id", "label"), "image_id").select("image_id", "label", dense.alias("features"))


def fit_linear(features: DataFrame, iterations: int = 50, ridge: float = 1e-3) -> LogisticRegressionModel:
    """A multinomial logistic regression on (label, features)."""
    rows = features.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))
    return LogisticRegression(maxIter=iterations, regParam=ridge).fit(rows)


def accuracy(model: LogisticRegressionModel, features: DataFrame) -> float:
    rows = features.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))
    told = model.transform(rows).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    return float(told)


def predictions(frames: Frames, make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]], mode: str = "y_only", grid: tuple[int, int] = (4, 4), batch: int = 64) -> DataFrame:
    """(image_id, label, prediction): make_predict() loads a model once a worker; it takes (n, channels, height, width)."""
    planes = {"y_only": 64, "ycbcr": 192, "dc_only": 3}[mode]
    rows = tensors(frames, mode, grid)
    udf = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[[planes, *grid]])
    return rows.select("image_id", "label", udf("features").alias("prediction"))
