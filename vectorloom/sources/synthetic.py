"""A synthetic mixture of three Gaussians with known classes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

MEANS = ((-3.0, -2.0), (0.0, 3.0), (4.0, -1.0))


def mixture_2d(spark: SparkSession, n: int = 600, seed: int = 8927, spread: float = 1.0) -> DataFrame:
    """id, x, y, true_cluster: n rows, classes equally likely."""
    rng = np.random.default_rng(seed)
    k = rng.integers(0, len(MEANS), n)
    points = np.array(MEANS)[k] + spread * rng.standard_normal((n, 2))
    rows = [(i, float(x), float(y), int(c)) for i, ((x, y), c) in enumerate(zip(points, k, strict=True))]
    return spark.createDataFrame(rows, "id long, x double, y double, true_cluster int")
