"""Outlier filters of displacement fields, over all frames at once.

A field has columns frame, x, y, u, v, speed (doubles but frame). NaN must have become NULL at ingest; a NULL speed
fails every comparison, so such rows leave a field at the first filter, as a missing value does in a data frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.config import Filters
from vectorloom.operators.raster import median_filter


def percentile_filter(field: DataFrame, tails: float = 0.01, column: str = "speed", exact: bool = True) -> DataFrame:
    """Keep q(tails) <= column <= q(1 - tails), with linearly interpolated quantiles of each frame.

    exact=False takes approximate quantiles, for frames whose values don't fit in a task."""
    quantile = F.percentile if exact else F.percentile_approx
    bounds = field.groupBy("frame").agg(quantile(column, F.array(F.lit(tails), F.lit(1 - tails))).alias("__q"))
    # One row a frame; left to the planner, which broadcasts it while it is small.
    kept = field.join(bounds, "frame").where((F.col(column) >= F.col("__q")[0]) & (F.col(column) <= F.col("__q")[1]))
    return kept.select(*field.columns)


def min_speed_filter(field: DataFrame, least: float, column: str = "speed") -> DataFrame:
    """Keep column >= least; a negative least keeps everything."""
    return field if least < 0 else field.where(F.col(column) >= least)


def filter_pipeline(field: DataFrame, settings: Filters = Filters()) -> DataFrame:
    """Percentile, minimum speed and median filter, in this order, each as the settings say."""
    out = field
    if settings.filter_outliers:
        out = percentile_filter(out, settings.tails_percentile)
    out = min_speed_filter(out, settings.min_velocity)
    if settings.apply_2d_median:
        out = median_filter(out, settings.median_window_size, settings.median_threshold_factor)
    return out


def retention(before: DataFrame, after: DataFrame) -> DataFrame:
    """frame, n_before, n_after, ratio for every frame of before."""
    a = before.groupBy("frame").agg(F.count(F.lit(1)).alias("n_before"))
    b = after.groupBy("frame").agg(F.count(F.lit(1)).alias("n_after"))
    n_after = F.coalesce("n_after", F.lit(0)).cast("long")
    return a.join(b, "frame", "left").select("frame", "n_before", n_after.alias("n_after"), F.try_divide(n_after.cast("double"), F.col("n_before")).alias("ratio"))
