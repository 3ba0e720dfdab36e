"""Summaries of fields and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.naming import label_name


def cluster_stats(labelled: DataFrame, label: str = "cluster") -> DataFrame:
    """frame, cluster name, count, means of speed and angle (arithmetic), sample standard deviation of speed (null for one row)."""
    out = labelled.groupBy("frame", label).agg(F.count(F.lit(1)).alias("count"), F.avg("speed").alias("mean_magnitude"), F.avg("angle_deg").alias("mean_direction"), F.stddev_samp("speed").alias("std_magnitude"))
    return out.select("frame", label_name(F.col(label)).alias("cluster_name"), "count", "mean_magnitude", "mean_direction", "std_magnitude")


def range_summary(field: DataFrame, column: str) -> DataFrame:
    """frame, count, min, max, mean and the quantiles .01 .05 .25 .5 .75 .95 .99 of a column."""
    at = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    q = F.percentile(column, F.array(*[F.lit(p) for p in at]))
    out = field.groupBy("frame").agg(F.count(column).alias("n"), F.min(column).alias("least"), F.max(column).alias("most"), F.avg(column).alias("mean"), q.alias("q"))
    return out.select("frame", "n", "least", "most", "mean", *[F.col("q")[k].alias(f"p{round(100 * p):02d}") for k, p in enumerate(at)])


def color_range(field: DataFrame, column: str = "speed", vmin: float | None = None, vmax: float | None = None, zero_is_unset: bool = False) -> DataFrame:
    """frame, vmin, vmax: the given limits, else 0 and the greatest value. zero_is_unset: a vmax of 0 counts as none."""
    top = None if zero_is_unset and vmax == 0 else vmax
    most = F.max(column) if top is None else F.lit(float(top))
    return field.groupBy("frame").agg(F.lit(0.0 if vmin is None else float(vmin)).alias("vmin"), most.alias("vmax"))


def contour_levels(scores: DataFrame, column: str, n: int = 10, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """frame, levels: n equally spaced values between two quantiles."""
    q = scores.groupBy("frame").agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("q"))
    step = (F.col("q")[1] - F.col("q")[0]) / max(1, n - 1)
    return q.select("frame", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col("q")[0] + k * step).alias("levels"))


def label_histogram(labelled: DataFrame, label: str = "cluster") -> DataFrame:
    return labelled.groupBy("frame", label).agg(F.count(F.lit(1)).alias("count"))


def cluster_count(labelled: DataFrame, label: str = "cluster", with_noise: bool = True) -> DataFrame:
    """frame, n_clusters. Noise counts as a label if asked for."""
    own = F.col(label) if with_noise else F.when(F.col(label) != -1, F.col(label))
    return labelled.groupBy("frame").agg(F.count_distinct(own).alias("n_clusters"))


def batch_summary(results: DataFrame) -> DataFrame:
    """Numbers of tasks that succeeded, were skipped and failed."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return results.agg(F.count(F.lit(1)).alias("tasks"), of("success"), of("skipped"), of("error"))


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """adjusted_rand: of two labelings, from their contingency table; 1 where either way of pairing is trivial for both."""
    table = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: F.sum(n * (n - 1) / 2)
    n = F.col("n").cast("double")
    cells = table.agg(pairs(n).alias("cells"), F.sum(n).alias("total"))
    rows = table.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs(n).alias("rows"))
    columns = table.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs(n).alias("columns"))
    one = cells.crossJoin(rows).crossJoin(columns)  # one row each
    whole = F.col("total") * (F.col("total") - 1) / 2
    expected = F.try_divide(F.col("rows") * F.col("columns"), whole)
    most = (F.col("rows") + F.col("columns")) / 2
    return one.select(F.coalesce(F.try_divide(F.col("cells") - expected, most - expected), F.lit(1.0)).alias("adjusted_rand"))


def posterior_mode(samples: DataFrame) -> DataFrame:
    """obs, z: the most frequent assignment over chains and draws, the smallest at a tie."""
    counted = samples.groupBy("obs", "z").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("obs").agg(F.max_by("z", F.struct("n", -F.col("z"))).alias("z"))


def assignment_probability(samples: DataFrame, k: int) -> DataFrame:
    """obs, probability: the share of samples with each of the k classes, as an array."""
    share = [F.avg((F.col("z") == c).cast("double")) for c in range(k)]
    return samples.groupBy("obs").agg(F.array(*share).alias("probability"))


def entropy(probabilities: Column, epsilon: float = 1e-10) -> Column:
    """-sum p log(p + epsilon) of an array."""
    return -F.aggregate(F.transform(probabilities, lambda p: p * F.log(p + epsilon)), F.lit(0.0), lambda a, b: a + b)


def posterior_means(draws: DataFrame) -> DataFrame:
    """k, feature, mean over chains and draws."""
    return draws.groupBy("k", "feature").agg(F.avg("value").alias("mean"))


def has_values(frame: DataFrame, column: str) -> DataFrame:
    """any_value: whether the column has a value at all."""
    return frame.agg(F.coalesce(F.max(F.col(column).isNotNull()), F.lit(False)).alias("any_value"))
