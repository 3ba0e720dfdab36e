"""Cleaning of cluster labels: small clusters, spatial smoothing, merging. A label of -1 is noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MERGE_FEATURES = ("x", "y", "speed", "angle_rad")


def remove_small_clusters(labelled: DataFrame, min_size: int = 30, label: str = "cluster") -> DataFrame:
    """Labels of fewer than min_size rows of their frame become -1. Sizes are aggregated, then joined: a large cluster is never one task."""
    sizes = labelled.groupBy("frame", label).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_size).select(F.col("frame").alias("__f"), F.col(label).alias("__l"))
    joined = labelled.join(sizes, (F.col("frame").eqNullSafe(F.col("__f"))) & (F.col(label) == F.col("__l")), "left")
    return joined.withColumn(label, F.coalesce("__l", F.lit(-1)).cast(labelled.schema[label].dataType)).select(*labelled.columns)


def smooth_labels(labelled: DataFrame, window: int = 3, label: str = "cluster", unit: float = 1.0) -> DataFrame:
    """The mode of the labels other than -1 in the window around each row's cell, the smallest at a tie, -1 if there is none.

    Cells are the integer parts of x / unit and y / unit; coordinates must not be negative. In a cell the row with the
    greatest (x, y) gives the label. An even window reaches one further to the left."""
    low = labelled.agg(F.min("x"), F.min("y")).first()
    if any(v is not None and v < 0 for v in low):
        raise ValueError("coordinates must not be negative")
    cell = lambda c: (F.col(c) / unit).cast("long")
    rows = labelled.withColumns({"__i": cell("y"), "__j": cell("x")})
    cells = rows.groupBy("frame", "__i", "__j").agg(F.max_by(label, F.struct("x", "y", label)).alias("__l"))
    offsets = range(-(window // 2), window - window // 2)
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in offsets for b in offsets])
    # Each labelled cell votes in the cells whose window holds it; votes are summed before and after one shuffle.
    votes = cells.where("__l <> -1").withColumn("__o", F.explode(moves))
    votes = votes.select("frame", (F.col("__i") - F.col("__o.a")).alias("__i"), (F.col("__j") - F.col("__o.b")).alias("__j"), "__l")
    counted = votes.groupBy("frame", "__i", "__j", "__l").agg(F.count(F.lit(1)).alias("__n"))
    best = counted.groupBy("frame", "__i", "__j").agg(F.max_by("__l", F.struct("__n", -F.col("__l"))).alias("__best"))
    out = rows.join(best, ["frame", "__i", "__j"], "left")
    kind = labelled.schema[label].dataType
    return out.withColumn(label, F.coalesce("__best", F.lit(-1)).cast(kind)).select(*labelled.columns)


def centroids(labelled: DataFrame, label: str = "cluster", columns: tuple[str, ...] = MERGE_FEATURES) -> DataFrame:
    """frame, label and the mean of each column, without noise."""
    return labelled.where(F.col(label) != -1).groupBy("frame", label).agg(*[F.avg(c).alias(c) for c in columns])


def centroid_distances(labelled: DataFrame, label: str = "cluster", columns: tuple[str, ...] = MERGE_FEATURES) -> DataFrame:
    """frame, a, b, distance for the pairs a < b of a frame's clusters (as many as the clusters' squares)."""
    c = centroids(labelled, label, columns)
    a = c.select("frame", F.col(label).alias("a"), *[F.col(x).alias(f"a_{x}") for x in columns])
    b = c.select("frame", F.col(label).alias("b"), *[F.col(x).alias(f"b_{x}") for x in columns])
    total = F.lit(0.0)
    for x in columns:
        d = F.col(f"a_{x}") - F.col(f"b_{x}")
        total = total + d * d
    return a.join(b, "frame").where("a < b").select("frame", "a", "b", F.sqrt(total).alias("distance"))


def merge_clusters(labelled: DataFrame, threshold: float = 10.0, label: str = "cluster", columns: tuple[str, ...] = MERGE_FEATURES) -> DataFrame:
    """Each label becomes the smallest label whose centroid is closer than the threshold, in one step (not transitively)."""
    near = centroid_distances(labelled, label, columns).where(F.col("distance") < threshold)
    new = near.groupBy("frame", F.col("b").alias(label)).agg(F.min("a").alias("__to"))
    return labelled.join(new, ["frame", label], "left").withColumn(label, F.coalesce("__to", label)).select(*labelled.columns)


def relabel(labelled: DataFrame, label: str = "cluster") -> DataFrame:
    """Labels by rising mean speed, then mean angle, of the clusters of a frame, from 0; noise stays."""
    means = labelled.where(F.col(label) != -1).groupBy("frame", label).agg(F.avg("speed").alias("__s"), F.avg("angle_deg").alias("__a"))
    rank = F.row_number().over(Window.partitionBy("frame").orderBy("__s", "__a", label)) - 1  # over clusters, not rows
    new = means.select("frame", label, rank.alias("__to"))
    return labelled.join(new, ["frame", label], "left").withColumn(label, F.coalesce("__to", label)).select(*labelled.columns)
