"""Density clustering: neighbours by an equi-join on cells as wide as the radius, components of core points over edges.

Distances are over all columns; cells are over the first two, so each row meets the rows of nine cells. Clusters are
numbered by their smallest row id, from 0, within a frame; a border row joins the cluster with the smallest number; other
rows are -1. A null in a column makes a row noise. Ids must be unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.operators.graph import components
from vectorloom.storage import materialize


def neighbours(df: DataFrame, columns: Sequence[str], eps: float, row_id: str = "id") -> DataFrame:
    """frame, a, b: ordered pairs of different rows of a frame within eps of each other."""
    cell = lambda c: F.floor(F.col(c) / eps).cast("long")
    base = df.select("frame", F.col(row_id).alias("id"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).dropna()
    plane = ["c0", "c1"][: len(columns)]
    base = base.withColumns({f"k{i}": cell(c) for i, c in enumerate(plane)})
    steps = [(a,) for a in (-1, 0, 1)] if len(plane) == 1 else [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    around = F.array(*[F.struct(*[F.lit(s).alias(f"s{i}") for i, s in enumerate(step)]) for step in steps])
    left = base.withColumn("__o", F.explode(around))
    keys = [f"k{i}" for i in range(len(plane))]
    left = left.select("frame", F.col("id").alias("a"), *[F.col(f"c{k}").alias(f"a{k}") for k in range(len(columns))], *[(F.col(k) + F.col(f"__o.s{i}")).alias(k) for i, k in enumerate(keys)])
    right = base.select("frame", F.col("id").alias("b"), *[F.col(f"c{k}").alias(f"b{k}") for k in range(len(columns))], *keys)
    square = F.lit(0.0)
    for k in range(len(columns)):
        d = F.col(f"a{k}") - F.col(f"b{k}")
        square = square + d * d
    return left.join(right, ["frame", *keys]).where((F.col("a") != F.col("b")) & (square <= eps * eps)).select("frame", "a", "b")


def core_flags(df: DataFrame, columns: Sequence[str], eps: float, min_samples: int, row_id: str = "id") -> DataFrame:
    """frame, id, degree (rows within eps, itself included), core."""
    degree = neighbours(df, columns, eps, row_id).groupBy("frame", "a").agg(F.count(F.lit(1)).alias("n"))
    out = df.select("frame", F.col(row_id).alias("a")).join(degree, ["frame", "a"], "left")
    n = F.coalesce("n", F.lit(0)) + 1
    return out.select("frame", F.col("a").alias(row_id), n.cast("long").alias("degree"), (n >= min_samples).alias("core"))


def dbscan(df: DataFrame, columns: Sequence[str], eps: float = 0.2, min_samples: int = 10, row_id: str = "id", label: str = "cluster") -> DataFrame:
    """df with a label."""
    pairs = materialize(neighbours(df, columns, eps, row_id), "dbscan-pairs")
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + 1 >= min_samples)
    alone = df.select(F.col(row_id).alias("a")) if min_samples <= 1 else degree.select("a")
    core = materialize(alone, "dbscan-core")
    links = pairs.where("a < b").join(core, "a", "left_semi").join(core.select(F.col("a").alias("b")), "b", "left_semi")
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "dbscan")
    rooted = core.join(roots, F.col("a") == F.col("node"), "left").select("a", F.coalesce("root", "a").alias("root"))
    border = pairs.join(core, "a", "left_anti").join(rooted.select(F.col("a").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("root"))
    found = materialize(rooted.unionByName(border), "dbscan-roots")
    frames = df.select("frame", F.col(row_id).alias("root"))
    # Numbering ranks the clusters, not the rows, of a frame.
    numbers = found.select("root").distinct().join(frames, "root")
    numbers = numbers.select("root", (F.row_number().over(Window.partitionBy("frame").orderBy("root")) - 1).alias("__n"))
    named = found.join(numbers, "root").select(F.col("a").alias(row_id), "__n")
    return df.join(named, row_id, "left").select(*[c for c in df.columns if c != label], F.coalesce("__n", F.lit(-1)).alias(label))
