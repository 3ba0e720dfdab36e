"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), as DataFrame joins.

The smallest neighbour of each vertex is found with map-side combining, and reaches the join that hands it out under a key
that the planner can't tell to be dealt already: so both sides of that join are plain shuffles, and a vertex with very many
edges is split over tasks by adaptive skew handling. Each round is written to the shared folder, so lineage stays short
and lost executors cost one round. Rounds end when all edges are stars, which is checked exactly. No edge reaches the
driver.

Defined results: self links and null ends are ignored; repeated links count once; no links give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.storage import materialize


def local_stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member number of each of n items' component under the links a[i] - b[i]."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b = a[differ], b[differ]
        low, high = np.minimum(la, lb)[differ], np.maximum(la, lb)[differ]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def least_of(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """key and the least value of its rows, for a join that may have to split a key: the join shuffles it once more."""
    return rows.groupBy(key).agg(F.min(key).alias("__key"), F.min(value).alias(name)).select(F.col("__key").alias(key), name)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = least_of(both, "u", F.least("u", "v"), "m")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Of edges with u > v."""
    least = least_of(edges, "u", F.col("v"), "m")
    moved = edges.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex has one edge to a smaller one, which has none itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest member of the component of every end of the edges (u, v)."""
    now = edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, f"{name}-edges")
    while not _are_stars(now):
        now = materialize(_small_star(_large_star(now)), f"{name}-round")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
