"""Points and polygons: regions of interest and sectors, as Column expressions with literal edges.

A polygon is a list of (x, y), closed implicitly, of at least three points. A point is inside by the crossings test
(Haines, Point in Polygon Strategies, Graphics Gems IV); a bounding box goes in front, so that scans can skip by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Polygon = Sequence[Sequence[float]]


def valid(polygon: Polygon | None) -> bool:
    return polygon is not None and len(polygon) >= 3


def contains(polygon: Polygon | None, x: str = "x", y: str = "y") -> Column:
    """Whether a point is inside; without a polygon no point is."""
    if not valid(polygon):
        return F.lit(False)
    px, py = F.col(x), F.col(y)
    xs, ys = [float(p[0]) for p in polygon], [float(p[1]) for p in polygon]
    odd = F.lit(False)
    for k in range(len(xs)):
        x0, y0, x1, y1 = xs[k - 1], ys[k - 1], xs[k], ys[k]
        if y0 == y1:  # a level edge is never crossed
            continue
        above0, above1 = F.lit(y0) >= py, F.lit(y1) >= py
        crossed = (above0 != above1) & (((F.lit(y1) - py) * (x0 - x1) >= (F.lit(x1) - px) * (y0 - y1)) == above1)
        odd = odd != crossed
    box = (px >= min(xs)) & (px <= max(xs)) & (py >= min(ys)) & (py <= max(ys))
    return box & odd


def inside_or_all(polygon: Polygon | None, x: str = "x", y: str = "y") -> Column:
    """The other rule: without a polygon every point is inside."""
    return F.lit(True) if polygon is None else contains(polygon, x, y)


def clip(field: DataFrame, polygon: Polygon | None) -> DataFrame:
    """The rows inside the polygon; all without one. Columns x and y are needed."""
    if polygon is None:
        return field
    missing = {"x", "y"} - set(field.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    return field.where(contains(polygon))


def prior_class(field: DataFrame, sectors: Sequence[Polygon], name: str = "prior_class") -> DataFrame:
    """Adds the greatest number of a sector that contains the point, -1 without one."""
    of = F.lit(-1)
    for k, polygon in enumerate(sectors):
        of = F.when(F.coalesce(contains(polygon), F.lit(False)), F.lit(k)).otherwise(of)
    return field.withColumn(name, of)


def sector_join(field: DataFrame, sectors: DataFrame) -> DataFrame:
    """The same for sectors in a table (idx, points array<array<double>>): a theta join on the bounding box, then the test.

    The sectors of a camera are few; the table is broadcast by the planner while it is small."""
    at = lambda c, k: F.transform("points", lambda p: p[k])
    boxed = sectors.where(F.size("points") >= 3).select("idx", "points", *[f(at("points", k)).alias(n) for n, f, k in (("x0", F.array_min, 0), ("x1", F.array_max, 0), ("y0", F.array_min, 1), ("y1", F.array_max, 1))])
    near = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    before = lambda k: F.get("points", F.pmod(k - 1 + F.size("points"), F.size("points")))

    def crossing(p, k):
        q = before(k)
        above0, above1 = q[1] >= F.col("y"), p[1] >= F.col("y")
        return ((above0 != above1) & (((p[1] - F.col("y")) * (q[0] - p[0]) >= (p[0] - F.col("x")) * (q[1] - p[1])) == above1)).cast("int")

    odd = F.aggregate(F.transform("points", crossing), F.lit(0), lambda a, b: a + b) % 2 == 1
    hits = field.select("frame", "x", "y").distinct().join(boxed, near).where(odd).groupBy("frame", "x", "y").agg(F.max("idx").cast("int").alias("prior_class"))
    return field.join(hits, ["frame", "x", "y"], "left").select(*field.columns, F.coalesce("prior_class", F.lit(-1)).alias("prior_class"))
