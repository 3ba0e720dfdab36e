"""Scattered points on a regular raster, kept sparse: (frame, i, j, value) with a missing row for an empty cell.

The raster's spacing is the median distance to the nearest other point unless given; axes start at the least x and y and
have ceil((max - min) / spacing + 1) cells; a point belongs to the nearest cell, the lower one at a tie. Of points in
one cell the greatest (x, y) gives the value, at a tie the greatest value.

The median filter works on tiles with a halo: a cell goes to its tile and to the tiles within reach, so one shuffle
of little more than the raster gives every tile what both of its rank filters need. A missing cell has no value: the
median of a window is element floor(m / 2) of its m sorted values. Windows are reflected at the raster's borders; an even
window reaches one further to the left. Rows of a frame without two points, or with no positive spacing, are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.storage import materialize

TILE = 128


def nearest_distance(field: DataFrame) -> DataFrame:
    """frame, x, y, n (rows at the point), distance to the nearest other row; null in a frame of one row.

    Points meet in the 3 x 3 bins around theirs. A distance up to the bin size is final; the others try bins twice as
    large, so sparse regions cost rounds and dense ones don't grow."""
    # A partial aggregate before the shuffle: rows at one point count once.
    points = field.groupBy("frame", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    box = points.groupBy("frame").agg(
        F.count(F.lit(1)).alias("points"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x")).alias("dx"), (F.max("y") - F.min("y")).alias("dy")
    )
    side = F.greatest(F.sqrt(F.col("dx") * F.col("dy") / F.col("points")), F.greatest("dx", "dy") / F.col("points"))
    # Half as wide again as a regular grid's spacing: such a grid is settled in the first round.
    box = box.select("frame", "points", "x0", "y0", (1.5 * side).alias("bin"))
    held = materialize(points.join(box, "frame"), "nearest-points")
    done = held.where("n > 1 or points = 1").select("frame", "x", "y", "n", F.when(F.col("n") > 1, 0.0).alias("distance"))
    open_, scale = held.where("n = 1 and points > 1"), 1.0
    while True:
        size = F.col("bin") * scale
        binned = lambda d: d.withColumn("bx", F.floor((F.col("x") - F.col("x0")) / size)).withColumn("by", F.floor((F.col("y") - F.col("y0")) / size))  # noqa: B023, E731
        around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        mine = binned(open_).withColumn("o", F.explode(around)).select("frame", "x", "y", "bin", (F.col("bx") + F.col("o.a")).alias("bx"), (F.col("by") + F.col("o.b")).alias("by"))
        other = binned(held).select("frame", "bx", "by", F.col("x").alias("ox"), F.col("y").alias("oy"))
        gap = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
        near = mine.join(other, ["frame", "bx", "by"]).where((F.col("x") != F.col("ox")) | (F.col("y") != F.col("oy"))).groupBy("frame", "x", "y").agg(F.min(gap).alias("distance"))
        tried = materialize(open_.join(near, ["frame", "x", "y"], "left"), "nearest-tried")
        final = F.coalesce(F.col("distance") <= size, F.lit(False))
        done = done.unionByName(tried.where(final).select("frame", "x", "y", "n", "distance"))
        open_ = tried.where(~final).drop("distance")
        if open_.isEmpty():
            return done
        scale *= 2


def spacing_of(field: DataFrame) -> DataFrame:
    """frame, spacing: the median over rows of the distance to the nearest other row."""
    return nearest_distance(field).groupBy("frame").agg(F.percentile("distance", F.lit(0.5), F.col("n")).alias("spacing"))


def snap(value: Column, start: Column, spacing: Column, cells: Column) -> Column:
    """The nearest cell's number, the lower one at a tie, within [0, cells - 1]."""
    return F.greatest(F.lit(0).cast("long"), F.least(F.ceil((value - start) / spacing - 0.5), cells - 1))


def axes(field: DataFrame, spacing: float | None = None) -> DataFrame:
    """frame, spacing, x0, y0, nx, ny of every frame's raster."""
    box = field.groupBy("frame").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    box = box.withColumn("spacing", F.lit(float(spacing))) if spacing is not None else box.join(spacing_of(field), "frame", "left")
    cells = lambda a, b: F.ceil(F.try_divide(F.col(b) - F.col(a), F.col("spacing")) + 1)
    return box.select("frame", "spacing", "x0", "y0", cells("x0", "x1").alias("nx"), cells("y0", "y1").alias("ny"))


def snapped(field: DataFrame, spacing: float | None = None) -> DataFrame:
    """The field's columns with i (row of the raster), j (column), ny, nx; nulls where a frame has no raster."""
    grid = axes(field, spacing)
    usable = F.col("spacing") > 0
    i = F.when(usable, snap(F.col("y"), F.col("y0"), F.col("spacing"), F.col("ny")))
    j = F.when(usable, snap(F.col("x"), F.col("x0"), F.col("spacing"), F.col("nx")))
    return field.join(grid, "frame").select(*field.columns, i.alias("i"), j.alias("j"), "ny", "nx")


def rasterize(field: DataFrame, spacing: float | None = None, columns: tuple[str, ...] = ("u", "v", "speed")) -> DataFrame:
    """frame, i, j and the values of the filled cells."""
    cells = snapped(field, spacing).where(F.col("i").isNotNull())
    last = F.max_by(F.struct(*columns), F.struct("x", "y", *columns)).alias("__last")
    return cells.groupBy("frame", "i", "j").agg(last).select("frame", "i", "j", *[F.col("__last")[c].alias(c) for c in columns])


def rank_filter(values: np.ndarray, rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int], window: int) -> np.ndarray:
    """The median of the window around each cell of a dense part (rows x columns of global numbers) of a raster of a shape.

    values holds the part; windows that need cells outside the part see them as missing, so it must have a halo."""
    offsets = range(-(window // 2), window - window // 2)

    def reflect(k, n):
        k = np.mod(k, 2 * n)
        return np.where(k >= n, 2 * n - 1 - k, k)

    def positions(own, n):
        out = []
        for d in offsets:
            want = reflect(own + d, n)
            at = np.searchsorted(own, want)
            at[at == len(own)] = 0
            out.append((at, own[at] == want))
        return out

    layers = []
    for at_row, has_row in positions(rows, shape[0]):
        for at_column, has_column in positions(columns, shape[1]):
            layer = values[np.ix_(at_row, at_column)]
            layers.append(np.where(np.outer(has_row, has_column), layer, np.nan))
    stack = np.sort(np.stack(layers), axis=0)  # NaN comes last
    present = np.sum(~np.isnan(stack), axis=0)
    return np.take_along_axis(stack, np.minimum(present // 2, len(layers) - 1)[None], axis=0)[0]


def outlier_cells(field: DataFrame, window: int = 5, factor: float = 3.0, spacing: float | None = None, tile: int = TILE) -> DataFrame:
    """frame, i, j of the cells whose deviation from their window's median exceeds factor times the median deviation."""
    return _outliers(snapped(field, spacing), window, factor, tile)


def _outliers(placed: DataFrame, window: int, factor: float, tile: int) -> DataFrame:
    placed = placed.where(F.col("i").isNotNull())
    cells = placed.groupBy("frame", "i", "j").agg(F.max_by("speed", F.struct("x", "y", "speed")).alias("value"), F.max("ny").alias("ny"), F.max("nx").alias("nx"))
    halo = 2 * window
    # The tiles whose halo holds a cell: its own, and the neighbours near whose border it is.
    reach = lambda c: F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col(c) - halo) / tile)), F.floor((F.col(c) + halo) / tile))
    dealt = cells.withColumn("ti", F.explode(reach("i"))).withColumn("tj", F.explode(reach("j")))

    def judge(part: pa.Table) -> pa.Table:
        get = {c: part[c].to_numpy() for c in ("i", "j", "ti", "tj", "ny", "nx")}
        shape = int(get["ny"][0]), int(get["nx"][0])
        ti, tj = int(get["ti"][0]), int(get["tj"][0])
        rows = np.arange(max(0, ti * tile - halo), min(shape[0], (ti + 1) * tile + halo))
        columns = np.arange(max(0, tj * tile - halo), min(shape[1], (tj + 1) * tile + halo))
        values = np.full((len(rows), len(columns)), np.nan)
        values[get["i"] - rows[0], get["j"] - columns[0]] = part["value"].to_numpy(zero_copy_only=False).astype(float)
        deviation = np.abs(values - rank_filter(values, rows, columns, shape, window))
        limit = factor * rank_filter(deviation, rows, columns, shape, window)
        with np.errstate(invalid="ignore"):
            r, c = np.nonzero(deviation > limit)
        own = (rows[r] // tile == ti) & (columns[c] // tile == tj)
        r, c = rows[r[own]], columns[c[own]]
        return pa.table({"frame": pa.array([part["frame"][0].as_py()] * len(r), part.schema.field("frame").type), "i": pa.array(r, pa.int64()), "j": pa.array(c, pa.int64())})

    frame = placed.schema["frame"].dataType.simpleString()
    return dealt.groupBy("frame", "ti", "tj").applyInArrow(judge, f"frame {frame}, i long, j long")


def median_filter(field: DataFrame, window: int = 5, factor: float = 3.0, spacing: float | None = None, tile: int = TILE) -> DataFrame:
    """Drop every row that belongs to an outlier cell."""
    # The field is written once: its upstream filters would run again for the box, the spacing and the rows.
    placed = snapped(materialize(field, "median-field"), spacing)
    kept = placed.join(_outliers(placed, window, factor, tile), ["frame", "i", "j"], "left_anti")
    return kept.select(*field.columns)
