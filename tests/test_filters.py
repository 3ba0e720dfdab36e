import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.config import Filters
from vectorloom.operators import filters, raster

FIELD = "frame long, x double, y double, u double, v double, speed double"


def field(spark, points, frame=1):
    """A field from (x, y, speed)."""
    return spark.createDataFrame([(frame, float(x), float(y), 0.0, 0.0, s) for x, y, s in points], FIELD)


def points_of(df):
    return {(r["x"], r["y"]) for r in df.collect()}


def plain_median(grid, window):
    """Median of each window of a dense grid with None for missing cells: reflected borders, element m // 2 of m values."""
    ny, nx = len(grid), len(grid[0])
    reflect = lambda k, n: (k % (2 * n)) if (k % (2 * n)) < n else 2 * n - 1 - (k % (2 * n))
    out = [[None] * nx for _ in range(ny)]
    for i in range(ny):
        for j in range(nx):
            got = [grid[reflect(i + a, ny)][reflect(j + b, nx)] for a in range(-(window // 2), window - window // 2) for b in range(-(window // 2), window - window // 2)]
            got = sorted(g for g in got if g is not None)
            out[i][j] = got[len(got) // 2] if got else None
    return out


def plain_outliers(grid, window, factor):
    m = plain_median(grid, window)
    dev = [[None if v is None else abs(v - m[i][j]) for j, v in enumerate(row)] for i, row in enumerate(grid)]
    mad = plain_median(dev, window)
    return {(float(j), float(i)) for i, row in enumerate(dev) for j, d in enumerate(row) if d is not None and mad[i][j] is not None and d > factor * mad[i][j]}


@pytest.mark.parametrize("window", [2, 3, 4, 5])
@pytest.mark.parametrize("holes", [0, 9])
@pytest.mark.parametrize("tile", [128, 3])
def test_median_filter_equals_definition(spark, window, holes, tile):
    rng = random.Random(10 * window + holes)
    grid = [[round(rng.random(), 3) for _ in range(9)] for _ in range(7)]
    grid[3][4] = 50.0
    for _ in range(holes):
        grid[rng.randrange(1, 6)][rng.randrange(1, 8)] = None
    df = field(spark, [(j, i, v) for i, row in enumerate(grid) for j, v in enumerate(row) if v is not None])
    all_points = points_of(df)
    assert points_of(raster.median_filter(df, window, 2.0, 1.0, tile)) == all_points - plain_outliers(grid, window, 2.0)


def test_window_larger_than_the_raster(spark):
    grid = [[1.0, 2.0], [3.0, 9.0]]
    df = field(spark, [(j, i, v) for i, row in enumerate(grid) for j, v in enumerate(row)])
    assert points_of(raster.median_filter(df, 7, 0.5, 1.0)) == points_of(df) - plain_outliers(grid, 7, 0.5)


def test_collision_drops_both_rows(spark):
    df = field(spark, [(j, i, 1.0) for i in range(7) for j in range(7) if (i, j) != (3, 3)] + [(2.9, 3.0, 1.0), (3.1, 3.0, 80.0)])
    assert points_of(df) - points_of(raster.median_filter(df, 3, 3.0, 1.0)) == {(2.9, 3.0), (3.1, 3.0)}


def test_frames_are_apart_and_small_frames_stay(spark):
    a = field(spark, [(0, 0, 5.0)], frame=1)
    b = field(spark, [(0, 0, 5.0), (0, 0, 6.0)], frame=2)
    assert raster.median_filter(a.unionByName(b)).count() == 3
    assert raster.median_filter(field(spark, [])).count() == 0


def test_snap_ties_go_down(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 8.0, 8.1, 24.0, 39.9, 60.0, -5.0)], "v double")
    got = [r[0] for r in df.select(raster.snap(F.col("v"), F.lit(0.0), F.lit(16.0), F.lit(3).cast("long"))).collect()]
    assert got == [0, 0, 1, 1, 2, 2, 0]


def test_nearest_distance(spark):
    rng = random.Random(2)
    pts = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(150)] + [(rng.uniform(-500, 500), rng.uniform(-500, 500)) for _ in range(20)] + [(3.0, 3.0)] * 2
    df = field(spark, [(x, y, 1.0) for x, y in pts])
    got = {(r["x"], r["y"]): r["distance"] for r in raster.nearest_distance(df).collect()}
    for k, (x, y) in enumerate(pts):
        want = min(math.dist((x, y), q) for j, q in enumerate(pts) if j != k)
        assert got[(x, y)] == pytest.approx(want)
    all_ = [min(math.dist(p, q) for j, q in enumerate(pts) if j != k) for k, p in enumerate(pts)]
    assert raster.spacing_of(df).first()["spacing"] == pytest.approx(np.median(all_))


def test_percentile_filter(spark):
    speeds = [None, 1.0, 2.0, 3.0, 4.0, 100.0]
    df = field(spark, [(k, 0, s) for k, s in enumerate(speeds)])
    low, high = np.quantile([1, 2, 3, 4, 100], [0.25, 0.75])
    assert sorted(r["speed"] for r in filters.percentile_filter(df, 0.25).collect()) == [s for s in speeds if s is not None and low <= s <= high]
    assert filters.percentile_filter(df, 0.0).count() == 5
    assert filters.percentile_filter(df, 0.25, exact=False).count() >= 1


def test_min_speed_is_idempotent(spark):
    df = field(spark, [(k, 0, float(k)) for k in range(5)])
    once = filters.min_speed_filter(df, 2.0)
    assert points_of(once) == points_of(filters.min_speed_filter(once, 2.0)) == {(2.0, 0.0), (3.0, 0.0), (4.0, 0.0)}
    assert filters.min_speed_filter(df, -1.0).count() == 5


def test_pipeline_order_and_switches(spark):
    rng = random.Random(4)
    df = field(spark, [(j, i, rng.random() * 5) for i in range(8) for j in range(8)])
    both = filters.filter_pipeline(df, Filters(tails_percentile=0.1, min_velocity=1.0, apply_2d_median=False))
    assert points_of(both) == points_of(filters.min_speed_filter(filters.percentile_filter(df, 0.1), 1.0))
    assert filters.filter_pipeline(df, Filters(False, 0.1, -1.0, False)).count() == 64
    assert points_of(filters.filter_pipeline(df)) <= points_of(df)
    kept = filters.retention(df, both).first()
    assert kept["n_before"] == 64 and kept["ratio"] == pytest.approx(both.count() / 64)
