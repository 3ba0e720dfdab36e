"""Features of displacement vectors, and their scaling, for all frames at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-10
CATEGORIES = ("low", "medium", "high", "very_high")


def angle_rad() -> Column:
    return F.atan2("v", "u")


def angle_deg() -> Column:
    """Degrees from the u axis, in [0, 360)."""
    return (F.degrees(angle_rad()) + 360) % 360


def magnitude() -> Column:
    return F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))


def with_magnitude(field: DataFrame) -> DataFrame:
    """Adds speed where the field has none."""
    return field if "speed" in field.columns else field.withColumn("speed", magnitude())


def magnitude_category(field: DataFrame) -> DataFrame:
    """Adds magnitude_category by the quartiles of speed of each frame, open on the left, from 0; null at 0 and null.

    Where quartiles are equal the first category that fits is taken."""
    q = field.groupBy("frame").agg(F.percentile("speed", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__q"))
    s, c = F.col("speed"), F.col("__q")
    name = F.when(s <= 0, None).when(s <= c[0], CATEGORIES[0]).when(s <= c[1], CATEGORIES[1]).when(s <= c[2], CATEGORIES[2]).when(s.isNotNull(), CATEGORIES[3])
    return field.join(q, "frame").select(*field.columns, name.alias("magnitude_category"))


def ordinal(category: Column) -> Column:
    """0 to 3 for the categories in order, null without one."""
    out = F.lit(None).cast("int")
    for k, name in enumerate(CATEGORIES):
        out = F.when(category == name, k).otherwise(out)
    return out


def features(field: DataFrame) -> DataFrame:
    """All features of a field."""
    out = field.withColumns(
        {
            "angle_rad": angle_rad(),
            "angle_deg": angle_deg(),
            "u_unit": F.col("u") / (F.col("speed") + EPSILON),
            "v_unit": F.col("v") / (F.col("speed") + EPSILON),
            "speed_squared": F.col("speed") * F.col("speed"),
            "log_magnitude": F.log1p("speed"),
        }
    )
    return magnitude_category(out)


def spatial_index(field: DataFrame) -> DataFrame:
    """Adds the row's number within its frame, from 0, in the order of x, y."""
    return field.withColumn("spatial_index", F.row_number().over(Window.partitionBy("frame").orderBy("x", "y")) - 1)


def scaler(field: DataFrame, columns: Sequence[str]) -> DataFrame:
    """frame, column, mean, scale (population standard deviation, 1 for a constant column)."""
    spread = [x for c in columns for x in (F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std"))]
    wide = field.groupBy("frame").agg(*spread)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__mean").alias("mean"), F.when(F.col(f"{c}__std") == 0, 1.0).otherwise(F.col(f"{c}__std")).alias("scale")) for c in columns])
    return wide.select("frame", F.explode(rows).alias("s")).select("frame", "s.column", "s.mean", "s.scale")


def standardize(field: DataFrame, columns: Sequence[str], weights: Mapping[str, float] | None = None, suffix: str = "_scaled") -> DataFrame:
    """Adds (x - mean) / population standard deviation of its frame, times the column's weight (1 without one)."""
    spread = [x for c in columns for x in (F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std"))]
    stats = field.groupBy("frame").agg(*spread)
    scaled = lambda c: (F.col(c) - F.col(f"{c}__mean")) / F.when(F.col(f"{c}__std") == 0, 1.0).otherwise(F.col(f"{c}__std"))
    weight = dict(weights or {})
    out = [(scaled(c) * F.lit(float(weight[c])) if c in weight else scaled(c)).alias(c + suffix) for c in columns]
    return field.join(stats, "frame").select(*field.columns, *out)


def weighted_blocks(field: DataFrame, spatial: Sequence[str] = ("x", "y"), velocity: Sequence[str] = ("u", "v", "speed", "angle_deg"), spatial_weight: float = 0.3, velocity_weight: float = 0.7) -> DataFrame:
    """Standardised spatial and velocity columns, each block times its weight."""
    weights = dict.fromkeys(spatial, spatial_weight) | dict.fromkeys(velocity, velocity_weight)
    return standardize(field, [*spatial, *velocity], weights)


def spatial_prior(k: int = 3) -> Column:
    """Prior probabilities of three classes by position, first rule that holds; else uniform over k."""
    probabilities = lambda *p: F.array(*[F.lit(x) for x in p])
    uniform = probabilities(*[1.0 / k] * k)
    x, y = F.col("x"), F.col("y")
    return F.when(x < -1, probabilities(0.8, 0.1, 0.1)).when(y > 1, probabilities(0.1, 0.8, 0.1)).when((x > 1) & (y < 1), probabilities(0.1, 0.1, 0.8)).otherwise(uniform)
