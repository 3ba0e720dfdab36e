"""Displacement fields from JSON payloads and from tables with long names. NaN becomes NULL, V becomes speed, here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.config import Filters
from vectorloom.operators.filters import min_speed_filter, percentile_filter

PAYLOAD = "points array<array<double>>, vectors array<array<double>>, magnitudes array<double>"
#: A payload that is written holds at most so many points: it is one value, which a task holds whole and several times over.
PAYLOAD_POINTS = 10_000
LONG_NAMES = {"seed_x_px": "x", "seed_y_px": "y", "displacement_x_px": "u", "displacement_y_px": "v", "displacement_magnitude_px": "speed"}


def no_nan(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def check(parsed: DataFrame) -> DataFrame:
    """Adds error: null for a payload that is whole."""
    p = F.col("payload")
    return parsed.withColumn(
        "error",
        F.when(p.isNull() | p["points"].isNull(), "no points")
        .when(F.size(p["points"]) == 0, "empty")
        .when(p["vectors"].isNull() | p["magnitudes"].isNull(), "no vectors or magnitudes")
        .when((F.size(p["points"]) != F.size(p["vectors"])) | (F.size(p["points"]) != F.size(p["magnitudes"])), "lengths differ"),
    )


def from_payloads(raw: DataFrame, strict: bool = True) -> DataFrame:
    """frame, x, y, u, v, speed from (frame, body): one JSON text a frame, or several that hold its rows together. strict: a bad payload is an error, else it is left out."""
    parsed = check(raw.select("frame", F.from_json("body", PAYLOAD).alias("payload")))
    if strict:
        message = F.concat(F.lit("frame "), F.col("frame").cast("string"), F.lit(": "), F.col("error"))
        parsed = parsed.withColumn("frame", F.when(F.col("error").isNull(), F.col("frame")).otherwise(F.raise_error(message)))
    else:
        parsed = parsed.where(F.col("error").isNull())
    rows = parsed.select("frame", F.explode(F.arrays_zip("payload.points", "payload.vectors", "payload.magnitudes")).alias("p"))
    at = lambda f, k: no_nan(F.get(F.col(f"p.{f}"), F.lit(k)))
    return rows.select("frame", at("points", 0).alias("x"), at("points", 1).alias("y"), at("vectors", 0).alias("u"), at("vectors", 1).alias("v"), no_nan(F.col("p.magnitudes")).alias("speed"))


def to_payloads(field: DataFrame, points: int = PAYLOAD_POINTS) -> DataFrame:
    """frame, body: the JSON text of each frame, by x, y. A frame of more rows than points is dealt into several payloads of
    at most so many, by a hash and, where rows repeat, by their place; together they hold all its rows."""
    counts = field.groupBy("frame").agg(F.count(F.lit(1)).alias("n")).select(F.col("frame").alias("__frame"), F.when(F.col("n") <= points, 1).otherwise(F.ceil(2 * F.col("n") / points)).alias("parts"))
    values = ["x", "y", "u", "v", "speed"]
    # One row a frame; left to the planner, which broadcasts it while it is small.
    dealt = field.join(counts, F.col("frame").eqNullSafe(F.col("__frame"))).select("frame", *values, F.pmod(F.xxhash64(*values), F.col("parts")).alias("part"))
    place = F.row_number().over(Window.partitionBy("frame", "part").orderBy(*values))
    dealt = dealt.withColumn("chunk", F.floor((place - 1) / points))
    rows = dealt.groupBy("frame", "part", "chunk").agg(F.sort_array(F.collect_list(F.struct(*values))).alias("r"))
    pair = lambda a, b: F.transform("r", lambda p: F.array(p[a], p[b]))
    body = F.to_json(F.struct(pair("x", "y").alias("points"), pair("u", "v").alias("vectors"), F.transform("r", lambda p: p["speed"]).alias("magnitudes")))
    return rows.select("frame", body.alias("body"))


def from_table(table: DataFrame, names: dict[str, str] = LONG_NAMES) -> DataFrame:
    """A field from long names. The columns must be there; speed is computed where it is missing."""
    out = table.withColumnsRenamed({k: v for k, v in names.items() if k in table.columns})
    missing = {"x", "y", "u", "v"} - set(out.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    out = out if "speed" in out.columns else out.withColumn("speed", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")))
    return out.withColumns({c: no_nan(F.col(c).cast("double")) for c in ("x", "y", "u", "v", "speed")})


def filtered(raw: DataFrame, settings: Filters = Filters()) -> DataFrame:
    """Payloads with the percentile and minimum-speed filters applied as they are read."""
    out = from_payloads(raw)
    if settings.filter_outliers:
        out = percentile_filter(out, settings.tails_percentile)
    return min_speed_filter(out, settings.min_velocity)
