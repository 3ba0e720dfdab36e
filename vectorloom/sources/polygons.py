"""Polygons in JSON files: {"polygon_points": [[x, y], ...]}."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "polygon_points array<array<double>>"


def read_polygon(spark: SparkSession, path: str) -> list[list[float]] | None:
    """The polygon of one file; None if it has fewer than three points."""
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", SCHEMA).alias("p")).select("p.polygon_points").first()
    points = row[0] if row else None
    return [list(p) for p in points] if points is not None and len(points) >= 3 else None


def read_sectors(spark: SparkSession, path: str) -> DataFrame:
    """idx, points: a polygon a file, numbered by file name from 0. Files are few: their numbering is one small window."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", SCHEMA).alias("p"))
    return raw.select((F.row_number().over(Window.orderBy("file")) - 1).alias("idx"), F.col("p.polygon_points").alias("points"))


def write_polygon(points, path: str) -> str:
    """Writes a polygon on the driver, with .json added to a name without suffix; returns the path."""
    if points is None or len(points) < 3:
        raise ValueError("a polygon has at least three points")
    target = Path(path)
    target = target if target.suffix else target.with_suffix(".json")
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps({"polygon_points": [[float(x), float(y)] for x, y in points]}), encoding="utf-8")
    return str(target)


def closed(points):
    """The points with the first one repeated at the end."""
    return [*points, points[0]] if points and list(points[0]) != list(points[-1]) else list(points)


def to_json(sectors: DataFrame) -> DataFrame:
    return sectors.select("idx", F.to_json(F.struct(F.col("points").alias("polygon_points"))).alias("body"))
