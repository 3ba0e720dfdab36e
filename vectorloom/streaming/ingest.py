"""Payload files as they arrive, each micro-batch through the same operators as a batch.

The filters need whole frames, and a payload is a whole frame, so no state is kept between micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.config import Settings
from vectorloom.operators import features, filters
from vectorloom.sources import fields


def read_payloads(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """frame, body of JSON files named <analysis id>.json."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(path)
    return raw.select(F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("long").alias("frame"), F.col("value").alias("body"))


def process(batch: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return features.features(filters.filter_pipeline(fields.from_payloads(batch, strict=False), settings.filters))


def start(payloads: DataFrame, out: str, checkpoint: str, settings: Settings = Settings(), once: bool = False):
    """Writes the features of each micro-batch as Parquet under its number: a batch that is run again overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        process(batch, settings).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = payloads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
