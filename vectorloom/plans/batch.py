"""The batch: for each (camera, day) its first analysis, filtered, clipped, featured, clustered and summarised.

All frames go through one plan, keyed by frame; only the mixtures are fitted frame by frame, in a grouped map. A day
without an analysis is skipped, as is one without its image; a frame that loses all rows, or whose fit fails, is an error
of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.config import Settings
from vectorloom.operators import features, filters, mixture, roi, summary
from vectorloom.sources import catalog as catalogs
from vectorloom.storage import materialize


def plan_tasks(catalog: DataFrame, work: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """camera_name, target_date, frame (the analysis), status, reason of every task of work."""
    first = catalogs.first_analyses(catalog.withColumn("target_date", F.to_date("reference_date")), "camera_name", "target_date")
    found = work.select("camera_name", F.col("reference_date").alias("target_date")).join(first.select("camera_name", "target_date", F.col("dic_id").alias("frame"), "master_image_id"), ["camera_name", "target_date"], "left")
    if images is not None:
        found = found.join(images.select(F.col("image_id").alias("master_image_id"), F.lit(True).alias("__image")).distinct(), "master_image_id", "left")
    has_image = F.col("__image").isNotNull() if images is not None else F.lit(True)
    reason = F.when(F.col("frame").isNull(), "no analyses").when(~has_image, "no image")
    return found.select("camera_name", "target_date", "frame", F.when(reason.isNull(), "ready").otherwise("skipped").alias("status"), reason.alias("reason"))


def run(tasks: DataFrame, field: DataFrame, settings: Settings = Settings(), polygon=None, fit: bool = True) -> tuple[DataFrame, DataFrame]:
    """(labelled features, task results).

    Of a success n_points are the rows that are clustered, n_filtered_points those that the region took from the filtered
    ones, n_clusters the clusters found; an error has its message, a skipped task its reason, and neither has counts."""
    ready = tasks.where("status = 'ready'").select("frame").distinct()
    own = materialize(field.join(ready, "frame", "left_semi"), "batch-field")
    filtered = materialize(filters.filter_pipeline(own, settings.filters), "batch-filtered")
    made = materialize(features.features(roi.clip(filtered, polygon)), "batch-features")
    columns = list(settings.clustering.features)
    scaled = features.standardize(made, columns)
    if fit:
        c = settings.clustering
        labelled = mixture.fit_predict_frames(scaled, [f"{x}_scaled" for x in columns], c.n_components, c.max_iter, c.weight_concentration_prior, error="__error")
    else:
        labelled = scaled.withColumn("cluster", features.ordinal(F.col("magnitude_category"))).withColumn("__error", F.lit(None).cast("string"))
    labelled = materialize(labelled.drop(*[f"{x}_scaled" for x in columns]), "batch-labels")
    raw = own.groupBy("frame").agg(F.count(F.lit(1)).alias("raw"))
    before = filtered.groupBy("frame").agg(F.count(F.lit(1)).alias("before"))
    after = labelled.groupBy("frame").agg(F.count(F.lit(1)).alias("after"), F.count_distinct("cluster").alias("clusters"), F.max("__error").alias("failed"))
    out = tasks.join(raw, "frame", "left").join(before, "frame", "left").join(after, "frame", "left")
    ready_ = F.col("status") == "ready"
    error = F.when(ready_, F.when(F.col("raw").isNull(), "no data").when(F.col("after").isNull(), "no rows left").otherwise(F.col("failed")))
    out = out.withColumn("error", error)
    done = ready_ & F.col("error").isNull()
    status = F.when(~ready_, F.col("status")).when(done, "success").otherwise("error")
    counts = {"n_points": F.col("after"), "n_filtered_points": F.col("before") - F.col("after"), "n_clusters": F.col("clusters")}
    results = out.select("camera_name", "target_date", "frame", status.alias("status"), "reason", "error", *[F.when(done, c).alias(name) for name, c in counts.items()])
    return labelled.where("__error is null").drop("__error"), results


def tally(results: DataFrame) -> DataFrame:
    return summary.batch_summary(results)
