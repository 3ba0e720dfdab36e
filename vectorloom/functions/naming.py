"""Names and titles made from timestamps, labels and run parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def stamp_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def stamp_of_text(text: Column) -> Column:
    """The variant for timestamps that are text: colons to dashes, spaces to underscores."""
    return F.translate(text, ": ", "-_")


def run_name(camera: Column, day: Column, model: str = "GMM") -> Column:
    return F.concat_ws("_", camera, F.date_format(day, "yyyy-MM-dd"), F.lit(model))


def model_name(run: Column, components: int, covariance: str = "full", prior: float | None = None) -> Column:
    """The name of a run's saved model; with a concentration prior that of a variational fit's results."""
    kind, tail = ("model", "") if prior is None else ("GMM", f"_wcp{prior}")
    return F.concat(run, F.lit(f"_{kind}_comp{components}_cov{covariance}{tail}"))


def label_name(label: Column) -> Column:
    """Noise for -1, else Cluster n."""
    return F.when(label == -1, "Noise").otherwise(F.concat(F.lit("Cluster "), label.cast("string")))
