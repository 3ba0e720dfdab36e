"""Principal components: covariances by one aggregation, the eigenvectors on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(df: DataFrame, columns: Sequence[str], n: int = 2, standardize: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, loadings by component); each component's largest loading is positive."""
    missing = set(columns) - set(df.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    d = len(columns)
    row = df.agg(*[F.avg(c) for c in columns], *[F.covar_pop(a, b) for i, a in enumerate(columns) for b in columns[i:]]).first()
    mean, cov, at = np.array(row[:d], float), np.empty((d, d)), d
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = row[at]
            at += 1
    scale = np.where(np.diag(cov) > 0, np.sqrt(np.diag(cov)), 1.0) if standardize else np.ones(d)
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    loadings = vectors[:, np.argsort(-values, kind="stable")[:n]].T
    largest = loadings[np.arange(len(loadings)), np.argmax(np.abs(loadings), axis=1)]
    return mean, scale, loadings * np.where(largest < 0, -1, 1)[:, None]


def project(df: DataFrame, columns: Sequence[str], mean, scale, loadings) -> DataFrame:
    """Adds PC1, PC2, ... of the centred (and scaled) columns."""
    out = df
    for k, vector in enumerate(loadings):
        total = F.lit(0.0)
        for c, m, s, w in zip(columns, mean, scale, vector, strict=True):
            total = total + (F.col(c) - F.lit(float(m))) * F.lit(float(w) / float(s))
        out = out.withColumn(f"PC{k + 1}", total)
    return out


def pca(df: DataFrame, columns: Sequence[str] = ("x", "y", "u", "v", "speed", "angle_deg"), n: int = 2, standardize: bool = False) -> DataFrame:
    return project(df, columns, *components(df, columns, n, standardize))
