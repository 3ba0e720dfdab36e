"""Gaussian densities as Column expressions with literal parameters, and the driver's small numerics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def digamma(x: float) -> float:
    """By recurrence to x >= 6 and the asymptotic series."""
    shift = 0.0
    while x < 6:
        shift -= 1 / x
        x += 1
    y = 1 / (x * x)
    return shift + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def quadratic_form(columns: list[Column], mean, precision) -> Column:
    """(x - mean)' precision (x - mean)."""
    d = [c - F.lit(float(m)) for c, m in zip(columns, mean, strict=True)]
    total = F.lit(0.0)
    for i in range(len(d)):
        for j in range(i, len(d)):
            p = float(precision[i][j]) * (1 if i == j else 2)
            if p:
                total = total + d[i] * d[j] * F.lit(p)
    return total


def log_gaussian(columns: list[Column], mean, covariance) -> Column:
    """log density of a multivariate normal; its inverse and determinant are the driver's."""
    covariance = np.asarray(covariance, float)
    _, log_det = np.linalg.slogdet(covariance)
    constant = -0.5 * (len(columns) * math.log(2 * math.pi) + float(log_det))
    return F.lit(constant) - 0.5 * quadratic_form(columns, mean, np.linalg.inv(covariance))


def log_sum_exp(terms: list[Column]) -> Column:
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    total = F.lit(0.0)
    for t in terms:
        total = total + F.exp(t - top)
    return top + F.log(total)
