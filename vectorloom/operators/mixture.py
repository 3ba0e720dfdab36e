"""Gaussian mixtures: EM and variational, fitted by one aggregation an iteration.

The E-step is a Column expression with the current parameters as literals; one aggregation gives every component's
sums of responsibilities, first and second moments; the driver updates the few parameters. Data stay on the executors
and are read once an iteration from a table in the shared folder. `fit_frames` fits every frame by itself in a grouped map, for frames that
fit in a task, with the same updates.

Starts are deterministic: quantile seeds along the first column, then a few Lloyd steps. Components are ordered by weight.
Rows with a null in a column take no part in a fit and get no label.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom.functions.gaussian import digamma, log_gaussian, log_sum_exp, quadratic_form
from vectorloom.storage import materialize

FLOOR = 1e-6
TOLERANCE = 1e-3
LLOYD_STEPS = 5


@dataclass(frozen=True)
class Mixture:
    """log_weights, means, precisions and the constants of ln rho = constant - scale / 2 (x - mean)' precision (x - mean)."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    constants: np.ndarray
    scales: np.ndarray
    precisions: np.ndarray
    bound: float = float("nan")
    iterations: int = 0

    def terms(self, columns: Sequence[str]) -> list[Column]:
        x = [F.col(c) for c in columns]
        return [F.lit(float(c)) - F.lit(0.5 * float(s)) * quadratic_form(x, m, p) for c, s, m, p in zip(self.constants, self.scales, self.means, self.precisions, strict=True)]

    def log_terms(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.means)))
        for k, (c, s, m, p) in enumerate(zip(self.constants, self.scales, self.means, self.precisions, strict=True)):
            d = x - m
            out[:, k] = c - 0.5 * s * np.einsum("ni,ij,nj->n", d, p, d)
        return out


def em_mixture(weights, means, covariances) -> Mixture:
    weights, means, covariances = (np.asarray(a, float) for a in (weights, means, covariances))
    d = means.shape[1]
    _, log_det = np.linalg.slogdet(covariances)
    with np.errstate(divide="ignore"):
        constants = np.log(np.maximum(weights, 1e-300)) - 0.5 * (d * math.log(2 * math.pi) + log_det)
    return Mixture(weights, means, covariances, constants, np.ones(len(weights)), np.linalg.inv(covariances))


def variational_mixture(n: np.ndarray, mean: np.ndarray, cov: np.ndarray, m0: np.ndarray, w0_inverse: np.ndarray, gamma: float) -> Mixture:
    """Posterior of a truncated stick-breaking mixture (Blei and Jordan 2006; Bishop 2006, 10.2) from the components' sums."""
    k, d = mean.shape
    beta0, nu0 = 1.0, float(d)
    beta, nu = beta0 + n, nu0 + n
    means = (beta0 * m0 + n[:, None] * mean) / beta[:, None]
    off = mean - m0
    inverse = w0_inverse + n[:, None, None] * cov + (beta0 * n / beta)[:, None, None] * off[:, :, None] * off[:, None, :]
    after = np.concatenate([np.cumsum(n[::-1])[::-1][1:], [0.0]])
    a, b = 1 + n, gamma + after
    psi = np.vectorize(digamma)
    log_v, log_rest = psi(a) - psi(a + b), psi(b) - psi(a + b)
    log_pi = log_v + np.concatenate([[0.0], np.cumsum(log_rest)[:-1]])
    _, log_det_inverse = np.linalg.slogdet(inverse)
    log_lambda = np.array([sum(digamma((v - i) / 2) for i in range(d)) for v in nu]) + d * math.log(2) - log_det_inverse
    constants = log_pi + 0.5 * log_lambda - d / (2 * beta) - 0.5 * d * math.log(2 * math.pi)
    weights = a / (a + b) * np.concatenate([[1.0], np.cumprod(b / (a + b))[:-1]])
    return Mixture(weights / weights.sum(), means, inverse / nu[:, None, None], constants, nu, np.linalg.inv(inverse))


def _moments_from(sums: np.ndarray, k: int, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(responsibility, mean, covariance with the floor) of each component from its raw sums."""
    table = sums.reshape(k, -1)
    n = table[:, 0] + 10 * np.finfo(float).eps
    mean = table[:, 1 : 1 + d] / n[:, None]
    cov = np.empty((k, d, d))
    at = 1 + d
    for i in range(d):
        for j in range(i, d):
            cov[:, i, j] = cov[:, j, i] = table[:, at] / n - mean[:, i] * mean[:, j]
            at += 1
    cov[:, np.arange(d), np.arange(d)] = np.maximum(cov[:, np.arange(d), np.arange(d)], 0) + FLOOR
    return n, mean, cov


def responsibilities(mixture: Mixture, columns: Sequence[str]) -> list[Column]:
    terms = mixture.terms(columns)
    total = log_sum_exp(terms)
    return [F.exp(t - total) for t in terms]


def sufficient_statistics(df: DataFrame, mixture: Mixture, columns: Sequence[str], shift: Sequence[float] | None = None) -> DataFrame:
    """One row: the log likelihood, and for each component r, r x_i, r x_i x_j (i <= j), of x less the shift."""
    x = [F.col(c) - F.lit(float(s)) for c, s in zip(columns, shift or [0.0] * len(columns), strict=True)]
    held = df.select(log_sum_exp(mixture.terms(columns)).alias("__ll"), F.array(*responsibilities(mixture, columns)).alias("__r"), *[c.alias(f"__x{i}") for i, c in enumerate(x)])
    out = [F.sum("__ll").alias("ll")]
    for k in range(len(mixture.means)):
        r = F.col("__r")[k]
        out.append(F.sum(r).alias(f"r{k}"))
        out += [F.sum(r * F.col(f"__x{i}")).alias(f"s{k}_{i}") for i in range(len(x))]
        out += [F.sum(r * F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"q{k}_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return held.agg(*out)


def _seeds(df: DataFrame, columns: Sequence[str], k: int) -> np.ndarray:
    """Quantile seeds: the mean of each of k slices by the first column, then Lloyd steps, each one aggregation."""
    cuts = df.select(F.percentile_approx(columns[0], F.array(*[F.lit((i + 1) / k) for i in range(k)]), F.lit(10_000)).alias("q")).first()["q"]
    part = F.lit(k - 1)
    for i in reversed(range(k - 1)):
        part = F.when(F.col(columns[0]) <= float(cuts[i]), i).otherwise(part)
    means = np.array([[0.0] * len(columns)] * k)

    def updated(assign: Column) -> np.ndarray:
        rows = df.groupBy(assign.alias("__k")).agg(*[F.avg(c).alias(c) for c in columns]).collect()  # k rows
        new = means.copy()
        for r in rows:
            new[r["__k"]] = [r[c] for c in columns]
        return new

    means = updated(part)
    for _ in range(LLOYD_STEPS):
        distance = [quadratic_form([F.col(c) for c in columns], m, np.eye(len(columns))) for m in means]
        nearest = F.array_position(F.array(*distance), F.array_min(F.array(*distance))).cast("int") - 1
        means = updated(nearest)
    return means


def _overall(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    d = len(columns)
    row = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns], *[F.covar_pop(a, b) for i, a in enumerate(columns) for b in columns[i:]]).first()
    if not row[0]:
        raise ValueError("no rows to fit")
    cov, at = np.empty((d, d)), 1 + d
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = row[at]
            at += 1
    return row[0], np.array(row[1 : 1 + d], float), cov + FLOOR * np.eye(d)


def fit(df: DataFrame, columns: Sequence[str], k: int = 8, max_iter: int = 100, gamma: float | None = None, tolerance: float = TOLERANCE) -> Mixture:
    """EM, or with gamma the variational mixture of that weight-concentration prior, over all rows of df."""
    data = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna(), "mixture-data")
    n, mean, cov = _overall(data, columns)
    means = _seeds(data, columns, k)
    now, last = em_mixture(np.full(k, 1 / k), means, np.array([cov / k + FLOOR * np.eye(len(columns))] * k)), -math.inf
    for it in range(1, max_iter + 1):
        row = list(sufficient_statistics(data, now, columns, mean.tolist()).first())
        size, centre, spread = _moments_from(np.array(row[1:], float), k, len(columns))
        now = _updated(size, centre + mean, spread, n, mean, cov, gamma)
        if abs(row[0] / n - last) < tolerance:
            break
        last = row[0] / n
    return Mixture(now.weights, now.means, now.covariances, now.constants, now.scales, now.precisions, last, it)


def _updated(size, centre, spread, n, mean, cov, gamma) -> Mixture:
    return em_mixture(size / n, centre, spread) if gamma is None else variational_mixture(size, centre, spread, mean, cov, gamma)


def fit_array(x: np.ndarray, k: int, max_iter: int = 100, gamma: float | None = None, tolerance: float = TOLERANCE) -> Mixture:
    """The same for rows in memory."""
    n, d = x.shape
    k = min(k, n)
    mean, cov = x.mean(axis=0), np.atleast_2d(np.cov(x.T, bias=True)) + FLOOR * np.eye(d)
    order = np.argsort(x[:, 0], kind="stable")
    means = np.array([x[part].mean(axis=0) for part in np.array_split(order, k)])
    for _ in range(LLOYD_STEPS):
        near = np.argmin(((x[:, None, :] - means) ** 2).sum(axis=2), axis=1)
        means = np.array([x[near == i].mean(axis=0) if (near == i).any() else means[i] for i in range(k)])
    now, last = em_mixture(np.full(k, 1 / k), means, np.array([cov / k + FLOOR * np.eye(d)] * k)), -math.inf
    y = x - mean
    design = np.column_stack([np.ones(n), y, *[y[:, i] * y[:, j] for i in range(d) for j in range(i, d)]])
    for it in range(1, max_iter + 1):
        terms = now.log_terms(x)
        top = terms.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(terms - top).sum(axis=1))
        size, centre, spread = _moments_from((np.exp(terms - total[:, None]).T @ design).ravel(), k, d)
        now = _updated(size, centre + mean, spread, n, mean, cov, gamma)
        ll = float(total.mean())
        if abs(ll - last) < tolerance:
            break
        last = ll
    return Mixture(now.weights, now.means, now.covariances, now.constants, now.scales, now.precisions, last, it)


def predict(df: DataFrame, mixture: Mixture, columns: Sequence[str], label: str = "cluster") -> DataFrame:
    """Adds the most probable component, the lowest number at a tie; null where a column is null."""
    terms = F.array(*mixture.terms(columns))
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return df.withColumn(label, F.when(known, F.array_position(terms, F.array_max(terms)).cast("int") - 1))


def fit_predict_frames(df: DataFrame, columns: Sequence[str], k: int = 8, max_iter: int = 100, gamma: float | None = None, label: str = "cluster", error: str | None = None) -> DataFrame:
    """df with a label from a mixture fitted to each frame by itself: a grouped map, one frame a group.

    error: a column that gets the message if a frame's fit fails, whose labels are then null; without it the failure is raised."""
    schema = T.StructType([*df.drop(label).schema.fields, T.StructField(label, T.IntegerType())])
    if error:
        schema = schema.add(error, T.StringType())
    columns = list(columns)

    def run(table: pa.Table) -> pa.Table:
        table = table.drop_columns([label]) if label in table.column_names else table
        out, known, message = np.full(table.num_rows, -1), np.zeros(table.num_rows, bool), None
        try:
            x = np.column_stack([table[c].to_numpy(zero_copy_only=False).astype(float) for c in columns])
            known = ~np.isnan(x).any(axis=1)
            if known.any():
                out[known] = np.argmax(fit_array(x[known], k, max_iter, gamma).log_terms(x[known]), axis=1)
        except Exception as e:
            if not error:
                raise
            known, message = np.zeros(table.num_rows, bool), f"{type(e).__name__}: {e}"
        table = table.append_column(label, pa.array(out, pa.int32(), mask=~known))
        return table.append_column(error, pa.array([message] * table.num_rows, pa.string())) if error else table

    return df.groupBy("frame").applyInArrow(run, schema)


def score_samples(df: DataFrame, mixture: Mixture, columns: Sequence[str], name: str = "log_likelihood") -> DataFrame:
    return df.withColumn(name, log_sum_exp(mixture.terms(columns)))


def likelihood_grid(df: DataFrame, mixture: Mixture, columns: Sequence[str], axes: tuple[str, str], n: int = 80, low: float = 0.01, high: float = 0.99, whole: bool = True) -> DataFrame:
    """i, j, the two axes' values and nll: negative log likelihood on an n x n grid between quantiles of df.

    whole: limits are rounded outward to whole numbers. The other columns are at their means."""
    limits = df.agg(*[F.percentile(a, F.array(F.lit(low), F.lit(high))).alias(a) for a in axes], *[F.avg(c).alias(f"mean_{c}") for c in columns if c not in axes]).first()
    spark: SparkSession = df.sparkSession
    grid = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    for a, at in zip(axes, ("j", "i"), strict=True):
        a0, a1 = (math.floor(limits[a][0]), math.ceil(limits[a][1])) if whole else limits[a]
        grid = grid.withColumn(a, F.lit(float(a0)) + F.col(at) * F.lit((a1 - a0) / max(1, n - 1)))
    for c in columns:
        if c not in axes:
            grid = grid.withColumn(c, F.lit(float(limits[f"mean_{c}"])))
    return grid.select("i", "j", *axes, (-log_sum_exp(mixture.terms(columns))).alias("nll"))


def hard_assign(df: DataFrame, weights: Sequence[float], means: Sequence[Sequence[float]], stds: Sequence[Sequence[float]], columns: Sequence[str], label: str = "cluster") -> DataFrame:
    """Adds argmax of log weight + log density of diagonal Gaussians."""
    covariances = [np.diag(np.square(s)) for s in stds]
    return predict(df, em_mixture(weights, means, covariances), columns, label)


def fit_with_priors(df: DataFrame, columns: Sequence[str], prior: Column, k: int, max_iter: int = 100, tolerance: float = 1e-4) -> Mixture:
    """EM of diagonal Gaussians in which each row has its own class probabilities (an array column) as weights.

    A point estimate of a mixture whose assignments have position-dependent priors, not a posterior sample of it."""
    data = materialize(df.select(*[F.col(c).cast("double").alias(c) for c in columns], prior.alias("__p")).dropna(), "prior-mixture")
    n, mean, cov = _overall(data, columns)
    weighted = data.agg(*[F.try_divide(F.sum(F.col("__p")[i] * F.col(c)), F.sum(F.col("__p")[i])) for i in range(k) for c in columns]).first()
    means, covariances, last = np.array(weighted, float).reshape(k, -1), np.array([np.diag(np.diag(cov))] * k), -math.inf
    x = [F.col(c) for c in columns]
    it = 0
    for it in range(1, max_iter + 1):
        terms = [F.log(F.col("__p")[i] + 1e-300) + log_gaussian(x, means[i], covariances[i]) for i in range(k)]
        held = data.select(*columns, log_sum_exp(terms).alias("__ll"), F.array(*[F.exp(t - log_sum_exp(terms)) for t in terms]).alias("__r"))
        sums = [F.sum("__ll")]
        for i in range(k):
            r = F.col("__r")[i]
            sums += [F.sum(r), *[F.sum(r * F.col(c)) for c in columns], *[F.sum(r * F.col(c) * F.col(c)) for c in columns]]
        row = np.array(held.agg(*sums).first(), float)
        table = row[1:].reshape(k, -1)
        size = table[:, 0] + 1e-12
        means = table[:, 1 : 1 + len(columns)] / size[:, None]
        covariances = np.array([np.diag(v) for v in np.maximum(table[:, 1 + len(columns) :] / size[:, None] - means**2, FLOOR)])
        if abs(row[0] / n - last) < tolerance:
            break
        last = row[0] / n
    made = em_mixture(size / size.sum(), means, covariances)
    return Mixture(made.weights, made.means, made.covariances, made.constants, made.scales, made.precisions, last, it)


def parameters(mixture: Mixture, spark: SparkSession) -> DataFrame:
    """k, weight, mean, covariance as a table, to be written with the results."""
    rows = [(k, float(w), m.tolist(), c.tolist()) for k, (w, m, c) in enumerate(zip(mixture.weights, mixture.means, mixture.covariances, strict=True))]
    return spark.createDataFrame(rows, "k int, weight double, mean array<double>, covariance array<array<double>>")
