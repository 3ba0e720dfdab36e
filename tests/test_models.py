import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.functions.gaussian import digamma, log_gaussian
from vectorloom.operators import dbscan, features, mixture, pca, summary
from vectorloom.plans import registry
from vectorloom.sources import synthetic


def test_digamma():
    for x, want in ((1.0, -0.57721566490153286), (0.5, -1.9635100260214235), (10.0, 2.2517525890667211)):
        assert digamma(x) == pytest.approx(want, abs=1e-10)


def test_log_gaussian(spark):
    mean, cov = [1.0, -2.0], [[2.0, 0.5], [0.5, 1.0]]
    df = spark.createDataFrame([(0.3, 0.7)], "a double, b double")
    d = np.array([0.3, 0.7]) - mean
    want = -0.5 * (d @ np.linalg.inv(cov) @ d + math.log(np.linalg.det(cov)) + 2 * math.log(2 * math.pi))
    assert df.select(log_gaussian([F.col("a"), F.col("b")], mean, cov)).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("gamma", [None, 0.5])
def test_recovery(spark, gamma):
    df = synthetic.mixture_2d(spark)
    made = mixture.fit(df, ["x", "y"], 3, gamma=gamma)
    labelled = mixture.predict(df, made, ["x", "y"])
    assert summary.adjusted_rand(labelled, "true_cluster", "cluster").first()[0] > 0.95
    assert made.weights.sum() == pytest.approx(1, abs=1e-3)
    parts = mixture.responsibilities(made, ["x", "y"])
    r = df.select(sum(parts[1:], parts[0]).alias("r"))
    assert r.agg(F.min("r"), F.max("r")).first() == (pytest.approx(1), pytest.approx(1))


def test_variational_fit_empties_components(spark):
    x = np.array([(r["x"], r["y"]) for r in synthetic.mixture_2d(spark).collect()])
    made = mixture.fit_array(x, 8, 300, 1e-3, 1e-7)
    assert (made.weights > 0.02).sum() <= 5


def test_distributed_and_local_fits_agree(spark):
    df = synthetic.mixture_2d(spark)
    x = np.array([(r["x"], r["y"]) for r in df.collect()])
    for gamma in (None, 0.5):
        a, b = mixture.fit(df, ["x", "y"], 3, gamma=gamma), mixture.fit_array(x, 3, gamma=gamma)
        assert np.allclose(sorted(a.means[:, 0]), sorted(b.means[:, 0]), atol=0.05)


def test_likelihood_rises(spark):
    df = synthetic.mixture_2d(spark)
    now, last = mixture.em_mixture([0.5, 0.5], [[-1.0, 0.0], [1.0, 0.0]], [np.eye(2)] * 2), -math.inf
    for _ in range(6):
        row = list(mixture.sufficient_statistics(df, now, ["x", "y"]).first())
        assert row[0] >= last - 1e-6
        last = row[0]
        size, mean, cov = mixture._moments_from(np.array(row[1:], float), 2, 2)
        now = mixture.em_mixture(size / 600, mean, cov)


def test_frames_are_fitted_apart(spark):
    df = synthetic.mixture_2d(spark).withColumn("frame", (F.col("id") % 2).cast("long"))
    df = df.withColumn("x", F.when(F.col("id") == 7, None).otherwise(F.col("x")))
    out = mixture.fit_predict_frames(df, ["x", "y"], 3)
    assert out.count() == 600 and out.where("cluster is null").count() == 1
    for frame in (0, 1):
        assert summary.adjusted_rand(out.where(f"frame = {frame} and cluster is not null"), "true_cluster", "cluster").first()[0] > 0.9


def test_priors(spark):
    df = synthetic.mixture_2d(spark)
    made = mixture.fit_with_priors(df, ["x", "y"], features.spatial_prior(), 3)
    assert summary.adjusted_rand(mixture.predict(df, made, ["x", "y"]), "true_cluster", "cluster").first()[0] > 0.95


def test_empty_input_is_an_error(spark):
    with pytest.raises(ValueError):
        mixture.fit(spark.createDataFrame([], "x double, y double"), ["x", "y"], 2)


def test_pca(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3)) @ np.array([[3, 1, 0], [0, 1, 0.2], [0, 0, 0.1]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    for scaled in (False, True):
        z = (x - x.mean(axis=0)) / (x.std(axis=0) if scaled else 1)
        _, s, vt = np.linalg.svd(z, full_matrices=False)
        got = np.array([(r["PC1"], r["PC2"]) for r in pca.pca(df, ["a", "b", "c"], 2, scaled).collect()])
        assert np.allclose(np.abs(got), np.abs(z @ vt[:2].T), atol=1e-8)
    with pytest.raises(ValueError):
        pca.pca(df, ["a", "missing"])


def plain_dbscan(points, eps, least):
    near = [[j for j, q in enumerate(points) if math.dist(p, q) <= eps] for p in points]
    core = [len(n) >= least for n in near]
    label, k = [-1] * len(points), 0
    for i in range(len(points)):
        if core[i] and label[i] == -1:
            stack = [i]
            while stack:
                a = stack.pop()
                if label[a] == -1 and core[a]:
                    label[a] = k
                    stack += near[a]
            k += 1
    for i in range(len(points)):
        if not core[i]:
            label[i] = min((label[j] for j in near[i] if core[j]), default=-1)
    return label


def test_dbscan_equals_plain_version(spark):
    rng = random.Random(3)
    pts = [(rng.gauss(c, 0.4), rng.gauss(0, 0.4), rng.gauss(0, 0.1)) for c in (0, 3, 6) for _ in range(50)] + [(rng.uniform(-2, 8), rng.uniform(-3, 3), 0.0) for _ in range(20)]
    df = spark.createDataFrame([(1, k, *p) for k, p in enumerate(pts)], "frame long, id long, a double, b double, c double")
    got = {r["id"]: r["cluster"] for r in dbscan.dbscan(df, ["a", "b", "c"], 0.3, 5).collect()}
    assert [got[k] for k in range(len(pts))] == plain_dbscan(pts, 0.3, 5)
    mixed = df.orderBy(F.rand(1))
    assert {r["id"]: r["cluster"] for r in dbscan.dbscan(mixed, ["a", "b", "c"], 0.3, 5).collect()} == got


def test_dbscan_border_and_nulls(spark):
    rows = [(0, 0.0), (1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (5, 5.0), (6, 6.0), (7, None)]
    df = spark.createDataFrame([(1, k, x, 0.0) for k, x in rows if k != 3] + [(1, 3, 3.0, 0.0)], "frame long, id long, a double, b double")
    got = {r["id"]: r["cluster"] for r in dbscan.dbscan(df, ["a", "b"], 1.0, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: -1}


def test_density_queries_take_the_whole_field(spark, sf_dir):
    frames = {}
    for r in sorted(registry.field(spark, sf_dir).collect(), key=lambda r: (r["frame"], r["x"], r["y"])):
        frames.setdefault(r["frame"], []).append((r["x"], r["y"], r["speed"]))
    labels = {(r["frame"], r["x"], r["y"]): r["cluster"] for r in registry.queries()["dbscan_field_labels"](spark, sf_dir).collect()}
    flags = {(r["frame"], r["x"], r["y"]): (r["degree"], r["core"]) for r in registry.queries()["dbscan_field_core_flags"](spark, sf_dir).collect()}
    assert len(labels) == len(flags) == sum(map(len, frames.values()))
    for frame, pts in frames.items():
        assert [labels[frame, x, y] for x, y, _ in pts] == plain_dbscan(pts, 48.0, 9)
        degree = [sum(math.dist(p, q) <= 48.0 for q in pts) for p in pts]
        assert [flags[frame, x, y] for x, y, _ in pts] == [(d, d >= 9) for d in degree]


@pytest.mark.parametrize("name", ["gmm_fit", "vbgmm_fit"])
def test_fits_take_the_whole_field(spark, sf_dir, name):
    want = {r["frame"]: r["count"] for r in registry.field(spark, sf_dir).groupBy("frame").count().collect()}
    got = {}
    for r in registry.queries()[name](spark, sf_dir).collect():
        got[r["frame"]] = got.get(r["frame"], 0) + r["count"]
    assert got == want


def test_likelihood_grid_of_the_reference(spark, sf_dir):
    assert registry.queries()["gmm_nll_grid_80"](spark, sf_dir).count() == 80 * 80
