import random
from collections import Counter

import numpy as np
import pytest

from vectorloom.operators import postprocess as P
from vectorloom.operators import summary

DDL = "frame long, x double, y double, u double, v double, speed double, angle_rad double, angle_deg double, cluster int"


def labelled(spark, rows):
    """From (x, y, label)."""
    return spark.createDataFrame([(1, float(x), float(y), 0.0, 0.0, float(x), 0.0, 10.0, c) for x, y, c in rows], DDL)


def labels_of(df):
    return {(r["x"], r["y"]): r["cluster"] for r in df.collect()}


def test_small_clusters_are_strictly_smaller(spark):
    rows = [(k, c, c) for c, n in ((0, 29), (1, 30), (2, 31)) for k in range(n)]
    assert Counter(labels_of(P.remove_small_clusters(labelled(spark, rows))).values()) == {-1: 29, 1: 30, 2: 31}


def plain_smooth(rows, window):
    cells = {(int(y), int(x)): c for x, y, c in sorted(rows)}
    out = {}
    for x, y, _ in rows:
        got = Counter()
        for a in range(-(window // 2), window - window // 2):
            for b in range(-(window // 2), window - window // 2):
                c = cells.get((int(y) + a, int(x) + b), -1)
                if c != -1:
                    got[c] += 1
        out[(float(x), float(y))] = min((c for c in got if got[c] == max(got.values())), default=-1)
    return out


@pytest.mark.parametrize("window", [2, 3, 4])
def test_smoothing_equals_definition(spark, window):
    rng = random.Random(window)
    rows = [(j, i, rng.choice([-1, 0, 1, 2])) for i in range(9) for j in range(8) if rng.random() < 0.7]
    assert labels_of(P.smooth_labels(labelled(spark, rows), window)) == plain_smooth(rows, window)


def test_smoothing_rejects_negative_coordinates(spark):
    with pytest.raises(ValueError):
        P.smooth_labels(labelled(spark, [(-1, 0, 1)]))


def literal_merge(rows, threshold):
    """The double loop over pairs of clusters, one after the other."""
    names = sorted({c for *_, c in rows if c != -1})
    mean = {c: np.array([np.mean([x for x, y, k in rows if k == c]), np.mean([y for x, y, k in rows if k == c]), np.mean([x for x, y, k in rows if k == c]), 0.0]) for c in names}
    now = [c for *_, c in rows]
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if np.linalg.norm(mean[a] - mean[b]) < threshold:
                now = [a if c == b else c for c in now]
    return {(float(x), float(y)): c for (x, y, _), c in zip(rows, now)}


def test_merge_equals_the_loop(spark):
    chain = [(0, 0, 0), (4, 0, 1), (8, 0, 2), (50, 0, -1)]
    assert labels_of(P.merge_clusters(labelled(spark, chain), 6.0)) == {(0.0, 0.0): 0, (4.0, 0.0): 0, (8.0, 0.0): 1, (50.0, 0.0): -1}
    for seed in range(4):
        rng = random.Random(seed)
        rows = list({(rng.randrange(30), rng.randrange(30)): rng.randrange(-1, 7) for _ in range(60)}.items())
        rows = [(x, y, c) for (x, y), c in rows]
        assert labels_of(P.merge_clusters(labelled(spark, rows), 7.3)) == literal_merge(rows, 7.3)


def test_stats(spark):
    df = labelled(spark, [(1, 0, -1), (2, 0, 4), (4, 0, 4)])
    got = {r["cluster_name"]: r for r in summary.cluster_stats(df).collect()}
    assert set(got) == {"Noise", "Cluster 4"}
    assert got["Noise"]["std_magnitude"] is None and got["Cluster 4"]["mean_magnitude"] == 3.0
    assert got["Cluster 4"]["std_magnitude"] == pytest.approx(np.std([2, 4], ddof=1))
    assert summary.cluster_count(df).first()["n_clusters"] == 2
    assert summary.cluster_count(df, with_noise=False).first()["n_clusters"] == 1


def test_adjusted_rand(spark):
    def plain(a, b):
        pairs = lambda c: sum(n * (n - 1) / 2 for n in c.values())
        cells, rows, columns, all_ = pairs(Counter(zip(a, b))), pairs(Counter(a)), pairs(Counter(b)), len(a) * (len(a) - 1) / 2
        expected = rows * columns / all_
        return (cells - expected) / ((rows + columns) / 2 - expected)

    rng = random.Random(1)
    a, b = [rng.randrange(3) for _ in range(60)], [rng.randrange(4) for _ in range(60)]
    of = lambda x, y: summary.adjusted_rand(spark.createDataFrame(list(zip(x, y)), "a int, b int"), "a", "b").first()[0]
    assert of(a, b) == pytest.approx(plain(a, b))
    assert of(a, [5 - x for x in a]) == pytest.approx(1.0)
    assert of([1, 1], [2, 2]) == 1.0


def test_posterior(spark):
    s = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (1, 0), (1, 2)], "obs long, z int")
    assert {r["obs"]: r["z"] for r in summary.posterior_mode(s).collect()} == {0: 1, 1: 0}
    p = summary.assignment_probability(s, 3)
    assert {r["obs"]: r["probability"] for r in p.collect()} == {0: [0.0, 0.5, 0.5], 1: [pytest.approx(2 / 3), 0.0, pytest.approx(1 / 3)]}
    entropy = {r[0]: r[1] for r in p.select("obs", summary.entropy(p["probability"])).collect()}
    assert entropy[0] == pytest.approx(np.log(2), abs=1e-6)


def test_limits_and_levels(spark):
    df = labelled(spark, [(k, 0, 0) for k in range(11)])
    assert summary.color_range(df, vmax=0.0).first()["vmax"] == 0.0
    assert summary.color_range(df, vmax=0.0, zero_is_unset=True).first()["vmax"] == 10.0
    assert summary.contour_levels(df, "speed", 3, 0.0, 1.0).first()["levels"] == [0.0, 5.0, 10.0]
    assert summary.batch_summary(spark.createDataFrame([("success",), ("error",), ("success",)], "status string")).first() == (3, 2, 0, 1)
    assert not summary.has_values(df.where("false"), "x").first()[0]
