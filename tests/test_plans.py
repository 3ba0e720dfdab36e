"""The plans that the operators should get: pruned scans, pushed predicates, partial aggregates, no Python in relational work."""

import re

import pytest

from vectorloom.operators import filters, postprocess
from vectorloom.plans import registry
from vectorloom.sources import adapters, catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned(spark, sf_dir):
    text = plan(filters.percentile_filter(adapters.field(spark, sf_dir)))
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text):
        assert {c.split(":")[0] for c in schema.split(",")} <= {"l_partkey", "l_linenumber", "l_quantity", "l_shipdate"}
    assert "partial_sum" in text and "partial_percentile" in text
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text


def test_dates_are_pushed(spark, sf_dir):
    text = plan(catalog.analyses_of(adapters.joined_catalog(spark, sf_dir), reference_date="1996-07-04"))
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", text)
    assert any("GreaterThanOrEqual(o_orderdate" in p for p in pushed)
    assert text.count("BroadcastHashJoin") >= 2


def test_first_rows_are_not_a_full_sort(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(catalog.first_analyses(adapters.joined_catalog(spark, sf_dir)))
    assert "WindowGroupLimit" in plan(catalog.first_analyses(adapters.joined_catalog(spark, sf_dir), "camera_name"))


def test_regions_have_a_bounding_box_that_reaches_the_scan(spark, tmp_path):
    from vectorloom.operators import roi

    spark.range(10).selectExpr("cast(id as double) as x", "cast(id as double) as y").write.parquet(str(tmp_path / "f"))
    text = plan(roi.clip(spark.read.parquet(str(tmp_path / "f")), registry.REGION))
    assert "GreaterThanOrEqual(x" in text and "LessThanOrEqual(x" in text


def test_label_cleaning_stays_on_the_jvm(spark, sf_dir):
    labelled = registry._octants(spark, sf_dir)
    for df in (postprocess.remove_small_clusters(labelled, 5), postprocess.merge_clusters(labelled, 5.0), postprocess.smooth_labels(labelled, 3, unit=16.0)):
        text = plan(df)
        assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text


def test_batch_fit_takes_the_settings_as_they_are(spark, sf_dir, monkeypatch):
    from vectorloom.config import Settings
    from vectorloom.plans import registry

    class Taken(Exception):
        pass

    def run(tasks, field, settings, polygon, fit):
        assert settings == Settings() and fit
        raise Taken

    monkeypatch.setattr(registry.batch, "run", run)
    with pytest.raises(Taken):
        registry.queries()["batch_fit"](spark, sf_dir)


def test_a_hub_is_split_over_tasks(spark, tmp_path):
    from vectorloom.operators import graph

    spark.range(40_000).selectExpr("case when id % 4 = 0 then id else 7 end as u", "id + 1000000 as v").where("u <> v").write.parquet(str(tmp_path / "e"))
    edges = spark.read.parquet(str(tmp_path / "e"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = graph._small_star(edges.selectExpr("case when v % 4 = 0 then v else 100000000 end as u", "v - 1000000 as v"))
        out.collect()
        assert "skew=true" in plan(out)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    roots = {r["node"]: r["root"] for r in graph.components(edges, "hub").collect()}
    assert roots[1_000_001] == 7 and roots[1_000_004] == 4 and len(set(roots.values())) == 10_000 + 1


def test_bytes_of_a_table(spark):
    from vectorloom import storage

    df = spark.createDataFrame([(1, "x" * 1000, [1, 2, 3], ["y" * 500], None)], "a long, b string, c array<long>, d array<string>, e string")
    assert 1500 < storage.table_bytes(df) < 1800
    assert storage.table_bytes(df.limit(0)) == 0
