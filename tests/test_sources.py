import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectorloom import config
from vectorloom.config import Filters, Settings
from vectorloom.functions import naming
from vectorloom.operators import features
from vectorloom.plans import batch
from vectorloom.sources import catalog, fields, images, polygons, rest, sinks
from vectorloom.streaming import ingest


def payload(n=6, scale=1.0):
    return json.dumps({"points": [[float(k), 0.0] for k in range(n)], "vectors": [[scale * k, 1.0] for k in range(n)], "magnitudes": [scale * k + 1.0 for k in range(n)]})


def test_payloads(spark):
    raw = spark.createDataFrame([(7, payload(3))], "frame long, body string")
    rows = fields.from_payloads(raw).orderBy("x").collect()
    assert [(r["frame"], r["x"], r["u"], r["speed"]) for r in rows] == [(7, 0.0, 0.0, 1.0), (7, 1.0, 1.0, 2.0), (7, 2.0, 2.0, 3.0)]


def test_large_frames_are_several_payloads(spark):
    # 24,000 points of frame 1, 12,000 rows that are all the same (frame 2), and frames of 3 rows.
    one = [(1, float(k % 160), float(k // 160), 0.1 * k, -0.0, None if k % 7 == 0 else k / 3) for k in range(24_000)]
    rows = one + [(2, 1.0, 2.0, 3.0, 4.0, 5.0)] * 12_000 + [(f, float(k), 0.0, 1.0, 1.0, 2.0) for f in (3, None) for k in range(3)]
    field = spark.createDataFrame(rows, "frame long, x double, y double, u double, v double, speed double")
    bodies = fields.to_payloads(field)
    sizes = bodies.select("frame", F.size(F.from_json("body", fields.PAYLOAD)["points"]).alias("n")).collect()
    assert max(r["n"] for r in sizes) <= 10_000
    assert [sum(r["n"] for r in sizes if r["frame"] == f) for f in (1, 2, 3, None)] == [24_000, 12_000, 3, 3]
    assert [r["n"] for r in sizes if r["frame"] in (3, None)] == [3, 3]
    back = fields.from_payloads(bodies).collect()
    assert Counter(map(repr, map(tuple, back))) == Counter(map(repr, rows))


@pytest.mark.parametrize("body", ["{}", "not json", '{"points": [], "vectors": [], "magnitudes": []}', '{"points": [[1, 2]], "vectors": [], "magnitudes": [1]}', '{"points": [[1, 2]]}'])
def test_bad_payloads(spark, body):
    raw = spark.createDataFrame([(1, body), (2, payload(2))], "frame long, body string")
    assert {r["frame"] for r in fields.from_payloads(raw, strict=False).collect()} == {2}
    with pytest.raises(Exception, match="frame 1"):
        fields.from_payloads(raw).collect()


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, float("nan")), (1, 1.0, 0.0, 1.0, 1.0, 2.0)], "frame long, seed_x_px double, seed_y_px double, displacement_x_px double, displacement_y_px double, displacement_magnitude_px double")
    assert [r["speed"] for r in fields.from_table(df).orderBy("x").collect()] == [None, 2.0]
    with pytest.raises(ValueError):
        fields.from_table(df.drop("seed_x_px"))


def catalog_tables(spark):
    a = spark.sql("select * from values (1, 10, timestamp_ntz'2024-09-02 10:00:00'), (2, 10, timestamp_ntz'2024-09-02 08:00:00'), (3, 11, timestamp_ntz'2024-09-02 08:00:00'), (4, 12, timestamp_ntz'2024-09-03 08:00:00') as t(dic_id, master_image_id, master_timestamp)")
    a = a.withColumn("reference_date", F.to_date("master_timestamp"))
    i = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "image_id long, camera_id long")
    c = spark.createDataFrame([(1, "Tele_A"), (2, "Wide")], "camera_id long, camera_name string")
    return a, i, c


def test_catalog(spark):
    joined = catalog.joined(*catalog_tables(spark))
    ids = lambda df: [r["dic_id"] for r in catalog.ordered(df).collect()]
    assert ids(catalog.analyses_of(joined)) == [2, 3, 1, 4]
    assert ids(catalog.analyses_of(joined, reference_date="2024-09-02", camera_name="Tele_A")) == [2, 3, 1]
    assert ids(catalog.analyses_of(joined, master_timestamp="2024-09-03", camera_id=2)) == [4]
    assert catalog.first_analyses(joined).first()["dic_id"] == 2  # the tie goes to the smaller id
    assert {r["camera_name"]: r["dic_id"] for r in catalog.first_analyses(joined, "camera_name").collect()} == {"Tele_A": 2, "Wide": 4}
    assert [tuple(r) for r in catalog.tasks(catalog.work_list(joined, ["Wide"])).collect()][0][1] == "Wide"
    assert catalog.dates_by_camera(catalog.work_list(joined)).count() == 2


def test_batch_statuses(spark, tmp_path):
    a, i, c = catalog_tables(spark)
    joined = catalog.joined(a, i, c)
    work = catalog.work_list(joined).unionByName(spark.sql("select date'2030-01-01' as reference_date, 'Wide' as camera_name"))
    tasks = batch.plan_tasks(joined, work, i)
    field = fields.from_payloads(spark.createDataFrame([(2, payload(60, 0.5))], "frame long, body string"))
    settings = Settings(filters=Filters(apply_2d_median=False))
    labelled, results = batch.run(tasks, field, settings)
    got = {(r["camera_name"], str(r["target_date"])): (r["status"], r["reason"], r["error"], r["n_points"]) for r in results.collect()}
    assert got == {("Tele_A", "2024-09-02"): ("success", None, None, 58), ("Wide", "2024-09-03"): ("error", None, "no data", None), ("Wide", "2030-01-01"): ("skipped", "no analyses", None, None)}
    assert batch.tally(results).first() == (3, 1, 1, 1)
    assert batch.plan_tasks(joined, work, i.where("image_id <> 10")).where("reason = 'no image'").count() == 1
    sinks.write_features(labelled.withColumn("camera_name", F.lit("Tele_A")), str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == labelled.count() and "cluster" in back.columns


def test_polygon_files(spark, tmp_path):
    p = polygons.write_polygon([(0, 0), (1, 0), (0, 1)], str(tmp_path / "new" / "roi"))
    assert p.endswith("roi.json") and polygons.read_polygon(spark, p) == [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]]
    polygons.write_polygon([(5, 5), (6, 5), (5, 6)], str(tmp_path / "new" / "b.json"))
    assert [(r["idx"], r["points"][0]) for r in polygons.read_sectors(spark, str(tmp_path / "new" / "*.json")).collect()] == [(0, [5.0, 5.0]), (1, [0.0, 0.0])]
    with pytest.raises(ValueError):
        polygons.write_polygon([(0, 0)], str(tmp_path / "x"))
    (tmp_path / "two.json").write_text('{"polygon_points": [[0, 0], [1, 1]]}')
    assert polygons.read_polygon(spark, str(tmp_path / "two.json")) is None
    assert polygons.closed([(0, 0), (1, 0)]) == [(0, 0), (1, 0), (0, 0)]


def test_rest_source(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(payload(int(self.path.strip("/").split("/")[-1])).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rest.register(spark)
    raw = spark.read.format("dic_rest").option("base_url", f"http://127.0.0.1:{server.server_port}").option("dic_ids", "3,5").load()
    got = {r["frame"]: r["n"] for r in fields.from_payloads(raw).groupBy("frame").agg(F.count("*").alias("n")).collect()}
    server.shutdown()
    assert got == {3: 3, 5: 5}


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in (1, 2):
        (source / f"{k}.json").write_text(payload(50, 0.2 * k))
    settings = Settings(filters=Filters(apply_2d_median=False))
    ingest.start(ingest.read_payloads(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "checkpoint"), settings, once=True).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    raw = spark.createDataFrame([(k, payload(50, 0.2 * k)) for k in (1, 2)], "frame long, body string")
    want = ingest.process(raw, settings)
    key = lambda df: sorted((r["frame"], r["x"], r["magnitude_category"] or "") for r in df.collect())
    assert key(streamed) == key(want)


def test_names(spark):
    df = spark.sql("select timestamp_ntz'2024-09-02 08:05:03' as t, 'Tele' as c, -1 as a, 3 as b")
    run = naming.run_name(F.col("c"), F.col("t"))
    got = df.select(naming.title_of(F.col("t")), naming.stamp_of(F.col("t")), naming.stamp_of_text(naming.title_of(F.col("t"))), naming.model_name(run, 8, "full", 0.5), naming.label_name(F.col("a")), naming.label_name(F.col("b")), images.needs_rotation(F.col("c"))).first()
    assert tuple(got) == ("2024-09-02 08:05:03", "20240902_080503", "2024-09-02_08-05-03", "Tele_2024-09-02_GMM_GMM_comp8_covfull_wcp0.5", "Noise", "Cluster 3", True)


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("filters:\n  min_velocity: 0.5\ncamera_names: [a, b]\n")
    s = config.load(str(tmp_path / "c.yaml"), {"DB_HOST": "h", "APP_PORT": "1"})
    assert s.filters.min_velocity == 0.5 and s.camera_names == ("a", "b") and s.database.host == "h"
    assert s.get("filters.tails_percentile") == 0.01 and s.get("filters.missing", 3) == 3
    assert s.get_api_url("/x") == "http://localhost:1/x" and s.db_url.startswith("postgresql://") and s.jdbc_url == "jdbc:postgresql://h:5432/"
    with pytest.raises(KeyError):
        config.merged(s, {"nothing": 1})


def test_settings_files_with_other_names(tmp_path):
    (tmp_path / "c.yaml").write_text(
        """
database: {host: h, port: 5433, name: db, user: "", password: ""}
api: {host: a, port: 81, image_view: images}
data: {target_date: "2024-09-02", camera_names: [Cam], roi_path: roi.json}
dic: {filter_outliers: true, tails_percentile: 0.02, min_velocity: 1, apply_2d_median: false, median_window_size: 7, median_threshold_factor: 2.5}
clustering: {variables_names: [V, angle_deg], n_components: 6, weight_concentration_prior: 0.1, max_iter: 50, random_state: 1, covariance_type: full}
output: {base_dir: out, save_plots: false, plot_dpi: 100}
processing: {n_jobs: 2, log_level: DEBUG}
"""
    )
    s = config.load(str(tmp_path / "c.yaml"), {})
    assert s.filters == Filters(True, 0.02, 1, False, 7, 2.5) and s.clustering.features == ("speed", "angle_deg") and s.clustering.n_components == 6
    assert (s.target_date, s.camera_names, s.roi_path, s.n_jobs, s.log_level, s.output.base_dir) == ("2024-09-02", ("Cam",), "roi.json", 2, "DEBUG", "out")
    assert s.db_url == "postgresql://:@h:5433/db" and s.get_api_url() == "http://a:81" and s.get_api_url("/x") == "http://a:81/x"
    assert s.get("dic.median_window_size") == 7 and s.get("data.target_date") == "2024-09-02" and s.get("clustering.variables_names") == ("speed", "angle_deg") and s.get("processing.none") is None
    (tmp_path / "bad.yaml").write_text("dic: {nothing: 1}")
    with pytest.raises(KeyError):
        config.load(str(tmp_path / "bad.yaml"), {})


def test_a_fit_that_fails_is_its_tasks_error(spark, monkeypatch):
    from vectorloom.operators import mixture

    a, i, c = catalog_tables(spark)
    joined = catalog.joined(a, i, c)
    tasks = batch.plan_tasks(joined, catalog.work_list(joined), i)
    field = fields.from_payloads(spark.createDataFrame([(2, payload(60, 0.5)), (4, payload(3, 0.5))], "frame long, body string"))
    settings = Settings(filters=Filters(filter_outliers=False, apply_2d_median=False))

    def fails(x, *rest, real=mixture.fit_array):
        if len(x) < 10:
            raise ValueError("too few rows")
        return real(x, *rest)

    monkeypatch.setattr(mixture, "fit_array", fails)
    rows = []  # the grouped map's function, tried in this process: a worker would import the operator anew
    table = pa.table({"frame": [4, 4], "a": [1.0, 2.0]})

    class Grouped:
        def applyInArrow(self, run, schema):
            rows.append((run(table), schema))

    class Frame:
        schema = T.StructType([T.StructField("frame", T.LongType()), T.StructField("a", T.DoubleType())])

        def drop(self, *_):
            return self

        def groupBy(self, *_):
            return Grouped()

    mixture.fit_predict_frames(Frame(), ["a"], error="why")
    assert rows[0][0]["cluster"].to_pylist() == [None, None] and rows[0][0]["why"].to_pylist() == ["ValueError: too few rows"] * 2
    assert [f.name for f in rows[0][1]] == ["frame", "a", "cluster", "why"]
    with pytest.raises(ValueError):
        mixture.fit_predict_frames(Frame(), ["a"])
    monkeypatch.undo()

    def broken(df, columns, *rest, error=None, **more):
        label = F.when(F.col("frame") == 4, F.lit(None)).otherwise(0).cast("int")
        return df.withColumn("cluster", label).withColumn(error, F.when(F.col("frame") == 4, "ValueError: x"))

    monkeypatch.setattr(batch.mixture, "fit_predict_frames", broken)
    labelled, results = batch.run(tasks, field, settings)
    got = {r["frame"]: (r["status"], r["error"], r["n_clusters"]) for r in results.collect()}
    assert got == {2: ("success", None, 1), 4: ("error", "ValueError: x", None)}
    assert {r["frame"] for r in labelled.collect()} == {2}


def test_category_features_of_payload(spark):
    raw = spark.createDataFrame([(1, payload(20))], "frame long, body string")
    assert features.features(fields.filtered(raw)).count() > 0
