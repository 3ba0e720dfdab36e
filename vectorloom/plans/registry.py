"""The queries of the field engine, by name, with the SQL that checks them.

`query(sql)` registers a function (spark, sf_dir) -> DataFrame under its name. The SQL runs on the same tables in another
engine. Doubles that aren't exact in both are rounded to six decimals, with 0.0 added so that no zero is negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.config import Clustering, Filters, Settings
from vectorloom.functions import naming
from vectorloom.operators import dbscan, features, filters, mixture, pca, postprocess, raster, roi, summary
from vectorloom.plans import batch
from vectorloom.sources import adapters, catalog, fields, images, polygons, synthetic

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def r6(c: Column | str, name: str | None = None) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return (F.round(column, 6) + 0.0).alias(name or c)


def s6(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) + 0.0 as {name or expression}"


field = adapters.field
KEY = ["frame", "x", "y"]

# --- the field and what is made of it, in SQL -------------------------------------------------------------------------
FIELD = """
f0 as (select cast(year(l_shipdate) as bigint) as frame, cast((l_partkey % 40) * 16 as double) as x, cast(cast(floor(l_partkey / 40) as bigint) * 16 as double) as y,
              (sum(l_quantity) - 25 * count(*)) / 8.0 as u, (sum(cast(l_linenumber as double) * 8) - 32 * count(*)) / 8.0 as v
       from lineitem group by 1, 2, 3),
f as (select *, sqrt(u * u + v * v) as speed from f0)"""
QUARTILES = "q as (select frame, quantile_cont(speed, 0.25) as a, quantile_cont(speed, 0.5) as b, quantile_cont(speed, 0.75) as c from {src} group by frame)"
CATEGORY = "case when speed <= 0 then null when speed <= a then 'low' when speed <= b then 'medium' when speed <= c then 'high' when speed is not null then 'very_high' end"
ORDINAL = "case when speed <= 0 then null when speed <= a then 0 when speed <= b then 1 when speed <= c then 2 when speed is not null then 3 end"
ANGLE = "(degrees(atan2(v, u)) + 360) % 360"
#: Labels for post-processing: the octant of the direction.
OCTANT = f"cast(floor({ANGLE} / 45) as integer)"
PERCENTILED = "p as (select f.* from f join (select frame, quantile_cont(speed, 0.01) as lo, quantile_cont(speed, 0.99) as hi from f group by frame) using (frame) where speed >= lo and speed <= hi)"


def median_sql(src: str, window: int = 5, factor: float = 3.0) -> str:
    low, high = -(window // 2), window - window // 2
    reflect = lambda k, n: f"case when ((({k}) % (2 * {n})) + 2 * {n}) % (2 * {n}) >= {n} then 2 * {n} - 1 - ((({k}) % (2 * {n})) + 2 * {n}) % (2 * {n}) else ((({k}) % (2 * {n})) + 2 * {n}) % (2 * {n}) end"
    pick = lambda src_, value: f"select c.frame, c.i, c.j, any_value(c.{value}) as own, list_sort(list(s.{value}))[cast(floor(count(*) / 2) as integer) + 1] as m from (select *, {reflect('i + a', 'ny')} as ri, {reflect('j + b', 'nx')} as rj from {src_}, offs) c join {src_} s on s.frame = c.frame and s.i = c.ri and s.j = c.rj group by 1, 2, 3"
    return f"""
box as (select frame, min(x) as x0, min(y) as y0, cast(ceil((max(x) - min(x)) / 16 + 1) as bigint) as nx, cast(ceil((max(y) - min(y)) / 16 + 1) as bigint) as ny from {src} group by frame),
g as (select {src}.*, ny, nx, cast(greatest(0, least(ceil((y - y0) / 16 - 0.5), ny - 1)) as bigint) as i, cast(greatest(0, least(ceil((x - x0) / 16 - 0.5), nx - 1)) as bigint) as j from {src} join box using (frame)),
offs as (select a, b from range({low}, {high}) as ra(a), range({low}, {high}) as rb(b)),
m1 as ({pick('g', 'speed')}),
d as (select m1.frame, m1.i, m1.j, abs(own - m) as dev, ny, nx from m1 join (select frame, any_value(ny) as ny, any_value(nx) as nx from g group by frame) using (frame)),
m2 as ({pick('d', 'dev')}),
kept as (select g.frame, g.x, g.y, g.u, g.v, g.speed from g join m2 using (frame, i, j) where not coalesce(own > {factor} * m, false))"""


# --- flagship ---------------------------------------------------------------------------------------------------------
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered field's clusters by magnitude category."""
    kept = filters.min_speed_filter(filters.percentile_filter(field(spark, sf_dir)), 1.0)
    labelled = features.features(kept).withColumn("cluster", features.ordinal(F.col("magnitude_category")))
    return summary.cluster_stats(labelled.where("cluster is not null"))


@query(
    f"""with {FIELD}, {PERCENTILED}, k as (select * from p where speed >= 1), {QUARTILES.format(src='k')},
    l as (select frame, {ORDINAL} as cluster, speed, {ANGLE} as angle_deg from k join q using (frame))
    select frame, 'Cluster ' || cluster as cluster_name, count(*) as "count", {s6('avg(speed)', 'mean_magnitude')}, {s6('avg(angle_deg)', 'mean_direction')}, {s6('stddev_samp(speed)', 'std_magnitude')}
    from l where cluster is not null group by frame, cluster"""
)
def category_stats(spark, sf_dir):
    return flagship(spark, sf_dir).select("frame", "cluster_name", "count", *[r6(c) for c in ("mean_magnitude", "mean_direction", "std_magnitude")])


# --- catalog ----------------------------------------------------------------------------------------------------------
CATALOG = "c as (select o_orderkey as dic_id, o_custkey as master_image_id, o_orderdate as master_timestamp, o_orderdate as reference_date, n_nationkey as camera_id, n_name as camera_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"
CATALOG_COLUMNS = ["dic_id", "camera_id", "camera_name", "master_image_id", "master_timestamp"]


@query(f"with {CATALOG} select dic_id, camera_id, camera_name, master_image_id, master_timestamp from c where cast(reference_date as date) = date '1996-07-04' order by master_timestamp, dic_id")
def catalog_by_day(spark, sf_dir):
    return catalog.ordered(catalog.analyses_of(adapters.joined_catalog(spark, sf_dir), reference_date="1996-07-04")).select(*CATALOG_COLUMNS)


@query(f"with {CATALOG} select dic_id, camera_id, camera_name, master_image_id, master_timestamp from c where camera_id = 7 and camera_name = 'NATION_7' and cast(master_timestamp as date) = (select cast(min(master_timestamp) as date) from c where camera_id = 7)")
def catalog_by_camera(spark, sf_dir):
    own = catalog.analyses_of(adapters.joined_catalog(spark, sf_dir), camera_id=7, camera_name="NATION_7")
    first = catalog.first_analyses(own).select(F.date_format("master_timestamp", "yyyy-MM-dd")).first()
    return catalog.analyses_of(own, master_timestamp=first[0] if first else "1970-01-01").select(*CATALOG_COLUMNS)


@query(f"with {CATALOG} select camera_name, dic_id, master_timestamp from (select *, row_number() over (partition by camera_name order by master_timestamp, dic_id) as n from c) where n = 1")
def catalog_first_analysis(spark, sf_dir):
    return catalog.first_analyses(adapters.joined_catalog(spark, sf_dir), "camera_name").select("camera_name", "dic_id", "master_timestamp")


@query(f"with {CATALOG} select distinct cast(reference_date as date) as reference_date, camera_name from c where camera_name in ('NATION_3', 'NATION_7', 'NATION_11')")
def work_list(spark, sf_dir):
    return catalog.tasks(catalog.work_list(adapters.joined_catalog(spark, sf_dir), ["NATION_3", "NATION_7", "NATION_11"]))


@query(f"with {CATALOG}, w as (select distinct cast(reference_date as date) as day, camera_name from c) select camera_name, count(*) as n_dates, min(day) as first_day, max(day) as last_day from w group by camera_name")
def dates_by_camera(spark, sf_dir):
    by = catalog.dates_by_camera(catalog.work_list(adapters.joined_catalog(spark, sf_dir)))
    return by.select("camera_name", F.size("dates").cast("long").alias("n_dates"), F.array_min("dates").alias("first_day"), F.array_max("dates").alias("last_day"))


@query("select l_orderkey as analysis_id, cast(l_partkey as double) as seed_x_px, cast(l_suppkey as double) as seed_y_px, l_quantity as displacement_x_px, o_orderdate as master_timestamp from lineitem join orders on l_orderkey = o_orderkey where cast(o_orderdate as date) = date '1995-01-10'")
def date_scan(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("analysis_id"), F.col("l_partkey").cast("double").alias("seed_x_px"), F.col("l_suppkey").cast("double").alias("seed_y_px"), F.col("l_quantity").alias("displacement_x_px"))
    own = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("master_timestamp"))
    return catalog.date_scan(rows, own, "1995-01-10").drop("id")


@query(f"with {CATALOG} select camera_name, count(*) as n from c where camera_name in ('NATION_1', 'NATION_2') group by 1")
def camera_semi(spark, sf_dir):
    wanted = spark.createDataFrame([("NATION_1",), ("NATION_2",)], "camera_name string")
    return adapters.joined_catalog(spark, sf_dir).join(wanted, "camera_name", "left_semi").groupBy("camera_name").agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as tasks, count(*) filter (s = 'success') as success, count(*) filter (s = 'skipped') as skipped, count(*) filter (s = 'error') as error from (select case o_orderstatus when 'F' then 'success' when 'O' then 'skipped' else 'error' end as s from orders)")
def batch_status(spark, sf_dir):
    state = F.col("o_orderstatus")
    return summary.batch_summary(adapters.table(spark, sf_dir, "orders").select(F.when(state == "F", "success").when(state == "O", "skipped").otherwise("error").alias("status")))


@query(f"with {CATALOG} select dic_id, camera_id, camera_name, master_image_id, master_timestamp from c where dic_id = (select min(o_orderkey) + 6 from orders)")
def catalog_by_id(spark, sf_dir):
    own = adapters.joined_catalog(spark, sf_dir)
    wanted = adapters.table(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    return catalog.analyses_of(own, dic_id=wanted + 6).select(*CATALOG_COLUMNS)


@query(f"with {CATALOG} select dic_id, camera_id, camera_name, master_image_id, master_timestamp from c order by master_timestamp, dic_id limit 5")
def catalog_head(spark, sf_dir):
    return catalog.head(adapters.joined_catalog(spark, sf_dir), 5).select(*CATALOG_COLUMNS)


@query("select n_name as camera_name, lower(n_name) like '%tele%' or n_name like '%7' as unused, lower(n_name || case when n_nationkey % 2 = 0 then '_Tele' else '' end) like '%tele%' as rotate from nation")
def image_rotation(spark, sf_dir):
    cameras = adapters.cameras(spark, sf_dir)
    name = F.concat("camera_name", F.when(F.col("camera_id") % 2 == 0, "_Tele").otherwise(""))
    return cameras.select("camera_name", (images.needs_rotation(F.col("camera_name")) | F.col("camera_name").endswith("7")).alias("unused"), images.needs_rotation(name).alias("rotate"))


@query("select o_orderkey as dic_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as title, strftime(o_orderdate, '%Y%m%d_%H%M%S') as stamp, replace(replace(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), ':', '-'), ' ', '_') as text_stamp, n_name || '_' || strftime(o_orderdate, '%Y-%m-%d') || '_GMM' as run, n_name || '_' || strftime(o_orderdate, '%Y-%m-%d') || '_GMM_GMM_comp8_covfull_wcp0.5' as results, n_name || '_' || strftime(o_orderdate, '%Y-%m-%d') || '_GMM_model_comp8_covfull' as model from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def run_names(spark, sf_dir):
    ts = F.col("master_timestamp")
    run = naming.run_name(F.col("camera_name"), ts)
    return adapters.joined_catalog(spark, sf_dir).select("dic_id", naming.title_of(ts).alias("title"), naming.stamp_of(ts).alias("stamp"), naming.stamp_of_text(naming.title_of(ts)).alias("text_stamp"), run.alias("run"), naming.model_name(run, 8, "full", 0.5).alias("results"), naming.model_name(run, 8, "full").alias("model"))


# --- fields and filters -----------------------------------------------------------------------------------------------
@query(f"with {FIELD} select * from f")
def field_build(spark, sf_dir):
    return field(spark, sf_dir)


@query(f"with {FIELD}, {PERCENTILED} select * from p")
def percentile_filter(spark, sf_dir):
    return filters.percentile_filter(field(spark, sf_dir))


@query("select event_type as frame, event_id, value from events join (select event_type, quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.95) as hi from events group by 1) using (event_type) where value >= lo and value <= hi")
def percentile_filter_events(spark, sf_dir):
    events = adapters.table(spark, sf_dir, "events").select(F.col("event_type").alias("frame"), "event_id", "value")
    return filters.percentile_filter(events, 0.05, "value")


@query(f"with {FIELD} select * from f where speed >= 1.5")
def min_speed_filter(spark, sf_dir):
    return filters.min_speed_filter(filters.min_speed_filter(field(spark, sf_dir), -1.0), 1.5)


@query(f"with {FIELD}, {median_sql('f')} select * from kept")
def median_filter_2d(spark, sf_dir):
    return filters.median_filter(field(spark, sf_dir))


@query(f"with {FIELD}, {median_sql('f', 4, 2.0)} select * from kept")
def median_filter_even(spark, sf_dir):
    return filters.median_filter(field(spark, sf_dir), 4, 2.0, spacing=16.0)


@query(f"with {FIELD}, {PERCENTILED}, e as (select * from p where speed >= 1), {median_sql('e')} select * from kept")
def filter_pipeline(spark, sf_dir):
    return filters.filter_pipeline(field(spark, sf_dir))


@query(f"with {FIELD}, {PERCENTILED}, a as (select frame, count(*) as n_before from f group by 1), b as (select frame, count(*) as n_after from p where speed >= 1 group by 1) select frame, n_before, coalesce(n_after, 0) as n_after, {s6('coalesce(n_after, 0)::double / n_before', 'ratio')} from a left join b using (frame)")
def retention_ratio(spark, sf_dir):
    whole = field(spark, sf_dir)
    return filters.retention(whole, filters.filter_pipeline(whole, Filters(apply_2d_median=False))).select("frame", "n_before", "n_after", r6("ratio"))


@query(f"with {FIELD} select frame, x, y, u, v, speed from f")
def json_payload_roundtrip(spark, sf_dir):
    return fields.from_payloads(fields.to_payloads(field(spark, sf_dir)))


@query(f"with {FIELD}, {PERCENTILED} select frame, x, y, u, v, speed from p where speed >= 1")
def payload_filtered(spark, sf_dir):
    return fields.filtered(fields.to_payloads(field(spark, sf_dir)))


@query(f"with {FIELD} select frame, x, y, u, v, speed from f")
def long_names(spark, sf_dir):
    back = {v: k for k, v in fields.LONG_NAMES.items()}
    return fields.from_table(field(spark, sf_dir).drop("speed").withColumnsRenamed(back))


@query(f"with {FIELD} select frame, count(speed) as n, min(speed) as least, max(speed) as most, {s6('avg(speed)', 'mean')}, " + ", ".join(s6(f"quantile_cont(speed, {p / 100})", f"p{p:02d}") for p in (1, 5, 25, 50, 75, 95, 99)) + " from f group by frame")
def range_summary(spark, sf_dir):
    out = summary.range_summary(field(spark, sf_dir), "speed")
    return out.select("frame", "n", "least", "most", *[r6(c) for c in out.columns[4:]])


@query(f"with {FIELD} select frame, 0.0::double as vmin, max(speed) as vmax from f group by frame")
def color_range(spark, sf_dir):
    return summary.color_range(field(spark, sf_dir), vmax=0.0, zero_is_unset=True)


@query("select count(value) > 0 as any_value from events")
def has_values(spark, sf_dir):
    return summary.has_values(adapters.table(spark, sf_dir, "events"), "value")


# --- features ---------------------------------------------------------------------------------------------------------
@query(f"with {FIELD} select frame, x, y, {s6('atan2(v, u)', 'angle_rad')}, {s6(ANGLE, 'angle_deg')} from f")
def features_angles(spark, sf_dir):
    return features.features(field(spark, sf_dir)).select(*KEY, r6("angle_rad"), r6("angle_deg"))


@query(f"with {FIELD} select frame, x, y, {s6('u / (speed + 1e-10)', 'u_unit')}, {s6('v / (speed + 1e-10)', 'v_unit')}, speed * speed as speed_squared, {s6('ln(1 + speed)', 'log_magnitude')} from f")
def features_unit(spark, sf_dir):
    return features.features(field(spark, sf_dir)).select(*KEY, r6("u_unit"), r6("v_unit"), "speed_squared", r6("log_magnitude"))


@query(f"with {FIELD}, {QUARTILES.format(src='f')} select frame, x, y, {CATEGORY} as magnitude_category from f join q using (frame)")
def magnitude_category(spark, sf_dir):
    return features.magnitude_category(field(spark, sf_dir)).select(*KEY, "magnitude_category")


@query(f"with {FIELD} select frame, x, y, cast(row_number() over (partition by frame order by x, y) - 1 as integer) as spatial_index from f")
def spatial_index(spark, sf_dir):
    return features.spatial_index(field(spark, sf_dir)).select(*KEY, "spatial_index")


@query(f"with {FIELD} select frame, x, y, p[1] as p1, p[2] as p2, p[3] as p3 from (select frame, x, y, case when u < -1 then [0.8::double, 0.1, 0.1] when v > 1 then [0.1::double, 0.8, 0.1] when u > 1 and v < 1 then [0.1::double, 0.1, 0.8] else [1.0::double / 3, 1.0::double / 3, 1.0::double / 3] end as p from f)")
def spatial_prior(spark, sf_dir):
    moved = field(spark, sf_dir).select("frame", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("u").alias("x"), F.col("v").alias("y"))
    p = moved.withColumn("p", features.spatial_prior())
    return p.select("frame", F.col("x0").alias("x"), F.col("y0").alias("y"), *[F.col("p")[k].alias(f"p{k + 1}") for k in range(3)])


def scaled_sql(columns: dict[str, float]) -> str:
    stats = ", ".join(f"avg({c}) as {c}_m, case when stddev_pop({c}) = 0 then 1 else stddev_pop({c}) end as {c}_s" for c in columns)
    out = ", ".join(s6(f"({c} - {c}_m) / {c}_s * {w}", f"{c}_scaled") for c, w in columns.items())
    return f"with {FIELD}, a as (select *, {ANGLE} as angle_deg from f), st as (select frame, {stats} from a group by frame) select frame, x, y, {out} from a join st using (frame)"


def _angled(spark, sf_dir) -> DataFrame:
    return field(spark, sf_dir).withColumn("angle_rad", features.angle_rad()).withColumn("angle_deg", features.angle_deg())


def _scaled(df: DataFrame) -> DataFrame:
    return df.select(*KEY, *[r6(c) for c in df.columns if c.endswith("_scaled")])


@query(scaled_sql({"speed": 1.0, "angle_deg": 1.0}))
def standardize(spark, sf_dir):
    return _scaled(features.standardize(_angled(spark, sf_dir), ["speed", "angle_deg"]))


@query(scaled_sql({"x": 0.3, "y": 0.3, "u": 0.7, "v": 0.7, "speed": 0.7, "angle_deg": 0.7}))
def weighted_blocks(spark, sf_dir):
    return _scaled(features.weighted_blocks(_angled(spark, sf_dir)))


@query(scaled_sql({"x": 1.0, "speed": 2.0, "angle_deg": 1.0}))
def feature_weights(spark, sf_dir):
    return _scaled(features.standardize(_angled(spark, sf_dir), ["x", "speed", "angle_deg"], {"speed": 2.0}))


@query(f"with {FIELD}, s as (select frame, 'u' as \"column\", avg(u) as m, stddev_pop(u) as s from f group by 1 union all select frame, 'speed', avg(speed), stddev_pop(speed) from f group by 1) select frame, \"column\", {s6('m', 'mean')}, {s6('case when s = 0 then 1 else s end', 'scale')} from s")
def scaler_fit(spark, sf_dir):
    return features.scaler(field(spark, sf_dir), ["u", "speed"]).select("frame", "column", r6("mean"), r6("scale"))


# --- regions and rasters ----------------------------------------------------------------------------------------------
REGION = [(40.0, 60.0), (600.0, 96.0), (520.0, 700.0), (300.0, 380.0), (96.0, 640.0)]
SECTORS = [[(0.0, 0.0), (320.0, 0.0), (320.0, 320.0), (0.0, 320.0)], [(200.0, 150.0), (640.0, 200.0), (480.0, 800.0)], [(100.0, 100.0), (250.0, 400.0), (30.0, 500.0)]]


def inside_sql(points) -> str:
    crossings = []
    for k in range(len(points)):
        (x0, y0), (x1, y1) = points[k - 1], points[k]
        crossings.append(f"case when (({y0} >= y) <> ({y1} >= y)) and ((({y1} - y) * ({x0} - ({x1})) >= ({x1} - x) * ({y0} - ({y1}))) = ({y1} >= y)) then 1 else 0 end")
    return f"(({' + '.join(crossings)}) % 2 = 1)"


@query(f"with {FIELD} select * from f where {inside_sql(REGION)}")
def roi_polygon(spark, sf_dir):
    return roi.clip(field(spark, sf_dir), REGION)


@query(f"with {FIELD} select frame, count(*) as all_inside, 0::bigint as none_inside from f group by frame")
def roi_none(spark, sf_dir):
    return field(spark, sf_dir).groupBy("frame").agg(F.count_if(roi.inside_or_all(None)).alias("all_inside"), F.count_if(roi.contains(None)).alias("none_inside"))


SECTOR_SQL = f"with {FIELD} select frame, x, y, case " + " ".join(f"when {inside_sql(SECTORS[k])} then {k}" for k in (2, 1, 0)) + " else -1 end as prior_class from f"


@query(SECTOR_SQL)
def prior_class(spark, sf_dir):
    return roi.prior_class(field(spark, sf_dir), SECTORS).select(*KEY, "prior_class")


@query(SECTOR_SQL)
def sector_join(spark, sf_dir):
    table = spark.createDataFrame([(k, [list(p) for p in s]) for k, s in enumerate(SECTORS)], "idx int, points array<array<double>>")
    return roi.sector_join(field(spark, sf_dir), table).select(*KEY, "prior_class")


@query("select * from (values (0, '{\"polygon_points\":[[40.0,60.0],[600.0,96.0],[520.0,700.0]]}')) as t(idx, body)")
def polygon_json(spark, sf_dir):
    return polygons.to_json(spark.createDataFrame([(0, [list(p) for p in REGION[:3]])], "idx int, points array<array<double>>"))


@query(f"with {FIELD}, b as (select frame, min(x) as x0, min(y) as y0, cast(ceil((max(x) - min(x)) / 48 + 1) as bigint) as nx, cast(ceil((max(y) - min(y)) / 48 + 1) as bigint) as ny from f group by frame) select frame, x, y, cast(greatest(0, least(ceil((y - y0) / 48 - 0.5), ny - 1)) as bigint) as i, cast(greatest(0, least(ceil((x - x0) / 48 - 0.5), nx - 1)) as bigint) as j from f join b using (frame)")
def snap_to_grid(spark, sf_dir):
    return raster.snapped(field(spark, sf_dir), 48.0).select(*KEY, "i", "j")


@query(f"with {FIELD}, b as (select frame, min(x) as x0, min(y) as y0, cast(ceil((max(x) - min(x)) / 48 + 1) as bigint) as nx, cast(ceil((max(y) - min(y)) / 48 + 1) as bigint) as ny from f group by frame), g as (select f.*, cast(greatest(0, least(ceil((y - y0) / 48 - 0.5), ny - 1)) as bigint) as i, cast(greatest(0, least(ceil((x - x0) / 48 - 0.5), nx - 1)) as bigint) as j from f join b using (frame)) select frame, i, j, u, v, speed from (select *, row_number() over (partition by frame, i, j order by x desc, y desc) as n from g) where n = 1")
def rasterize(spark, sf_dir):
    return raster.rasterize(field(spark, sf_dir), 48.0)


@query(f"with {FIELD}, d as (select a.frame, a.x, a.y, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) as distance from f a join f b on a.frame = b.frame and abs(a.x - b.x) <= 160 and abs(a.y - b.y) <= 160 and (a.x <> b.x or a.y <> b.y) group by 1, 2, 3) select frame, quantile_cont(distance, 0.5) as spacing from d group by frame")
def nn_spacing(spark, sf_dir):
    return raster.spacing_of(field(spark, sf_dir))


# --- labels -----------------------------------------------------------------------------------------------------------
OCTANTS = f"l as (select frame, x, y, u, v, speed, atan2(v, u) as angle_rad, {ANGLE} as angle_deg, {OCTANT} as cluster from f)"


def _octants(spark, sf_dir) -> DataFrame:
    return _angled(spark, sf_dir).withColumn("cluster", F.floor(F.col("angle_deg") / 45).cast("int"))


@query(f"with {FIELD}, {OCTANTS} select frame, x, y, case when count(*) over (partition by frame, cluster) < 220 then -1 else cluster end as cluster from l")
def small_clusters(spark, sf_dir):
    return postprocess.remove_small_clusters(_octants(spark, sf_dir), 220).select(*KEY, "cluster")


@query(
    f"""with {FIELD}, {OCTANTS}, c as (select frame, cast(x / 16 as bigint) as j, cast(y / 16 as bigint) as i, x, y, case when cluster = 3 then -1 else cluster end as cluster from l),
    n as (select t.frame, t.i, t.j, s.cluster, count(*) as n from c t join c s on s.frame = t.frame and s.i between t.i - 1 and t.i + 1 and s.j between t.j - 1 and t.j + 1 where s.cluster <> -1 group by 1, 2, 3, 4),
    b as (select frame, i, j, cluster from (select *, row_number() over (partition by frame, i, j order by n desc, cluster) as k from n) where k = 1)
    select c.frame, c.x, c.y, coalesce(b.cluster, -1) as cluster from c left join b on b.frame = c.frame and b.i = c.i and b.j = c.j"""
)
def smooth_labels(spark, sf_dir):
    labelled = _octants(spark, sf_dir).withColumn("cluster", F.when(F.col("cluster") == 3, -1).otherwise(F.col("cluster")))
    return postprocess.smooth_labels(labelled, 3, unit=16.0).select(*KEY, "cluster")


CENTROIDS = "m as (select frame, cluster, avg(x) as x, avg(y) as y, avg(speed) as speed, avg(angle_rad) as angle_rad from l where cluster <> -1 group by 1, 2)"
PAIRS = "d as (select a.frame, a.cluster as a, b.cluster as b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.speed - b.speed) * (a.speed - b.speed) + (a.angle_rad - b.angle_rad) * (a.angle_rad - b.angle_rad)) as distance from m a join m b on a.frame = b.frame and a.cluster < b.cluster)"


@query(f"with {FIELD}, {OCTANTS}, {CENTROIDS}, {PAIRS} select frame, a, b, {s6('distance')} from d")
def centroid_distances(spark, sf_dir):
    return postprocess.centroid_distances(_octants(spark, sf_dir)).select("frame", "a", "b", r6("distance"))


@query(f"with {FIELD}, {OCTANTS}, {CENTROIDS}, {PAIRS}, t as (select frame, b, min(a) as a from d where distance < 25 group by 1, 2) select l.frame, x, y, coalesce(t.a, cluster) as cluster from l left join t on t.frame = l.frame and t.b = l.cluster")
def merge_clusters(spark, sf_dir):
    return postprocess.merge_clusters(_octants(spark, sf_dir), 25.0).select(*KEY, "cluster")


@query(f"with {FIELD}, {OCTANTS} select frame, case when cluster = 0 then 'Noise' else 'Cluster ' || cluster end as cluster_name, count(*) as \"count\", {s6('avg(speed)', 'mean_magnitude')}, {s6('avg(angle_deg)', 'mean_direction')}, {s6('stddev_samp(speed)', 'std_magnitude')} from l group by frame, cluster")
def cluster_stats(spark, sf_dir):
    labelled = _octants(spark, sf_dir).withColumn("cluster", F.when(F.col("cluster") == 0, -1).otherwise(F.col("cluster")))
    return summary.cluster_stats(labelled).select("frame", "cluster_name", "count", *[r6(c) for c in ("mean_magnitude", "mean_direction", "std_magnitude")])


@query(f"with {FIELD}, {OCTANTS} select frame, count(distinct cluster) as with_noise, count(distinct cluster) filter (cluster <> 0) as without_noise from l group by frame")
def cluster_count(spark, sf_dir):
    labelled = _octants(spark, sf_dir).withColumn("cluster", F.when(F.col("cluster") == 0, -1).otherwise(F.col("cluster")))
    a = summary.cluster_count(labelled).withColumnRenamed("n_clusters", "with_noise")
    return a.join(summary.cluster_count(labelled, with_noise=False).withColumnRenamed("n_clusters", "without_noise"), "frame")


@query(f"with {FIELD}, {OCTANTS} select frame, cluster, count(*) as \"count\" from l group by 1, 2")
def label_histogram(spark, sf_dir):
    return summary.label_histogram(_octants(spark, sf_dir))


@query(f"with {FIELD}, {OCTANTS}, s as (select frame, cluster, row_number() over (partition by frame order by avg(speed), avg(angle_deg)) - 1 as n from l where cluster <> -1 group by 1, 2) select l.frame, x, y, cast(n as integer) as cluster from l join s using (frame, cluster)")
def relabel(spark, sf_dir):
    return postprocess.relabel(_octants(spark, sf_dir)).select(*KEY, "cluster")


# --- mixtures ---------------------------------------------------------------------------------------------------------
#: A fixed mixture of two components over (u, v).
FIXED = mixture.em_mixture([0.625, 0.375], [[0.0, 0.5], [3.0, -1.0]], [[[16.0, 2.0], [2.0, 8.0]], [[4.0, 0.0], [0.0, 32.0]]])
UV = ["u", "v"]


def _quadratic(k: int) -> str:
    p, (a, b) = FIXED.precisions[k], FIXED.means[k]
    return f"((u - ({a!r})) * (u - ({a!r})) * {float(p[0][0])!r} + 2 * (u - ({a!r})) * (v - ({b!r})) * ({float(p[0][1])!r}) + (v - ({b!r})) * (v - ({b!r})) * {float(p[1][1])!r})".replace("np.float64", "")


TERMS = ", ".join(f"({float(FIXED.constants[k])!r}) - 0.5 * {_quadratic(k)} as t{k}" for k in (0, 1))
LSE = "greatest(t0, t1) + ln(exp(t0 - greatest(t0, t1)) + exp(t1 - greatest(t0, t1)))"
ESTEP = f"t as (select *, {TERMS} from f), e as (select *, {LSE} as ll, exp(t0 - ({LSE})) as r0, exp(t1 - ({LSE})) as r1 from t)"


@query(f"with {FIELD}, {ESTEP} select frame, x, y, {s6('r0')}, {s6('r1')}, {s6('ll', 'log_likelihood')} from e")
def gmm_one_estep(spark, sf_dir):
    r = mixture.responsibilities(FIXED, UV)
    scored = mixture.score_samples(field(spark, sf_dir), FIXED, UV)
    return scored.select(*KEY, r6(r[0], "r0"), r6(r[1], "r1"), r6("log_likelihood"))


@query(f"with {FIELD}, {ESTEP} select " + ", ".join(f"{s6(f'sum(r{k})', f'r{k}')}, " + ", ".join(s6(f"sum(r{k} * {a}) / sum(r{k})", f"mean{k}_{a}") for a in UV) + f", {s6(f'sum(r{k} * u * v) / sum(r{k}) - (sum(r{k} * u) / sum(r{k})) * (sum(r{k} * v) / sum(r{k}))', f'cov{k}_uv')}" for k in (0, 1)) + " from e")
def gmm_one_mstep(spark, sf_dir):
    s = mixture.sufficient_statistics(field(spark, sf_dir), FIXED, UV)
    out = []
    for k in (0, 1):
        mean = [F.col(f"s{k}_{i}") / F.col(f"r{k}") for i in (0, 1)]
        out += [r6(f"r{k}"), *[r6(m, f"mean{k}_{a}") for m, a in zip(mean, UV, strict=True)], r6(F.col(f"q{k}_0_1") / F.col(f"r{k}") - mean[0] * mean[1], f"cov{k}_uv")]
    return s.select(*out)


@query(
    f"""with {FIELD}, b as (select floor(quantile_cont(u, 0.01)) as u0, ceil(quantile_cont(u, 0.99)) as u1, floor(quantile_cont(v, 0.01)) as v0, ceil(quantile_cont(v, 0.99)) as v1 from f),
    g as (select cast(i as integer) as i, cast(j as integer) as j, u0 + j * ((u1 - u0) / 19) as u, v0 + i * ((v1 - v0) / 19) as v from b, range(20) as ri(i), range(20) as rj(j)), t as (select *, {TERMS} from g)
    select i, j, {s6('u')}, {s6('v')}, {s6(f'-({LSE})', 'nll')} from t"""
)
def gmm_nll_grid(spark, sf_dir):
    return mixture.likelihood_grid(field(spark, sf_dir), FIXED, UV, ("u", "v"), 20).select("i", "j", r6("u"), r6("v"), r6("nll"))


@query(
    f"""with {FIELD}, b as (select floor(quantile_cont(u, 0.01)) as u0, ceil(quantile_cont(u, 0.99)) as u1, floor(quantile_cont(v, 0.01)) as v0, ceil(quantile_cont(v, 0.99)) as v1 from f),
    g as (select cast(i as integer) as i, cast(j as integer) as j, u0 + j * ((u1 - u0) / 79) as u, v0 + i * ((v1 - v0) / 79) as v from b, range(80) as ri(i), range(80) as rj(j)), t as (select *, {TERMS} from g)
    select i, j, {s6('u')}, {s6('v')}, {s6(f'-({LSE})', 'nll')} from t"""
)
def gmm_nll_grid_80(spark, sf_dir):
    """The reference's 80 x 80 grid; gmm_nll_grid has the 20 x 20 of its SQL."""
    return mixture.likelihood_grid(field(spark, sf_dir), FIXED, UV, ("u", "v")).select("i", "j", r6("u"), r6("v"), r6("nll"))


HARD = ([0.5, 0.25, 0.25], [[0.0, 0.0], [4.0, 1.0], [-3.0, 2.0]], [[2.0, 2.0], [4.0, 1.0], [1.0, 3.0]])


@query(f"with {FIELD}, t as (select frame, x, y, [" + ", ".join(f"ln({w}) - ln({s[0]}) - ln({s[1]}) - 0.5 * (((u - ({m[0]})) / {s[0]}) * ((u - ({m[0]})) / {s[0]}) + ((v - ({m[1]})) / {s[1]}) * ((v - ({m[1]})) / {s[1]}))" for w, m, s in zip(*HARD, strict=True)) + "] as t from f) select frame, x, y, cast(list_position(t, list_max(t)) - 1 as integer) as cluster from t")
def hard_assign(spark, sf_dir):
    return mixture.hard_assign(field(spark, sf_dir), *HARD, UV).select(*KEY, "cluster")


def _fitted(spark, sf_dir, gamma):
    """One mixture of the whole field, all frames pooled, each scaled by itself; clusters are numbered in each frame."""
    scaled = features.standardize(_angled(spark, sf_dir), ["speed", "angle_deg"])
    columns = ["speed_scaled", "angle_deg_scaled"]
    own = Clustering()
    made = mixture.fit(scaled, columns, own.n_components, own.max_iter, gamma)
    return postprocess.relabel(mixture.predict(scaled, made, columns))


@query()
def gmm_fit(spark, sf_dir):
    return summary.cluster_stats(_fitted(spark, sf_dir, None))


@query()
def vbgmm_fit(spark, sf_dir):
    return summary.cluster_stats(_fitted(spark, sf_dir, 0.5))


@query()
def vbgmm_frames(spark, sf_dir):
    scaled = features.standardize(_angled(spark, sf_dir), ["speed", "angle_deg"])
    return summary.cluster_stats(mixture.fit_predict_frames(scaled, ["speed_scaled", "angle_deg_scaled"], 8, 100, 0.5))


@query()
def prior_mixture(spark, sf_dir):
    data = synthetic.mixture_2d(spark)
    made = mixture.fit_with_priors(data, ["x", "y"], features.spatial_prior(), 3)
    return summary.adjusted_rand(mixture.predict(data, made, ["x", "y"]), "true_cluster", "cluster")


@query(
    f"""with {FIELD}, m as (select avg(u) as mu, avg(v) as mv, var_pop(u) as a, var_pop(v) as b, covar_pop(u, v) as c from f), h as (select mu, mv, 0.5 * atan2(2 * c, a - b) as h from m),
    w as (select mu, mv, case when abs(cos(h)) >= abs(sin(h)) then sign(cos(h)) else sign(sin(h)) end as s1, case when abs(sin(h)) > abs(cos(h)) then -sign(sin(h)) else sign(cos(h)) end as s2, cos(h) as ch, sin(h) as sh from h)
    select frame, x, y, {s6('s1 * ((u - mu) * ch + (v - mv) * sh)', 'PC1')}, {s6('s2 * ((v - mv) * ch - (u - mu) * sh)', 'PC2')} from f, w"""
)
def pca_2d(spark, sf_dir):
    return pca.pca(field(spark, sf_dir), UV).select(*KEY, r6("PC1"), r6("PC2"))


@query(f"with {FIELD} select frame, x, y, degree, degree >= 9 as core from (select a.frame, a.x, a.y, count(*) as degree from (select * from f where speed >= 8) a join (select * from f where speed >= 8) b on a.frame = b.frame and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.speed - b.speed) * (a.speed - b.speed) <= 2304.0 group by 1, 2, 3)")
def dbscan_core_flags(spark, sf_dir):
    return dbscan.core_flags(_fast(spark, sf_dir), ["x", "y", "speed"], 48.0, 9).join(_fast(spark, sf_dir).select("id", "x", "y"), "id").select(*KEY, "degree", "core")


def _cells(spark, sf_dir) -> DataFrame:
    cell = (F.col("frame") * 1_000_000_000 + F.col("x") * 100_000 + F.col("y")).cast("long")
    return field(spark, sf_dir).withColumn("id", cell)


def _fast(spark, sf_dir) -> DataFrame:
    return _cells(spark, sf_dir).where("speed >= 8")


@query(
    f"""with recursive {FIELD}, p as (select frame, x, y, speed, cast(frame * 1000000000 + x * 100000 + y as bigint) as id from f where speed >= 8),
    n as (select a.id as a, b.id as b from p a join p b on a.frame = b.frame and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.speed - b.speed) * (a.speed - b.speed) <= 2304.0),
    core as (select a as id from n group by a having count(*) >= 9), e as (select a, b from n where a in (select id from core) and b in (select id from core)),
    reach(a, b) as (select id, id from core union select reach.a, e.b from reach join e on reach.b = e.a), r as (select a as id, min(b) as root from reach group by a),
    l as (select * from r union all select n.a, min(r.root) from n join r on n.b = r.id where n.a not in (select id from core) group by n.a),
    k as (select root, row_number() over (partition by frame order by root) - 1 as k from (select distinct root from r) join p on p.id = root)
    select frame, x, y, cast(coalesce(k, -1) as integer) as cluster from p left join l using (id) left join k using (root)"""
)
def dbscan_labels(spark, sf_dir):
    return dbscan.dbscan(_fast(spark, sf_dir), ["x", "y", "speed"], 48.0, 9).select(*KEY, "cluster")


@query(f"with {FIELD} select frame, x, y, degree, degree >= 9 as core from (select a.frame, a.x, a.y, count(*) as degree from f a join f b on a.frame = b.frame and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.speed - b.speed) * (a.speed - b.speed) <= 2304.0 group by 1, 2, 3)")
def dbscan_field_core_flags(spark, sf_dir):
    """The flags of every cell; dbscan_core_flags has those of its SQL's cells, of speed 8 and more."""
    cells = _cells(spark, sf_dir)
    return dbscan.core_flags(cells, ["x", "y", "speed"], 48.0, 9).join(cells.select("id", "x", "y"), "id").select(*KEY, "degree", "core")


@query()
def dbscan_field_labels(spark, sf_dir):
    """The labels of every cell. Recursive SQL is too slow for whole tables; the tests compare with a plain version."""
    return dbscan.dbscan(_cells(spark, sf_dir), ["x", "y", "speed"], 48.0, 9).select(*KEY, "cluster")


# --- evaluation -------------------------------------------------------------------------------------------------------
@query("with t as (select l_returnflag as a, l_linestatus as b, count(*)::double as n from lineitem group by 1, 2), s as (select sum(n * (n - 1) / 2) as c, sum(n) as n from t), r as (select sum(n * (n - 1) / 2) as r from (select sum(n) as n from t group by a)), k as (select sum(n * (n - 1) / 2) as k from (select sum(n) as n from t group by b)) select round((c - r * k / (n * (n - 1) / 2)) / ((r + k) / 2 - r * k / (n * (n - 1) / 2)), 6) + 0.0 as adjusted_rand from s, r, k")
def adjusted_rand(spark, sf_dir):
    return summary.adjusted_rand(adapters.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").select(r6("adjusted_rand"))


SAMPLES = "s as (select user_id % 50 as obs, cast(event_id % 4 as integer) as chain, cast((event_id * 7 + user_id) % 3 as integer) as z from events)"


def _samples(spark, sf_dir) -> DataFrame:
    e = adapters.table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 50).alias("obs"), (F.col("event_id") % 4).cast("int").alias("chain"), ((F.col("event_id") * 7 + F.col("user_id")) % 3).cast("int").alias("z"))


@query(f"with {SAMPLES}, c as (select obs, z, count(*) as n from s group by 1, 2) select obs, z from (select *, row_number() over (partition by obs order by n desc, z) as k from c) where k = 1")
def posterior_mode(spark, sf_dir):
    return summary.posterior_mode(_samples(spark, sf_dir))


SHARES = "p as (select obs, avg((z = 0)::double) as p0, avg((z = 1)::double) as p1, avg((z = 2)::double) as p2 from s group by obs)"


@query(f"with {SAMPLES}, {SHARES} select obs, {s6('p0')}, {s6('p1')}, {s6('p2')}, {s6('greatest(p0, p1, p2)', 'most')} from p")
def assignment_probability(spark, sf_dir):
    p = summary.assignment_probability(_samples(spark, sf_dir), 3)
    return p.select("obs", *[r6(F.col("probability")[k], f"p{k}") for k in range(3)], r6(F.array_max("probability"), "most"))


@query(f"with {SAMPLES}, {SHARES} select obs, {s6('-(p0 * ln(p0 + 1e-10) + p1 * ln(p1 + 1e-10) + p2 * ln(p2 + 1e-10))', 'entropy')} from p")
def posterior_entropy(spark, sf_dir):
    p = summary.assignment_probability(_samples(spark, sf_dir), 3)
    return p.select("obs", r6(summary.entropy(F.col("probability")), "entropy"))


@query(f"select cast(user_id % 3 as integer) as k, event_type as feature, {s6('avg(value)', 'mean')} from events group by 1, 2")
def posterior_means(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events")
    draws = e.select((F.col("user_id") % 3).cast("int").alias("k"), F.col("event_type").alias("feature"), "value")
    return summary.posterior_means(draws).select("k", "feature", r6("mean"))


@query(f"with {FIELD}, q as (select frame, quantile_cont(speed, 0.05) as a, quantile_cont(speed, 0.95) as b from f group by frame) select frame, cast(k as integer) as k, {s6('a + k * ((b - a) / 9)', 'level')} from q, range(10) as r(k)")
def contour_levels(spark, sf_dir):
    levels = summary.contour_levels(field(spark, sf_dir), "speed")
    return levels.select("frame", F.posexplode("levels").alias("k", "level")).select("frame", "k", r6("level"))


# --- the batch --------------------------------------------------------------------------------------------------------
BATCH_CAMERAS = ["NATION_3", "NATION_7", "NATION_11"]


def _batch(spark, sf_dir, settings: Settings, fit: bool):
    """Tasks are (camera, year): a year's field is the frame of its first analysis."""
    year = F.date_trunc("year", "reference_date").cast("timestamp_ntz")
    yearly = adapters.joined_catalog(spark, sf_dir).withColumn("reference_date", year).withColumn("dic_id", F.year("reference_date").cast("long"))
    work = catalog.work_list(yearly, BATCH_CAMERAS).unionByName(spark.sql("select date '1970-01-01' as reference_date, 'NATION_3' as camera_name"))
    tasks = batch.plan_tasks(yearly, work, adapters.images(spark, sf_dir))
    return batch.run(tasks, field(spark, sf_dir), settings, REGION, fit)


@query(
    f"""with {FIELD}, {PERCENTILED}, e as (select * from p where speed >= 1), {median_sql('e')}, w as (select * from kept where {inside_sql(REGION)}), {QUARTILES.format(src='w')},
    l as (select frame, {ORDINAL} as cluster from w join q using (frame)), {CATALOG},
    t as (select distinct camera_name, cast(date_trunc('year', reference_date) as date) as target_date, cast(year(reference_date) as bigint) as frame from c where camera_name in ('NATION_3', 'NATION_7', 'NATION_11')),
    n as (select frame, count(*) as n_kept from kept group by 1), a as (select frame, count(*) as n_points, count(distinct cluster) as n_clusters from l group by 1)
    select camera_name, target_date, case when n_points > 0 then 'success' else 'error' end as status, n_points, n_kept - n_points as n_filtered_points, n_clusters from t left join n using (frame) left join a using (frame)
    union all select 'NATION_3', date '1970-01-01', 'skipped', null, null, null"""
)
def batch_pipeline(spark, sf_dir):
    _, results = _batch(spark, sf_dir, Settings(), fit=False)
    return results.select("camera_name", "target_date", "status", "n_points", "n_filtered_points", "n_clusters")


@query()
def batch_fit(spark, sf_dir):
    labelled, _ = _batch(spark, sf_dir, Settings(), fit=True)
    return summary.cluster_stats(labelled)
