"""Parsing, geometry, clock and label expressions over whole tables."""

from pyspark.sql import functions as F

from fleetlag.catalog import fleetday as D
from fleetlag.catalog.registry import query
from fleetlag.functions import scalars as X

ZONE = "Europe/Moscow"


@query(
    "X1",
    """SELECT row_id,
       CASE WHEN try_cast(trim(unit_id) AS DECIMAL(38,18)) = floor(try_cast(trim(unit_id) AS DECIMAL(38,18)))
            THEN CAST(try_cast(trim(unit_id) AS DECIMAL(38,18)) AS BIGINT) END AS unit,
       try_cast(trim(tr_id) AS BIGINT) AS vehicle,
       CASE WHEN row_id % 3 = 0 THEN 9007199254740993 + row_id END AS big
       FROM f_telemetry_raw""",
)
def integral_id(spark, sf):
    big = F.when(
        F.col("row_id") % 3 == 0, F.concat((F.lit(9007199254740993) + F.col("row_id")).cast("string"), F.lit(".0"))
    ).when(F.col("row_id") % 3 == 1, F.concat(F.col("row_id").cast("string"), F.lit(".5")))
    return D.telemetry_raw(spark, sf).withColumn("b", big).select(
        "row_id",
        X.integral_id("unit_id").alias("unit"),
        X.integral_id("tr_id").alias("vehicle"),
        X.integral_id("b").alias("big"),
    )


@query(
    "X2",
    """SELECT row_id, epoch_us(try_cast(event_time AS TIMESTAMP)) - 10800000000 AS us FROM f_telemetry_raw""",
)
def iso_time(spark, sf):
    return D.telemetry_raw(spark, sf).select(
        "row_id", F.unix_micros(X.iso_time("event_time", ZONE)).alias("us")
    )


@query(
    "X3",
    """SELECT tt_action_item_id AS id, geom,
       epoch_us(try_cast(left(time_begin, 26) AS TIMESTAMP)) - 10800000000 AS us FROM f_plan_raw""",
)
def plan_time(spark, sf):
    return D.plan_raw(spark, sf).select(
        F.col("tt_action_item_id").alias("id"),
        "geom",
        F.unix_micros(X.plan_time("time_begin", ZONE)).alias("us"),
    )


@query(
    "X4",
    """SELECT row_id, s AS local, CASE WHEN s < '2025-10-26 02' THEN epoch(CAST(s AS TIMESTAMP)) - 7200 WHEN s >= '2025-10-26 03' THEN epoch(CAST(s AS TIMESTAMP)) - 3600 END AS utc
       FROM (SELECT row_id, strftime(make_timestamp((1761436800 + row_id % 14400) * 1000000), '%Y-%m-%d %H:%M:%S') AS s FROM f_telemetry_raw)""",
)
def unambiguous_time(spark, sf):
    night = F.expr("timestamp_seconds(1761436800 + row_id % 14400)")
    rows = D.telemetry_raw(spark, sf).select(
        "row_id", F.date_format(night, "yyyy-MM-dd HH:mm:ss").alias("local")
    )
    return rows.select("row_id", "local", X.epoch_s(X.unambiguous_time("local", "Europe/Berlin")).alias("utc"))


@query("X5", "SELECT event_id, epoch_us(ts) / CAST(1e6 AS DOUBLE) AS t FROM events")
def epoch_seconds(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", X.epoch_s("ts").alias("t"))


@query(
    "X6",
    """SELECT tt_action_item_id AS id, time_begin,
       try_cast(regexp_extract(geom, '^POINT \\(([0-9.]+) ([0-9.]+)\\)$', 1) AS DOUBLE) AS lon,
       try_cast(regexp_extract(geom, '^POINT \\(([0-9.]+) ([0-9.]+)\\)$', 2) AS DOUBLE) AS lat
       FROM f_plan_raw""",
)
def wkt_point(spark, sf):
    lon, lat = X.wkt_point("geom", "plain")
    return D.plan_raw(spark, sf).select(
        F.col("tt_action_item_id").alias("id"), "time_begin", lon.alias("lon"), lat.alias("lat")
    )


_HAV = """asin(sqrt(least(1.0, pow(sin((radians(lat) - radians(55.75)) / 2), 2)
       + cos(radians(55.75)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(37.62)) / 2), 2))))"""


@query(
    "X7",
    f"""SELECT row_id, round(2 * 6371000.0 * {_HAV}, 3) AS metres,
       round(2 * 6371008.8 * {_HAV}, 3) AS matcher_metres FROM f_telemetry""",
)
def haversine(spark, sf):
    from fleetlag.settings import MATCHER_EARTH_RADIUS_M

    here = ("lat", "lon", F.lit(55.75), F.lit(37.62))
    return D.telemetry(spark, sf).select(
        "row_id",
        F.round(X.haversine_m(*here), 3).alias("metres"),
        F.round(X.haversine_m(*here, radius=MATCHER_EARTH_RADIUS_M), 3).alias("matcher_metres"),
    )


_ODD = "CASE k % 6 WHEN 0 THEN 'nan' WHEN 1 THEN 'inf' WHEN 2 THEN '' WHEN 3 THEN 'abc' ELSE ' ' || k || '.5 ' END"


@query(
    "X8",
    f"""SELECT event_id, CASE WHEN isfinite(v) THEN v END AS v FROM (
       SELECT event_id, try_cast(trim({_ODD}) AS DOUBLE) AS v FROM f_events)""",
)
def finite_number(spark, sf):
    return D.events(spark, sf).select("event_id", F.expr(_ODD).alias("x")).select(
        "event_id", X.finite("x").alias("v")
    )


_SPELL = "CASE k % 6 WHEN 0 THEN 'True' WHEN 1 THEN ' yes ' WHEN 2 THEN '1' WHEN 3 THEN 'False' WHEN 4 THEN '0' END"


@query(
    "X9",
    f"""SELECT event_id, coalesce(lower(trim({_SPELL})) IN ('true','1','yes'), false) AS live,
       coalesce(lower({_SPELL}) = 'true', false) AS offline FROM f_events""",
)
def boolean_text(spark, sf):
    return D.events(spark, sf).select("event_id", F.expr(_SPELL).alias("x")).select(
        "event_id",
        F.coalesce(X.flag("x"), F.lit(False)).alias("live"),
        X.flag_offline("x").alias("offline"),
    )


@query("X10", "SELECT row_id, round(((t + 10800) % 86400) / 3600, 6) AS hour FROM f_telemetry")
def local_hour(spark, sf):
    return D.telemetry(spark, sf).select("row_id", F.round(X.local_hour("t"), 6).alias("hour"))


@query("X11", "SELECT tr_id || '_' || CAST(t AS BIGINT) AS sample_id, count(*) AS n FROM f_telemetry GROUP BY 1")
def sample_ids(spark, sf):
    t = D.telemetry(spark, sf)
    return t.groupBy(X.sample_id("tr_id", "t").alias("sample_id")).agg(F.count(F.lit(1)).alias("n"))


@query("X12", "SELECT stop_id, lon_e5 * 100000000 + lat_e5 AS key FROM f_plan")
def stop_keys(spark, sf):
    return D.plan(spark, sf).select("stop_id", X.stop_key("lat", "lon").alias("key"))


@query(
    "X13",
    """SELECT event_id, round(ln(q / (1 - q)), 6) AS log_odds, round(1 / (1 + exp(-value / 100)), 6) AS p
       FROM (SELECT event_id, value, least(greatest((k - 5) / 100.0::DOUBLE, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS q FROM f_events)""",
)
def log_odds(spark, sf):
    e = D.events(spark, sf)
    return e.select(
        "event_id",
        F.round(X.logit((F.col("k") - 5) / F.lit(100.0)), 6).alias("log_odds"),
        F.round(X.sigmoid(F.col("value") / 100), 6).alias("p"),
    )


_REASONS = "CASE k % 4 WHEN 0 THEN ['layover'] WHEN 1 THEN ['layover','slow_traffic','slow_traffic'] WHEN 2 THEN [] ELSE ['signal','carried_delay','timetable'] END"
_REASONS_SPARK = (
    _REASONS.replace("[]", "cast(array() as array<string>)").replace("['", "array('").replace("']", "')")
)


@query(
    "X14",
    """SELECT event_id, CASE k % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'slow_approach' WHEN 2 THEN 'unknown'
       ELSE 'stale_telemetry|accumulated_delay' END AS codes FROM f_events""",
)
def reason_codes(spark, sf):
    e = D.events(spark, sf).withColumn("r", F.expr(_REASONS_SPARK))
    return e.select("event_id", F.array_join(X.reason_codes("r"), "|").alias("codes"))


@query(
    "X15",
    """SELECT event_id, array_to_string(CASE WHEN k % 7 > 0 AND k * 3 <= 120 THEN r ELSE list_append(r, 'signal') END, '|') AS reasons,
       array_to_string(CASE WHEN k % 5 = 0 AND NOT list_contains(c, 'stale_telemetry') THEN list_append(c, 'stale_telemetry') ELSE c END, '|') AS codes
       FROM (SELECT event_id, k, CASE WHEN k % 2 = 0 THEN ['layover'] ELSE ['carried_delay'] END AS r,
             CASE WHEN k % 3 = 0 THEN ['stale_telemetry'] ELSE ['unknown'] END AS c FROM f_events)""",
)
def stale_reason(spark, sf):
    e = D.events(spark, sf).select(
        "event_id",
        F.expr("CASE WHEN k % 7 > 0 THEN cast(k * 3 as double) END").alias("age"),
        F.expr("k % 5 = 0").alias("stale"),
        F.expr("CASE WHEN k % 2 = 0 THEN array('layover') ELSE array('carried_delay') END").alias("r"),
        F.expr("CASE WHEN k % 3 = 0 THEN array('stale_telemetry') ELSE array('unknown') END").alias("c"),
    )
    return e.select(
        "event_id",
        F.array_join(X.with_stale_signal("r", "age"), "|").alias("reasons"),
        F.array_join(X.with_stale_code("c", "stale"), "|").alias("codes"),
    )


@query(
    "X16",
    """SELECT sample_id, CASE WHEN prediction_s > 0 THEN '+' WHEN prediction_s < 0 THEN '-' ELSE '' END
       || regexp_replace(printf('%.1f', floor(abs(prediction_s) / 6 + 0.5) / 10), '\\.0$', '') || ' min' AS text FROM f_predictions""",
)
def delay_text(spark, sf):
    return D.predictions(spark, sf).select("sample_id", X.delay_text("prediction_s").alias("text"))


@query(
    "X17",
    "SELECT event_id, us // 1000 AS ms FROM f_events",
)
def stream_entry_time(spark, sf):
    e = D.events(spark, sf).withColumn("entry", F.concat_ws("-", F.expr("us div 1000"), F.expr("event_id % 3")))
    return e.select("event_id", X.entry_ms("entry").alias("ms"))


@query(
    "P9",
    "SELECT sample_id, risk_level FROM f_predictions",
)
def risk_levels(spark, sf):
    return D.predictions(spark, sf).select("sample_id", "risk_level")


@query(
    "P13",
    """SELECT sample_id, CASE WHEN target < -60 THEN 'early' WHEN target > 120 THEN 'late' ELSE 'ontime' END AS target_class,
       target > 120 AS late FROM f_points""",
)
def delay_classes(spark, sf):
    return D.points(spark, sf).select(
        "sample_id", X.delay_class("target").alias("target_class"), (F.col("target") > 120).alias("late")
    )


@query(
    "P7",
    "SELECT stop_id, tr_id >= 9000000 AS synthetic FROM f_plan_syn",
)
def synthetic_vehicles(spark, sf):
    return D.plan_synthetic(spark, sf).select("stop_id", X.is_synthetic("tr_id").alias("synthetic"))


@query(
    "P8",
    "SELECT row_id, ok AND CASE WHEN k % 4 > 0 THEN lat END IS NOT NULL AS on_map FROM f_telemetry",
)
def has_position(spark, sf):
    t = D.telemetry(spark, sf).withColumn("lat", F.when(F.col("k") % 4 > 0, F.col("lat")))
    return t.select("row_id", X.has_position("ok", "lat", "lon").alias("on_map"))


@query(
    "P10",
    """SELECT row_id, CASE WHEN 1767690000 - t <= 120 THEN 'active' WHEN 1767690000 - t <= 900 THEN 'stale' ELSE 'offline' END AS freshness
       FROM f_telemetry""",
)
def freshness(spark, sf):
    return D.telemetry(spark, sf).select("row_id", X.freshness("t", F.lit(1767690000.0)).alias("freshness"))


@query(
    "P11",
    """SELECT sample_id, CASE WHEN i % 11 = 0 THEN 'predictor_unavailable' WHEN stale THEN 'stale_telemetry'
       WHEN i < 30 THEN 'warming_up' END AS reason FROM f_predictions""",
)
def degraded_reasons(spark, sf):
    p = D.predictions(spark, sf)
    return p.select(
        "sample_id",
        X.degraded_reason(F.col("i") % 11 == 0, F.col("stale"), F.col("i") < 30).alias("reason"),
    )
