"""A fleet day derived from the ``events`` table, in Spark and as SQL views.

Thirty days of events are compressed into three hours; ten users make one vehicle. The views give
every operator whole-table input whose size follows the events table.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 1767679200  # 2026-01-06 06:00:00 UTC
EVENTS_START_US = 1704067200000000


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def vehicles(spark, sf) -> DataFrame:
    """Terminals and their vehicles, from a scan of all events."""
    return (
        spark.read.parquet(f"{sf}/events.parquet")
        .select(F.expr("100 + user_id div 10").alias("tr_id"), (F.col("user_id") + 9000).alias("unit_id"))
        .distinct()
    )


def delay_of(tr="tr_id"):
    return F.expr(f"({tr} * 37) % 240 - 60")


def plan(spark, sf) -> DataFrame:
    ids = vehicles(spark, sf).select("tr_id").distinct()
    # merged in joins: Spark takes the rows made here for as few as the ids and would broadcast them
    k = ids.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(79)))).hint("merge")
    j = F.expr("CASE WHEN (k div 20) % 2 = 0 THEN k % 20 ELSE 19 - k % 20 END")
    e5 = k.select(
        (F.col("tr_id") * 1000 + F.col("k")).alias("stop_id"),
        "tr_id",
        F.expr(f"cast({DAY} + 120 * k + 480 * (k div 20) as double)").alias("t_plan"),
        j.alias("j"),
        F.expr("5575000 + 1000 * (tr_id % 50)").alias("lat_e5"),
    ).withColumn("lon_e5", F.expr("cast(3760000 + 500 * j as bigint)"))
    return e5.select(
        "stop_id",
        "tr_id",
        "t_plan",
        (F.col("lat_e5") / 1e5).alias("lat"),
        (F.col("lon_e5") / 1e5).alias("lon"),
        F.format_string("street %d, %d", "tr_id", "j").alias("address"),
        "lat_e5",
        "lon_e5",
    )


def telemetry(spark, sf) -> DataFrame:
    e = events(spark, sf).select(
        F.col("event_id").alias("row_id"),
        F.expr("100 + user_id div 10").alias("tr_id"),
        (F.col("user_id") + 9000).alias("unit_id"),
        F.expr(f"{DAY} + (us - {EVENTS_START_US}) div 240000000").alias("t"),
        "k",
    )
    e = e.withColumn("tau", F.col("t") - DAY - delay_of())
    e = e.withColumn("trip", F.expr("cast(floor(tau / 2880.0D) as bigint)"))
    e = e.withColumn("w", F.expr("tau - 2880 * trip"))
    e = e.withColumn("kk", F.expr("least(w div 120, 19L)"))
    e = e.withColumn(
        "frac",
        F.expr("CASE WHEN kk = 19 THEN 0.0D ELSE greatest(0.0D, (w - 120 * kk - 30) / 90.0D) END"),
    )
    return e.select(
        "row_id",
        "tr_id",
        "unit_id",
        F.col("t").cast("double").alias("t"),
        F.expr("k % 25 <> 0").alias("ok"),
        F.expr("(5575000 + 1000 * (tr_id % 50)) / 1e5D").alias("lat"),
        F.expr(
            "CASE WHEN pmod(trip, 2) = 0 THEN 37.60D + 0.005D * (kk + frac)"
            " ELSE 37.60D + 0.005D * (19 - kk - frac) END"
        ).alias("lon"),
        F.expr("CASE WHEN frac > 0 THEN 13.0D ELSE 0.0D END").alias("speed"),
        "k",
    )


def telemetry_raw(spark, sf) -> DataFrame:
    """Text form of the telemetry, with the faults a reader must cope with."""
    return telemetry(spark, sf).select(
        "row_id",
        F.expr(
            "CASE WHEN k = 7 THEN 'abc' WHEN k % 10 = 0 THEN concat(unit_id, '.0')"
            " ELSE cast(unit_id as string) END"
        ).alias("unit_id"),
        F.expr(
            "CASE WHEN row_id % 997 = 0 THEN cast(tr_id + 1 as string) WHEN k = 9 THEN ''"
            " WHEN k = 13 THEN 'x1' ELSE cast(tr_id as string) END"
        ).alias("tr_id"),
        F.expr(
            "CASE WHEN k = 5 THEN 'yesterday'"
            " ELSE date_format(timestamp_seconds(t), 'yyyy-MM-dd HH:mm:ss') END"
        ).alias("event_time"),
        F.expr("CASE WHEN ok THEN 'True' ELSE 'False' END").alias("location_valid"),
        F.expr("CASE WHEN k = 17 THEN 95.0D ELSE lat END").alias("lat"),
        "lon",
        F.expr("CASE WHEN k = 3 THEN -1.0D WHEN k = 21 THEN 151.0D ELSE speed END").alias("speed"),
        F.expr("CASE WHEN k = 11 THEN 400.0D ELSE cast(k as double) END").alias("heading"),
    )


def plan_raw(spark, sf) -> DataFrame:
    return plan(spark, sf).select(
        F.expr(
            "CASE WHEN stop_id % 97 = 0 THEN '' WHEN stop_id % 10 = 1 THEN concat(stop_id, '.0')"
            " ELSE cast(stop_id as string) END"
        ).alias("tt_action_item_id"),
        F.col("tr_id").cast("string").alias("tr_id"),
        F.expr(
            "CASE WHEN stop_id % 89 = 0 THEN 'soon' WHEN stop_id % 7 = 0 THEN"
            " concat(date_format(timestamp_seconds(t_plan), 'yyyy-MM-dd HH:mm:ss'), '.123456789')"
            " ELSE date_format(timestamp_seconds(t_plan), 'yyyy-MM-dd HH:mm:ss') END"
        ).alias("time_begin"),
        F.expr(
            "CASE WHEN stop_id % 101 = 0 THEN 'POINT (37,5 55,7)' ELSE"
            " concat('POINT (', lon_e5 div 100000, '.', lpad(lon_e5 % 100000, 5, '0'), ' ',"
            " lat_e5 div 100000, '.', lpad(lat_e5 % 100000, 5, '0'), ')') END"
        ).alias("geom"),
        F.col("address").alias("building_address"),
    )


def plan_synthetic(spark, sf) -> DataFrame:
    """The plan plus copies of every fifth vehicle: other ids, five minutes later."""
    p = plan(spark, sf)
    copies = p.where("tr_id % 5 = 0").select(
        (F.col("stop_id") + 9_000_000_000).alias("stop_id"),
        (F.col("tr_id") + 9_000_000).alias("tr_id"),
        (F.col("t_plan") + 300).alias("t_plan"),
        *[c for c in p.columns if c not in ("stop_id", "tr_id", "t_plan")],
    )
    return p.unionByName(copies)


def facts(spark, sf) -> DataFrame:
    return plan(spark, sf).select(
        "stop_id",
        "tr_id",
        "t_plan",
        (F.col("t_plan") + delay_of() + F.expr("(stop_id * 7) % 11 - 5")).alias("t_fact"),
        F.expr("stop_id % 6 = 0").alias("manual_fill"),
    )


def stop_events(spark, sf) -> DataFrame:
    return (
        facts(spark, sf)
        .where("(stop_id * 13) % 10 <> 0")
        .select(
            "tr_id",
            "stop_id",
            F.col("t_plan").alias("time_plan"),
            F.col("t_fact").alias("time_fact"),
            (F.col("t_fact") - F.col("t_plan")).alias("delay_s"),
            (F.col("t_fact") + 10).alias("available_at"),
        )
    )


def _moments(spark, sf, count: int, step: int) -> DataFrame:
    ids = vehicles(spark, sf).select("tr_id").distinct()
    return ids.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).hint("merge").select(
        "tr_id", "i", (F.lit(DAY) + step * F.col("i")).cast("double").alias("T")
    )


def points(spark, sf) -> DataFrame:
    """Forecast points every five minutes with target, hint and label."""
    from fleetlag.plans.targets import latest_known_delay, pick_target

    p = plan(spark, sf)
    m = pick_target(_moments(spark, sf, 36, 300), p)
    m = latest_known_delay(m, stop_events(spark, sf))
    labels = facts(spark, sf).select(
        F.col("stop_id").alias("target_stop_id"), (F.col("t_fact") - F.col("t_plan")).alias("target")
    )
    parts = F.element_at(
        F.array(F.lit("train"), F.lit("test"), F.lit("validate")), F.expr("(i div 4) % 3 + 1").cast("int")
    )
    return m.join(labels, "target_stop_id").select(
        F.concat_ws("_", "tr_id", F.col("T").cast("bigint")).alias("sample_id"),
        "tr_id",
        "T",
        "target_stop_id",
        "t_target",
        "cur_dev_s",
        "target",
        parts.alias("part"),
    )


def predictions(spark, sf) -> DataFrame:
    from fleetlag.functions import scalars as X
    from fleetlag.plans.targets import pick_target

    m = pick_target(_moments(spark, sf, 180, 60), plan(spark, sf))
    return m.select(
        F.concat_ws("_", "tr_id", F.col("T").cast("bigint")).alias("sample_id"),
        "tr_id",
        F.col("T").alias("t"),
        "target_stop_id",
        F.col("t_target").alias("target_time_begin"),
        (delay_of() + F.expr("(tr_id * 7 + i * 53) % 400 - 60")).cast("double").alias("prediction_s"),
        F.expr("(tr_id + i) % 17 = 0").alias("stale"),
        F.lit("m1").alias("model_version"),
        "i",
    ).withColumn("risk_level", X.risk_level("prediction_s"))


# --- the same views for an SQL engine --------------------------------------------------------

VIEWS = {
    "f_events": """
        SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value,
               CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events""",
    "f_vehicles": "SELECT DISTINCT 100 + user_id // 10 AS tr_id, user_id + 9000 AS unit_id FROM events",
    "f_ids": "SELECT DISTINCT tr_id, (tr_id * 37) % 240 - 60 AS d FROM f_vehicles",
    "f_plan0": f"""
        SELECT tr_id * 1000 + k AS stop_id, tr_id,
               CAST({DAY} + 120 * k + 480 * (k // 20) AS DOUBLE) AS t_plan,
               CASE WHEN (k // 20) % 2 = 0 THEN k % 20 ELSE 19 - k % 20 END AS j,
               5575000 + 1000 * (tr_id % 50) AS lat_e5
        FROM f_ids, range(80) AS r(k)""",
    "f_plan": """
        SELECT stop_id, tr_id, t_plan, CAST(lat_e5 AS DOUBLE) / CAST(1e5 AS DOUBLE) AS lat,
               CAST(3760000 + 500 * j AS DOUBLE) / CAST(1e5 AS DOUBLE) AS lon,
               format('street {}, {}', tr_id, j) AS address, lat_e5,
               CAST(3760000 + 500 * j AS BIGINT) AS lon_e5 FROM f_plan0""",
    "f_tel0": f"""
        SELECT event_id AS row_id, 100 + user_id // 10 AS tr_id, user_id + 9000 AS unit_id,
               {DAY} + (us - {EVENTS_START_US}) // 240000000 AS t, k FROM f_events""",
    "f_tel1": f"""
        SELECT *, t - {DAY} - ((tr_id * 37) % 240 - 60) AS tau,
               CAST(floor((t - {DAY} - ((tr_id * 37) % 240 - 60)) / CAST(2880 AS DOUBLE)) AS BIGINT) AS trip
        FROM f_tel0""",
    "f_tel2": "SELECT *, tau - 2880 * trip AS w, least((tau - 2880 * trip) // 120, 19) AS kk FROM f_tel1",
    "f_tel3": """
        SELECT *, CASE WHEN kk = 19 THEN CAST(0 AS DOUBLE)
               ELSE greatest(CAST(0 AS DOUBLE), CAST(w - 120 * kk - 30 AS DOUBLE) / CAST(90 AS DOUBLE)) END AS frac
        FROM f_tel2""",
    "f_telemetry": """
        SELECT row_id, tr_id, unit_id, CAST(t AS DOUBLE) AS t, k % 25 <> 0 AS ok,
               CAST(5575000 + 1000 * (tr_id % 50) AS DOUBLE) / CAST(1e5 AS DOUBLE) AS lat,
               CASE WHEN (trip % 2 + 2) % 2 = 0
                    THEN CAST(37.60 AS DOUBLE) + CAST(0.005 AS DOUBLE) * (kk + frac)
                    ELSE CAST(37.60 AS DOUBLE) + CAST(0.005 AS DOUBLE) * (19 - kk - frac) END AS lon,
               CASE WHEN frac > 0 THEN CAST(13 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS speed, k
        FROM f_tel3""",
    "f_telemetry_raw": """
        SELECT row_id,
               CASE WHEN k = 7 THEN 'abc' WHEN k % 10 = 0 THEN unit_id || '.0'
                    ELSE CAST(unit_id AS VARCHAR) END AS unit_id,
               CASE WHEN row_id % 997 = 0 THEN CAST(tr_id + 1 AS VARCHAR) WHEN k = 9 THEN ''
                    WHEN k = 13 THEN 'x1' ELSE CAST(tr_id AS VARCHAR) END AS tr_id,
               CASE WHEN k = 5 THEN 'yesterday'
                    ELSE strftime(make_timestamp(CAST(t AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') END AS event_time,
               CASE WHEN ok THEN 'True' ELSE 'False' END AS location_valid,
               CASE WHEN k = 17 THEN CAST(95 AS DOUBLE) ELSE lat END AS lat, lon,
               CASE WHEN k = 3 THEN CAST(-1 AS DOUBLE) WHEN k = 21 THEN CAST(151 AS DOUBLE) ELSE speed END AS speed,
               CASE WHEN k = 11 THEN CAST(400 AS DOUBLE) ELSE CAST(k AS DOUBLE) END AS heading
        FROM f_telemetry""",
    "f_plan_raw": """
        SELECT CASE WHEN stop_id % 97 = 0 THEN '' WHEN stop_id % 10 = 1 THEN stop_id || '.0'
                    ELSE CAST(stop_id AS VARCHAR) END AS tt_action_item_id,
               CAST(tr_id AS VARCHAR) AS tr_id,
               CASE WHEN stop_id % 89 = 0 THEN 'soon'
                    ELSE strftime(make_timestamp(CAST(t_plan AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S')
                         || CASE WHEN stop_id % 7 = 0 THEN '.123456789' ELSE '' END END AS time_begin,
               CASE WHEN stop_id % 101 = 0 THEN 'POINT (37,5 55,7)' ELSE
                    'POINT (' || (lon_e5 // 100000) || '.' || lpad(CAST(lon_e5 % 100000 AS VARCHAR), 5, '0') || ' '
                    || (lat_e5 // 100000) || '.' || lpad(CAST(lat_e5 % 100000 AS VARCHAR), 5, '0') || ')' END AS geom,
               address AS building_address
        FROM f_plan""",
    "f_plan_syn": """
        SELECT stop_id, tr_id, t_plan, lat, lon, address, lat_e5, lon_e5 FROM f_plan
        UNION ALL
        SELECT stop_id + 9000000000, tr_id + 9000000, t_plan + 300, lat, lon, address, lat_e5, lon_e5
        FROM f_plan WHERE tr_id % 5 = 0""",
    "f_facts": """
        SELECT stop_id, tr_id, t_plan,
               t_plan + ((tr_id * 37) % 240 - 60) + ((stop_id * 7) % 11 - 5) AS t_fact,
               stop_id % 6 = 0 AS manual_fill FROM f_plan""",
    "f_stop_events": """
        SELECT tr_id, stop_id, t_plan AS time_plan, t_fact AS time_fact, t_fact - t_plan AS delay_s,
               t_fact + 10 AS available_at FROM f_facts WHERE (stop_id * 13) % 10 <> 0""",
    "f_moments": f"SELECT tr_id, i, CAST({DAY} + 300 * i AS DOUBLE) AS T FROM f_ids, range(36) AS r(i)",
    "f_points": """
        SELECT m.tr_id || '_' || CAST(m.T AS BIGINT) AS sample_id, m.tr_id, m.T,
               arg_min(p.stop_id, p.t_plan) AS target_stop_id, min(p.t_plan) AS t_target,
               any_value((SELECT arg_max(e.delay_s, e.time_fact) FROM f_stop_events e
                WHERE e.tr_id = m.tr_id AND e.time_fact <= m.T)) AS cur_dev_s,
               arg_min(f.t_fact - f.t_plan, p.t_plan) AS target,
               CASE (any_value(m.i) // 4) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'validate' END AS part
        FROM f_moments m JOIN f_plan p ON p.tr_id = m.tr_id AND p.t_plan > m.T + 600 AND p.t_plan <= m.T + 900
        JOIN f_facts f ON f.stop_id = p.stop_id GROUP BY m.tr_id, m.T""",
    "f_predictions": f"""
        SELECT m.tr_id || '_' || CAST(m.T AS BIGINT) AS sample_id, m.tr_id, m.T AS t,
               arg_min(p.stop_id, p.t_plan) AS target_stop_id, min(p.t_plan) AS target_time_begin,
               CAST(any_value((m.tr_id * 37) % 240 - 60 + (m.tr_id * 7 + m.i * 53) % 400 - 60) AS DOUBLE) AS prediction_s,
               any_value((m.tr_id + m.i) % 17 = 0) AS stale, 'm1' AS model_version, any_value(m.i) AS i,
               any_value(CASE WHEN (m.tr_id * 37) % 240 - 60 + (m.tr_id * 7 + m.i * 53) % 400 - 60 BETWEEN -60 AND 120 THEN 'green'
                    WHEN (m.tr_id * 37) % 240 - 60 + (m.tr_id * 7 + m.i * 53) % 400 - 60 > 300 THEN 'red' ELSE 'yellow' END) AS risk_level
        FROM (SELECT tr_id, i, CAST({DAY} + 60 * i AS DOUBLE) AS T FROM f_ids, range(180) AS r(i)) m
        JOIN f_plan p ON p.tr_id = m.tr_id AND p.t_plan > m.T + 600 AND p.t_plan <= m.T + 900
        GROUP BY m.tr_id, m.T""",
    "f_prepared": """
        SELECT *, count(*) OVER (PARTITION BY tr_id, trip) AS trip_len FROM (
          SELECT *, row_number() OVER (PARTITION BY tr_id, trip ORDER BY t_plan, stop_id) - 1 AS seq,
                 sum(step_m) OVER (PARTITION BY tr_id ORDER BY t_plan, stop_id) AS cum_m FROM (
            SELECT *, CAST(sum(CASE WHEN gap_s IS NULL OR gap_s >= 420 THEN 1 ELSE 0 END)
                     OVER (PARTITION BY tr_id ORDER BY t_plan, stop_id) - 1 AS BIGINT) AS trip,
                   coalesce(12742000 * asin(sqrt(pow(sin((radians(lat) - radians(plat)) / 2), 2)
                     + cos(radians(plat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(plon)) / 2), 2))), 0) AS step_m
            FROM (SELECT *, row_number() OVER w - 1 AS pos, t_plan - lag(t_plan) OVER w AS gap_s,
                         lag(lat) OVER w AS plat, lag(lon) OVER w AS plon,
                         lon_e5 * 100000000 + lat_e5 AS key
                  FROM f_plan WINDOW w AS (PARTITION BY tr_id ORDER BY t_plan, stop_id)))) """,
    "f_clean": """
        SELECT min(row_id) AS row_id, tr_id, t, lat, lon, speed, any_value(ok) AS ok FROM (
          SELECT row_id, tr_id, t, ok, CASE WHEN ok THEN lat END AS lat, CASE WHEN ok THEN lon END AS lon,
                 CASE WHEN speed BETWEEN 0 AND 150 THEN speed END AS speed FROM f_telemetry)
        GROUP BY tr_id, t, lat, lon, speed""",
}

_WORD = re.compile(r"\bf_[a-z0-9_]+\b")


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` preceded by every view it needs, in dependency order."""
    views = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def need(text):
        for name in _WORD.findall(text):
            if name in views and name not in order:
                need(views[name])
                order.append(name)

    need(sql)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({views[n].strip()})" for n in order)
    return f"WITH {ctes}\n{sql.strip()}"
