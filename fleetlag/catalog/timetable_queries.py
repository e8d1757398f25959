"""Timetable structure over the derived plan."""

from pyspark.sql import functions as F

from fleetlag.catalog import fleetday as D
from fleetlag.catalog.registry import query
from fleetlag.operators import timetable as TT


@query("W1", "SELECT stop_id, pos FROM f_prepared")
def stop_position(spark, sf):
    return TT.stop_order(D.plan(spark, sf)).select("stop_id", "pos")


@query("W2", "SELECT stop_id, gap_s FROM f_prepared")
def planned_gap(spark, sf):
    return TT.prepare_plan(D.plan(spark, sf)).select("stop_id", "gap_s")


@query("W3", "SELECT stop_id, trip FROM f_prepared")
def trip_split(spark, sf):
    return TT.prepare_plan(D.plan(spark, sf)).select("stop_id", "trip")


@query("W4", "SELECT stop_id, seq, trip_len FROM f_prepared")
def trip_sequence(spark, sf):
    return TT.prepare_plan(D.plan(spark, sf)).select("stop_id", "seq", "trip_len")


@query("W5", "SELECT stop_id, round(step_m, 3) AS step_m, round(cum_m, 3) AS cum_m FROM f_prepared")
def plan_distance(spark, sf):
    return TT.prepare_plan(D.plan(spark, sf)).select(
        "stop_id", F.round("step_m", 3).alias("step_m"), F.round("cum_m", 3).alias("cum_m")
    )


@query(
    "W6",
    """SELECT sample_id, CAST(sum(b) OVER (ORDER BY tr_id, T) AS BIGINT) AS run FROM (
       SELECT *, CASE WHEN lag(T) OVER w IS NULL OR T - lag(T) OVER w > 900 OR part <> lag(part) OVER w THEN 1 ELSE 0 END AS b
       FROM f_points WINDOW w AS (PARTITION BY tr_id ORDER BY T))""",
)
def runs_of_points(spark, sf):
    return TT.point_runs(D.points(spark, sf)).select("sample_id", "run")


@query("W7", "SELECT stop_id, tr_id AS route_id, row_number() OVER (PARTITION BY tr_id ORDER BY t_plan, stop_id) AS stop_order FROM f_plan")
def network_stop_order(spark, sf):
    return TT.stop_order(D.plan(spark, sf)).select(
        "stop_id", F.col("tr_id").alias("route_id"), (F.col("pos") + 1).alias("stop_order")
    )


@query(
    "W16",
    """SELECT tr_id AS route_id, trip, count(*) AS stops,
       string_agg(lon_e5 || ' ' || lat_e5, ',' ORDER BY pos) AS line FROM f_prepared GROUP BY tr_id, trip HAVING count(*) >= 2""",
)
def network_lines(spark, sf):
    lines = TT.trip_lines(D.plan(spark, sf))
    text = F.transform(
        "line",
        lambda p: F.concat_ws(" ", F.round(p["lon"] * 1e5).cast("bigint"), F.round(p["lat"] * 1e5).cast("bigint")),
    )
    return lines.select(
        F.col("tr_id").alias("route_id"), "trip", "stops", F.array_join(text, ",").alias("line")
    )
