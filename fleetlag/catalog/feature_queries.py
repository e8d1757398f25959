"""Time-series features of forecast points."""

from pyspark.sql import functions as F

from fleetlag.catalog import fleetday as D
from fleetlag.catalog.join_queries import POINT_VIEWS, ticks
from fleetlag.catalog.metric_queries import rounded
from fleetlag.catalog.registry import query
from fleetlag.operators import arrivals as A
from fleetlag.operators import clean as C
from fleetlag.operators import metrics as ME
from fleetlag.operators import timetable as TT
from fleetlag.plans import features as FE
from fleetlag.plans import targets as TG
from fleetlag.session import cut_all, cut_lineage

_MOTION = """tel_age_s fixes_15m ok_share_15m speed_mean_5m speed_mean_15m speed_max_5m stopped_share_10m standing_s
dist_to_target_m route_offset_m gps_dist_ahead_m gps_stops_ahead eta_dev_s""".split()


@query(
    "F2",
    """SELECT p.sample_id, p.t_target - p.T AS lead_s, round(((p.T + 10800) % 86400) / 3600, 6) AS hour, p.T - l.t_plan AS since_last_plan_s,
       CAST(CASE WHEN l.pos IS NULL THEN q.pos + 1 ELSE q.pos - l.pos END AS DOUBLE) AS stops_ahead, round(q.cum_m - l.cum_m, 3) AS plan_dist_ahead_m, q.t_plan - l.t_plan AS plan_run_s,
       CAST(coalesce((SELECT sum(gap_s) FROM f_prepared g WHERE g.tr_id = p.tr_id AND g.pos > coalesce(l.pos, 0) AND g.pos <= q.pos AND gap_s >= 420), 0) AS DOUBLE) AS layover_ahead_s,
       CASE WHEN l.pos IS NULL OR q.trip <> l.trip THEN 1 ELSE 0 END::DOUBLE AS new_trip_ahead, round(l.seq / greatest(l.trip_len - 1, 1), 6) AS last_trip_frac, q.seq::DOUBLE AS target_seq,
       round(q.seq / greatest(q.trip_len - 1, 1), 6) AS target_trip_frac, q.trip_len::DOUBLE AS trip_stops, q.trip::DOUBLE AS trip_no, q.lat AS target_lat, q.lon AS target_lon
       FROM f_points p JOIN f_prepared q ON q.stop_id = p.target_stop_id
       LEFT JOIN f_prepared l ON l.tr_id = p.tr_id AND l.pos = (SELECT max(pos) FROM f_prepared x WHERE x.tr_id = p.tr_id AND x.t_plan <= p.T)""",
)
def timetable_features(spark, sf):
    f = FE.timetable_features(D.points(spark, sf), D.plan(spark, sf))
    f = f.withColumn("plan_dist_ahead_m", F.round("plan_dist_ahead_m", 3))
    return rounded(f.select("sample_id", *FE.timetable_columns()), "plan_dist_ahead_m", "target_lat", "target_lon")


def motion_frame(points, plan, telemetry):
    """Points with the motion features only."""
    prepared, telemetry = cut_all(TT.prepare_plan(plan), telemetry)
    base = cut_lineage(FE.with_plan_context(points.withColumn("T_cut", F.col("T")), prepared))
    base = cut_lineage(FE.with_last_fixes(base, telemetry))
    pairs = FE.recent_fixes(base.select("sample_id", "tr_id", "T"), telemetry, 900.0)
    full = base.join(FE.motion_aggregates(pairs), "sample_id", "left").join(FE.route_positions(base, prepared), "sample_id", "left")
    return full.withColumns(FE.motion_columns())


_MOTION_VIEWS = {
    **POINT_VIEWS,
    "f_recent": """SELECT p.sample_id, p.T AS moment, c.t, c.ok, CASE WHEN c.ok THEN c.speed END AS speed FROM f_points p JOIN f_clean c ON c.tr_id = p.tr_id AND c.t BETWEEN p.T - 9000 AND p.T""",
    "f_agg": """SELECT sample_id, count(CASE WHEN t >= moment - 900 THEN 1 END)::DOUBLE AS fixes_15m, avg(CASE WHEN t >= moment - 900 THEN CAST(ok AS INT) END) AS ok_share_15m,
       avg(CASE WHEN t >= moment - 300 THEN speed END) AS speed_mean_5m, avg(CASE WHEN t >= moment - 900 THEN speed END) AS speed_mean_15m, max(CASE WHEN t >= moment - 300 THEN speed END) AS speed_max_5m,
       avg(CASE WHEN t >= moment - 600 AND speed IS NOT NULL THEN CAST(speed < 5 AS INT) END) AS stopped_share_10m,
       coalesce(any_value(moment) - max(CASE WHEN speed >= 5 THEN t END), CASE WHEN count(speed) > 0 THEN 9000 END) AS standing_s FROM f_recent GROUP BY sample_id""",
}


@query(
    "F3",
    """SELECT x.sample_id, x.T - f.t AS tel_age_s, coalesce(fixes_15m, 0) AS fixes_15m, round(ok_share_15m, 6) AS ok_share_15m, round(speed_mean_5m, 6) AS speed_mean_5m,
       round(speed_mean_15m, 6) AS speed_mean_15m, speed_max_5m, round(stopped_share_10m, 6) AS stopped_share_10m, standing_s,
       round(12742000 * asin(sqrt(pow(sin((radians(tlat) - radians(f.lat)) / 2), 2) + cos(radians(f.lat)) * cos(radians(tlat)) * pow(sin((radians(tlon) - radians(f.lon)) / 2), 2))), 3) AS dist_to_target_m,
       round(n.d, 3) AS route_offset_m, round(tcum - n.cum_m, 3) AS gps_dist_ahead_m, x.tpos - n.pos AS gps_stops_ahead,
       round(CASE WHEN speed_mean_15m IS NOT NULL AND n.d IS NOT NULL THEN greatest(-1800, least(1800, x.T + (tcum - n.cum_m) / greatest(speed_mean_15m / 3.6, 1) - t_target)) END, 3) AS eta_dev_s
       FROM f_ctx x LEFT JOIN f_fix f USING (sample_id) LEFT JOIN f_near n USING (sample_id) LEFT JOIN f_agg USING (sample_id)""",
    _MOTION_VIEWS,
)
def motion_features(spark, sf):
    f = motion_frame(D.points(spark, sf), D.plan(spark, sf), ticks(spark, sf))
    metres = {c: F.round(c, 3) for c in ("dist_to_target_m", "route_offset_m", "gps_dist_ahead_m", "eta_dev_s")}
    return rounded(f.select("sample_id", *_MOTION).withColumns(metres), *metres)


@query(
    "F7",
    """SELECT sample_id, count(CASE WHEN kind = 'silence' AND t > m - 300 THEN NULL ELSE 1 END) AS fixes, count(CASE WHEN ok AND t <= m - 300 THEN 1 END) AS usable
       FROM (SELECT p.sample_id, p.T AS m, c.t, c.ok, CASE WHEN target_stop_id % 2 = 0 THEN 'silence' ELSE 'no_position' END AS kind FROM f_points p
       JOIN f_clean c ON c.tr_id = p.tr_id AND c.t BETWEEN p.T - 900 AND p.T) GROUP BY 1 HAVING count(CASE WHEN kind = 'silence' AND t > m - 300 THEN NULL ELSE 1 END) > 0""",
)
def lost_telemetry(spark, sf):
    p = D.points(spark, sf).select("sample_id", "tr_id", "T", F.lit(300.0).alias("gap_s"), F.expr("CASE WHEN target_stop_id % 2 = 0 THEN 'silence' ELSE 'no_position' END").alias("outage"))
    pairs = FE.recent_fixes(p, ticks(spark, sf), 900.0)
    return pairs.groupBy("sample_id").agg(F.count(F.lit(1)).alias("fixes"), F.count_if(F.col("ok") & F.col("lat").isNotNull()).alias("usable"))


@query(
    "F8",
    """SELECT v.tr_id || '_' || CAST(m.T AS BIGINT) AS sample_id, arg_min(stop_id, t_plan) AS target_stop_id FROM f_ids v, (SELECT DISTINCT floor(t / 600) * 600 AS T FROM f_clean) m
       JOIN f_plan p ON p.tr_id = v.tr_id AND p.t_plan > m.T + 600 AND p.t_plan <= m.T + 900 GROUP BY 1""",
)
def points_at_moments(spark, sf):
    moments = ticks(spark, sf).select((F.floor(F.col("t") / 600) * 600).cast("double").alias("T")).distinct()
    return TG.points_at(D.plan(spark, sf), moments).select("sample_id", "target_stop_id")


@query("F1")
def detected_arrivals(spark, sf):
    prepared, fixes = cut_all(TT.prepare_plan(D.plan(spark, sf)), ticks(spark, sf))
    found = A.detect_arrivals(prepared, fixes)
    return found.select("stop_id", "tr_id", "t_arr", "dwell_s", "closest_m")


@query("F1 A1")
def detector_quality(spark, sf):
    prepared, fixes = cut_all(TT.prepare_plan(D.plan(spark, sf)), ticks(spark, sf))
    found = A.detect_arrivals(prepared, fixes)
    return ME.arrival_quality(found, D.facts(spark, sf))


@query(
    "W14",
    """SELECT stop_id, min(t) AS from_t, max(t) AS to_t, count(*) AS fixes, round(min(d), 3) AS closest_m FROM (
       SELECT *, n - row_number() OVER (PARTITION BY stop_id ORDER BY n) AS run FROM (SELECT p.stop_id, g.t, g.n,
         12742000 * asin(sqrt(pow(sin((radians(p.lat) - radians(g.lat)) / 2), 2) + cos(radians(g.lat)) * cos(radians(p.lat)) * pow(sin((radians(p.lon) - radians(g.lon)) / 2), 2))) AS d
         FROM (SELECT *, row_number() OVER (PARTITION BY tr_id ORDER BY t, row_id) AS n FROM f_clean WHERE ok) g
         JOIN f_plan p ON p.tr_id = g.tr_id AND g.t BETWEEN p.t_plan - 420 AND p.t_plan + 900) WHERE d <= 80) GROUP BY stop_id, run""",
)
def stop_passes(spark, sf):
    runs = A.pass_runs(A.stop_passes(D.plan(spark, sf), cut_lineage(ticks(spark, sf))))
    return runs.withColumn("closest_m", F.round("closest_m", 3))


@query(
    "W15",
    """SELECT sample_id, max(CASE WHEN rn = 1 THEN delay_s END) AS last_s, round(avg(CASE WHEN rn <= 3 THEN delay_s END), 6) AS mean3_s,
       max(CASE WHEN rn = 1 THEN delay_s END) - arg_max(CASE WHEN rn <= 6 THEN delay_s END, CASE WHEN rn <= 6 THEN rn END) AS trend_s FROM (
       SELECT p.sample_id, e.delay_s, row_number() OVER (PARTITION BY p.sample_id ORDER BY e.time_fact DESC, e.stop_id DESC) AS rn
       FROM f_points p JOIN f_stop_events e ON e.tr_id = p.tr_id AND e.time_fact BETWEEN p.T - 9000 AND p.T) GROUP BY sample_id""",
)
def recent_delays(spark, sf):
    return rounded(FE.recent_delays(D.points(spark, sf), D.stop_events(spark, sf)))


@query("F6 F4 W15 J22")
def point_features(spark, sf):
    return FE.build_features(D.points(spark, sf), D.plan(spark, sf), ticks(spark, sf))


@query("F5 F6")
def point_features_gps_hint(spark, sf):
    return FE.build_features(D.points(spark, sf), D.plan(spark, sf), ticks(spark, sf), hint="gps")
