"""Clock, window, scoring, alerts and dispatcher views."""

from pyspark.sql import functions as F

from fleetlag.catalog import fleetday as D
from fleetlag.catalog.join_queries import ALERT_VIEWS, alerts, ticks
from fleetlag.catalog.metric_queries import rounded
from fleetlag.catalog.registry import query
from fleetlag.functions import scalars as X
from fleetlag.operators.joins import beside
from fleetlag.plans import live as L

NOW = 1767685500.0  # inside the fleet day


@query("W8", "SELECT tr_id, max(t) AS t, arg_max(prediction_s, t) AS prediction_s FROM f_predictions WHERE t >= 1767682800 GROUP BY tr_id")
def latest_prediction(spark, sf):
    return L.latest_predictions(D.predictions(spark, sf), 1767682800).select("tr_id", "t", "prediction_s")


@query(
    "W9",
    """SELECT tr_id, t, prediction_s FROM (SELECT *, row_number() OVER (PARTITION BY tr_id ORDER BY t DESC, sample_id DESC) AS rn FROM f_predictions) WHERE rn = 1""",
)
def current_prediction(spark, sf):
    return L.latest_predictions(D.predictions(spark, sf)).select("tr_id", "t", "prediction_s")


def shuffled(spark, sf):
    """Telemetry in an arrival order that differs from event time."""
    return D.telemetry(spark, sf).withColumn("row_id", F.expr("row_id + (row_id * 37) % 101 * 3000"))


SHUFFLED = {
    "f_shuffled": "SELECT * REPLACE (row_id + (row_id * 37) % 101 * 3000 AS row_id) FROM f_telemetry",
    "f_clocked": "SELECT *, max(t) OVER (ORDER BY row_id) AS clock, max(t) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock_before FROM f_shuffled",
}


@query("W10", "SELECT row_id, tr_id, t, clock FROM f_clocked", SHUFFLED)
def event_clock(spark, sf):
    return L.running_clock(shuffled(spark, sf)).select("row_id", "tr_id", "t", "clock")


@query("W11", "SELECT row_id, t, clock_before FROM f_clocked WHERE t - clock_before > 30", SHUFFLED)
def clock_jumps(spark, sf):
    return L.clock_jumps(shuffled(spark, sf), window_s=30).select("row_id", "t", "clock_before")


@query("T1", "SELECT max(t) AS clock, min(t) AS observed_since FROM f_telemetry")
def fleet_clock(spark, sf):
    return L.clock_of(D.telemetry(spark, sf))


@query(
    "W12",
    f"""SELECT v.tr_id, v.unit_id, round(f.lat, 6) AS lat, round(f.lon, 6) AS lon, f.speed AS speed_kmh, v.t AS last_t,
       CASE WHEN {NOW} - v.t <= 120 THEN 'active' WHEN {NOW} - v.t <= 900 THEN 'stale' ELSE 'offline' END AS freshness
       FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tr_id ORDER BY t DESC, row_id DESC) AS rn FROM f_held) WHERE rn = 1) v
       LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tr_id ORDER BY t DESC, row_id DESC) AS rn FROM f_held WHERE ok) WHERE rn = 1) f ON f.tr_id = v.tr_id""",
    {"f_held": f"SELECT * FROM f_telemetry WHERE t BETWEEN {NOW} - 1800 AND {NOW}"},
)
def vehicle_states(spark, sf):
    s = L.vehicle_states(D.telemetry(spark, sf), NOW)
    return s.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query(
    "W17",
    """SELECT tr_id, from_t, t, far OR from_far AS away FROM (SELECT *, lag(t) OVER w AS from_t, lag(far) OVER w AS from_far FROM (
       SELECT c.row_id, c.tr_id, c.t, min(12742 * asin(sqrt(pow(sin((radians(p.lat) - radians(c.lat)) / 2), 2)
         + cos(radians(c.lat)) * cos(radians(p.lat)) * pow(sin((radians(p.lon) - radians(c.lon)) / 2), 2)))) > 3 AS far
       FROM f_clean c JOIN (SELECT DISTINCT tr_id, lat, lon + CAST(0.08 AS DOUBLE) AS lon FROM f_plan) p ON p.tr_id = c.tr_id WHERE c.ok GROUP BY 1, 2, 3)
       WINDOW w AS (PARTITION BY tr_id ORDER BY t, row_id)) WHERE t - from_t <= 120""",
)
def track_sections(spark, sf):
    near = D.plan(spark, sf).withColumn("lon", F.col("lon") + 0.08)  # stops aside of the track, so that parts are away
    return L.track_sections(ticks(spark, sf).where("ok"), near).select("tr_id", "from_t", "t", "away")


@query(
    "W18",
    """SELECT tr_id, id, predicted_delay_s FROM (SELECT *, row_number() OVER (PARTITION BY tr_id ORDER BY opened_at DESC, id DESC) AS rn FROM f_alerts WHERE status = 'open') WHERE rn = 1""",
    ALERT_VIEWS,
)
def vehicle_incidents(spark, sf):
    return L.incidents(alerts(spark, sf)).select("tr_id", "id", "predicted_delay_s")


@query(
    "W19",
    """SELECT tr_id, sample_id, t, prediction_s FROM (SELECT *, row_number() OVER (PARTITION BY tr_id ORDER BY t DESC, sample_id) AS n FROM (
       SELECT tr_id, sample_id, t, CASE WHEN i % 5 = 0 AND i >= 60 THEN prediction_s + 1 ELSE prediction_s END AS prediction_s FROM f_predictions WHERE i < 100 OR i % 5 = 0)) WHERE n <= 50""",
)
def card_history(spark, sf):
    p = D.predictions(spark, sf)
    card = p.where("i < 100").select("tr_id", "sample_id", "t", "prediction_s", F.lit(59).cast("bigint").alias("card_seq"))
    messages = p.where("i % 5 = 0").select(
        "tr_id", "sample_id", "t", (F.col("prediction_s") + F.expr("CASE WHEN i < 100 OR i % 5 = 0 THEN 1 ELSE 0 END")).alias("prediction_s"), F.col("i").cast("bigint").alias("seq")
    )
    return L.merge_history(card, messages, keep=50)


@query("O1", "SELECT id, tr_id, opened_at FROM f_alerts WHERE status = 'open' ORDER BY opened_at DESC, id DESC LIMIT 100", ALERT_VIEWS)
def newest_open_alerts(spark, sf):
    return L.alert_list(alerts(spark, sf), "open", 100).select("id", "tr_id", "opened_at")


@query("O2", "SELECT sample_id, t, prediction_s FROM f_predictions WHERE tr_id = (SELECT min(tr_id) FROM f_predictions) AND t >= 1767682800")
def vehicle_predictions(spark, sf):
    p = D.predictions(spark, sf)
    first = p.agg(F.min("tr_id")).scalar()
    return p.where((F.col("tr_id") == first) & (F.col("t") >= 1767682800)).orderBy(F.desc("t")).select("sample_id", "t", "prediction_s")


_ALERT_COUNTS = {
    "f_lead": "SELECT id, CASE id % 4 WHEN 0 THEN 'confirmed' ELSE status END AS status, CASE id % 4 WHEN 0 THEN opened_at % 700 END AS lead_time_s FROM f_alerts",
}


@query(
    "A13",
    """SELECT count_if(status = 'open') AS open, count_if(status = 'confirmed') AS confirmed, count_if(status = 'cancelled') AS cancelled,
       round(avg(CASE WHEN status = 'confirmed' THEN lead_time_s END), 6) AS mean_lead_s FROM f_lead""",
    {**ALERT_VIEWS, **_ALERT_COUNTS},
)
def alert_counts(spark, sf):
    a = alerts(spark, sf).withColumns(
        {"lead_time_s": F.expr("CASE id % 4 WHEN 0 THEN opened_at % 700 END"), "status": F.expr("CASE id % 4 WHEN 0 THEN 'confirmed' ELSE status END")}
    )
    return rounded(L.alert_counts(a))


@query("T2", f"SELECT row_id, tr_id, t FROM f_telemetry WHERE k % 3 > 0 AND t >= {NOW} - 1800")
def window_points(spark, sf):
    t = D.telemetry(spark, sf).withColumn("tr_id", F.when(F.col("k") % 3 > 0, F.col("tr_id")))
    return L.in_window(t, NOW).select("row_id", "tr_id", "t")


@query(
    "T8",
    "SELECT tr_id, stop_id, arg_max(time_fact, r) AS time_fact FROM (SELECT tr_id, stop_id - stop_id % 4 AS stop_id, time_fact, stop_id AS r FROM f_stop_events) GROUP BY 1, 2",
)
def last_stop_events(spark, sf):
    e = D.stop_events(spark, sf).withColumn("row_id", F.col("stop_id")).withColumn("stop_id", F.expr("stop_id - stop_id % 4"))
    return L.last_event_per_stop(e).select("tr_id", "stop_id", "time_fact")


@query(
    "T9",
    """SELECT row_id, t FROM f_shuffled WHERE row_id >= coalesce((SELECT max(row_id) FROM (SELECT row_id, t, max(t) OVER (ORDER BY row_id DESC) AS c FROM f_shuffled) WHERE t < c - 1800), 0)""",
    SHUFFLED,
)
def recovery_history(spark, sf):
    return L.history_for_recovery(shuffled(spark, sf)).select("row_id", "t")


LIVE = {"f_live": f"SELECT * FROM f_telemetry WHERE t <= {NOW} - CASE tr_id % 7 WHEN 0 THEN 1000 WHEN 1 THEN 300 ELSE -1000000 END"}
_TICK = {
    **LIVE,
    "f_cand": f"""SELECT s.tr_id, s.last_t, arg_min(p.stop_id, p.t_plan) AS target_stop_id, min(p.t_plan) AS t_target,
       (SELECT arg_max(delay_s, time_fact) FROM f_stop_events e WHERE e.tr_id = s.tr_id AND e.time_fact <= {NOW}) AS cur_dev_s
       FROM (SELECT tr_id, max(t) AS last_t FROM f_live WHERE t BETWEEN {NOW} - 1800 AND {NOW} GROUP BY 1) s
       JOIN f_plan p ON p.tr_id = s.tr_id AND p.t_plan > {NOW} + 600 AND p.t_plan <= {NOW} + 900 WHERE {NOW} - s.last_t <= 900 GROUP BY s.tr_id, s.last_t""",
}


def _live(spark, sf):
    """The whole telemetry; some vehicles fall silent 300 or 1000 seconds before now."""
    return D.telemetry(spark, sf).where(f"t <= {NOW} - CASE tr_id % 7 WHEN 0 THEN 1000 WHEN 1 THEN 300 ELSE -1000000 END")


@query(
    "T10 P12 P14",
    f"""SELECT tr_id || '_{int(NOW)}' AS sample_id, tr_id, target_stop_id, t_target AS target_time_begin, coalesce(cur_dev_s, 0) AS prediction_s,
       CASE WHEN coalesce(cur_dev_s, 0) BETWEEN -60 AND 120 THEN 'green' WHEN cur_dev_s > 300 THEN 'red' ELSE 'yellow' END AS risk_level,
       true AS degraded, 'predictor_unavailable' AS degraded_reason, CASE WHEN {NOW} - last_t > 120 THEN 'unknown|stale_telemetry' ELSE 'unknown' END AS reasons, 'fallback' AS model_version FROM f_cand""",
    _TICK,
)
def tick_scoring(spark, sf):
    rows = L.score_at(_live(spark, sf), D.plan(spark, sf), D.stop_events(spark, sf), NOW)
    return rows.select(
        "sample_id", "tr_id", "target_stop_id", "target_time_begin", "prediction_s", "risk_level", "degraded", "degraded_reason",
        F.array_join("reasons", "|").alias("reasons"), "model_version",
    )


@query(
    "P12 P11",
    f"""SELECT tr_id, coalesce(cur_dev_s, 0) * 2 + 10 AS prediction_s, CASE WHEN tr_id % 4 = 0 THEN 'predictor_unavailable' WHEN {NOW} - last_t > 120 THEN 'stale_telemetry' END AS degraded_reason,
       CASE WHEN tr_id % 4 = 0 THEN 'fallback' ELSE 'm2' END AS model_version FROM (SELECT * REPLACE (CASE WHEN tr_id % 4 = 0 THEN (coalesce(cur_dev_s, 0) - 10) / 2 ELSE cur_dev_s END AS cur_dev_s) FROM f_cand)""",
    _TICK,
)
def prediction_rows(spark, sf):
    def forecast(asked):
        return asked.where("tr_id % 4 <> 0").select(
            "sample_id", (F.coalesce("cur_dev_s", F.lit(0.0)) * 2 + 10).alias("prediction_s"), F.lit(0.4).alias("p_late"),
            F.array(F.lit("long_dwell")).alias("reasons"), F.lit("m2").alias("model_version"),
        )

    rows = L.score_at(_live(spark, sf), D.plan(spark, sf), D.stop_events(spark, sf), NOW, forecast)
    return rows.select("tr_id", "prediction_s", "degraded_reason", "model_version")


@query("T11", "SELECT row_id, t - 1800 < (SELECT min(t) FROM f_telemetry) AS warming_up FROM f_telemetry")
def warm_up(spark, sf):
    t = D.telemetry(spark, sf)
    since = t.agg(F.min("t").alias("since"))
    return beside(t, since).select("row_id", L.warming_up("since", "t").alias("warming_up"))


SNAP = {
    **LIVE,
    "f_seen": f"SELECT tr_id, max(t) AS last_t FROM f_live WHERE t BETWEEN {NOW} - 1800 AND {NOW} GROUP BY 1",
    "f_known": f"SELECT * FROM f_stop_events WHERE time_fact <= {NOW}",
    "f_curr": f"""SELECT p.* FROM (SELECT *, row_number() OVER (PARTITION BY tr_id ORDER BY t DESC) AS rn FROM f_predictions WHERE t <= {NOW}) p
       JOIN f_seen s ON s.tr_id = p.tr_id AND {NOW} - s.last_t <= 900 WHERE p.rn = 1 AND target_stop_id NOT IN (SELECT stop_id FROM f_known)""",
}


def _live_inputs(spark, sf):
    p = D.predictions(spark, sf).where(f"t <= {NOW}")
    e = D.stop_events(spark, sf).where(F.col("time_fact") <= NOW)
    return _live(spark, sf), p, e


@query("T13", "SELECT sample_id, tr_id FROM f_curr", SNAP)
def unexpired_predictions(spark, sf):
    t, p, e = _live_inputs(spark, sf)
    return L.current_predictions(p, e, L.vehicle_states(t, NOW), NOW).select("sample_id", "tr_id")


@query(
    "V1",
    f"""SELECT s.tr_id, s.last_t, CASE WHEN {NOW} - s.last_t <= 120 THEN 'active' WHEN {NOW} - s.last_t <= 900 THEN 'stale' ELSE 'offline' END AS freshness,
       c.sample_id, c.risk_level, q.address AS target_address FROM f_seen s LEFT JOIN f_curr c ON c.tr_id = s.tr_id LEFT JOIN f_plan q ON q.stop_id = c.target_stop_id""",
    SNAP,
)
def fleet_snapshot(spark, sf):
    t, p, e = _live_inputs(spark, sf)
    s = L.fleet_snapshot(t, p, e, D.plan(spark, sf), NOW)
    return s.select("tr_id", "last_t", "freshness", "prediction.sample_id", "prediction.risk_level", "prediction.target_address")


@query(
    "V2 P15",
    f"""SELECT coalesce(a.tr_id, b.tr_id, c.tr_id) AS tr_id, a.n AS track, a.t0 AS first_t, b.n AS stops, b.f AS facts, c.n AS predictions, c.newest FROM
       (SELECT tr_id, count(*) AS n, min(t) AS t0 FROM f_live WHERE ok AND t BETWEEN {NOW} - 1800 AND {NOW} GROUP BY 1) a
       FULL JOIN (SELECT p.tr_id, count(*) AS n, count(e.stop_id) AS f FROM f_plan p LEFT JOIN f_known e ON e.stop_id = p.stop_id WHERE p.t_plan BETWEEN {NOW} - 1800 AND {NOW} + 1800 GROUP BY 1) b ON a.tr_id = b.tr_id
       FULL JOIN (SELECT tr_id, count(*) AS n, arg_max(sample_id, t) AS newest FROM f_predictions WHERE t BETWEEN {NOW} - 1800 AND {NOW} GROUP BY 1) c ON c.tr_id = coalesce(a.tr_id, b.tr_id)""",
    SNAP,
)
def vehicle_cards(spark, sf):
    t, p, e = _live_inputs(spark, sf)
    c = L.vehicle_cards(t, D.plan(spark, sf), e, p, NOW)
    size = lambda n: F.when(F.col(n).isNotNull(), F.size(n)).cast("bigint").alias(n)
    return c.select(
        "tr_id", size("track"), F.element_at("track", 1)["t"].alias("first_t"), size("stops"),
        F.when(F.col("stops").isNotNull(), F.size(F.filter("stops", lambda s: s["time_fact"].isNotNull()))).cast("bigint").alias("facts"),
        size("predictions"), F.element_at("predictions", 1)["sample_id"].alias("newest"),
    )


@query(
    "V3",
    f"""SELECT (SELECT count(*) FROM f_seen) AS vehicles, (SELECT count_if(risk_level = 'red') FROM f_curr) AS red, (SELECT count(*) FROM f_alerts WHERE status = 'open') AS open_alerts,
       (SELECT round(avg(abs(prediction_s - e.delay_s)), 6) FROM f_predictions p JOIN f_known e ON e.stop_id = p.target_stop_id WHERE p.t <= {NOW}) AS mae_s""",
    {**ALERT_VIEWS, **SNAP},
)
def operations_row(spark, sf):
    t, p, e = _live_inputs(spark, sf)
    summary = L.fleet_summary(L.fleet_snapshot(t, p, e, D.plan(spark, sf), NOW))
    checked = L.check_predictions(p.withColumns({"actual_delay_s": F.lit(None).cast("double"), "abs_error_s": F.lit(None).cast("double")}), e)
    row = beside(summary, L.alert_counts(alerts(spark, sf).withColumn("lead_time_s", F.lit(None).cast("double"))))
    row = beside(row, L.accuracy(checked))
    return row.select(
        (F.col("active") + F.col("stale") + F.col("offline")).alias("vehicles"), F.col("risk_red").alias("red"),
        F.col("open").alias("open_alerts"), F.round("mae_s", 6).alias("mae_s"),
    )


@query("V4", "SELECT tr_id AS route_id, row_number() OVER (PARTITION BY tr_id ORDER BY t_plan, stop_id) AS stop_order, stop_id, address, t_plan AS time_plan FROM f_plan")
def network_table(spark, sf):
    from fleetlag.operators.timetable import stop_order

    return stop_order(D.plan(spark, sf)).select(
        F.col("tr_id").alias("route_id"), (F.col("pos") + 1).alias("stop_order"), "stop_id", "address", F.col("t_plan").alias("time_plan")
    )


@query("P15", "SELECT row_id, t FROM f_telemetry WHERE ok AND t BETWEEN 1767682800 AND 1767684600")
def track_view(spark, sf):
    return L.track_points(D.telemetry(spark, sf), 1767682800, 1767684600).select("row_id", "t")


_MSG = {
    "f_snap": "SELECT tr_id, min(unit_id) AS unit_id FROM f_vehicles WHERE tr_id % 2 = 0 GROUP BY 1",
    "f_msg": "SELECT i - 20 AS seq, tr_id, (tr_id + i) % 11 = 0 AS removed, tr_id * 1000 + i AS unit_id FROM f_predictions WHERE (tr_id * 3 + i) % 5 = 0 AND i <> 90",
}


@query(
    "U6",
    """SELECT tr_id, unit_id FROM (SELECT tr_id, arg_max(unit_id, seq) AS unit_id, arg_max(removed, seq) AS removed FROM (
       SELECT tr_id, unit_id, 10 AS seq, false AS removed FROM f_snap UNION ALL SELECT tr_id, unit_id, seq, removed FROM f_msg WHERE seq > 10 AND seq < coalesce(
         (SELECT min(seq) FROM (SELECT seq, lag(seq, 1, 10) OVER (ORDER BY seq) AS b FROM (SELECT DISTINCT seq FROM f_msg WHERE seq > 10)) WHERE seq - b > 1), 1000000)) GROUP BY tr_id) WHERE NOT removed""",
    _MSG,
)
def message_fold(spark, sf):
    snap = D.vehicles(spark, sf).where("tr_id % 2 = 0").groupBy("tr_id").agg(F.min("unit_id").alias("unit_id"))
    messages = D.predictions(spark, sf).where("(tr_id * 3 + i) % 5 = 0 AND i <> 90").select(
        (F.col("i") - 20).cast("bigint").alias("seq"), "tr_id", F.expr("(tr_id + i) % 11 = 0").alias("removed"),
        (F.col("tr_id") * 1000 + F.col("i")).alias("unit_id"),
    )
    return L.apply_messages(snap, messages, 10)


@query(
    "U6",
    """SELECT id, predicted_delay_s FROM (SELECT id, CASE WHEN id % 5 = 0 THEN (CASE WHEN id % 2 = 0 THEN 'cancelled' ELSE 'open' END) ELSE status END AS s, CASE WHEN id % 5 = 0 THEN predicted_delay_s + 1 ELSE predicted_delay_s END AS predicted_delay_s FROM f_alerts) WHERE s = 'open'""",
    ALERT_VIEWS,
)
def alert_message_fold(spark, sf):
    a = alerts(spark, sf).select("id", "status", "predicted_delay_s")
    messages = a.where("id % 5 = 0").select(
        "id", F.expr("CASE WHEN id % 2 = 0 THEN 'cancelled' ELSE 'open' END").alias("status"), (F.col("predicted_delay_s") + 1).alias("predicted_delay_s"), F.lit(5).alias("seq")
    )
    return L.open_alerts_after(a, messages).select("id", "predicted_delay_s")


@query("T16", "SELECT event_id, round(1767690000.5 - us // 1000 / 1000.0::DOUBLE, 3) AS lag_s FROM f_events")
def stream_lag(spark, sf):
    e = D.events(spark, sf).withColumn("entry", F.concat_ws("-", F.expr("us div 1000"), F.lit(0)))
    lag = F.greatest(F.lit(1767690000.5) - X.entry_ms("entry") / 1000, F.lit(0.0))
    return e.select("event_id", F.round(lag, 3).alias("lag_s"))


@query(
    "T3",
    """SELECT CAST(t AS DOUBLE) AS tick_t FROM (WITH RECURSIVE f_next AS MATERIALIZED (
         SELECT a.t, min(b.t) AS n FROM (SELECT DISTINCT t FROM f_telemetry) a JOIN (SELECT DISTINCT t FROM f_telemetry) b ON b.t BETWEEN a.t + 60 AND a.t + 3600 GROUP BY a.t),
       chain(t) AS (SELECT min(t) FROM f_telemetry UNION ALL SELECT n FROM chain JOIN f_next USING (t)) SELECT t FROM chain)""",
)
def scoring_ticks(spark, sf):
    from fleetlag.plans.ticks import tick_times

    return tick_times(L.running_clock(D.telemetry(spark, sf)))


@query(
    "P1 M1 P9 A4",
    """SELECT part, CASE WHEN p BETWEEN -60 AND 120 THEN 'green' WHEN p > 300 THEN 'red' ELSE 'yellow' END AS risk_level, count(*) AS points, round(avg(abs(p - target)), 6) AS mae
       FROM (SELECT part, target, coalesce(cur_dev_s, 0) AS p FROM f_points) GROUP BY 1, 2""",
)
def persistence_risk_report(spark, sf):
    from fleetlag.operators.baselines import simple_forecasts

    p = simple_forecasts(D.points(spark, sf))
    out = p.groupBy("part", X.risk_level("persistence").alias("risk_level")).agg(
        F.count(F.lit(1)).alias("points"), F.avg(F.abs(F.col("persistence") - F.col("target"))).alias("mae")
    )
    return rounded(out)
