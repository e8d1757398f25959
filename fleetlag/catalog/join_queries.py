"""Joins over the derived fleet day."""

from pyspark.sql import functions as F

from fleetlag.catalog import fleetday as D
from fleetlag.catalog.registry import query
from fleetlag.catalog.source_queries import _raw_fixes
from fleetlag.operators import clean as C
from fleetlag.operators import joins as J
from fleetlag.operators import matching as M
from fleetlag.operators import timetable as TT
from fleetlag.operators.routes import route_ids as route_ids_
from fleetlag.plans import features as FE
from fleetlag.plans import live as L
from fleetlag.plans import targets as TG
from fleetlag.session import cut_lineage


def ticks(spark, sf):
    return C.clean_telemetry(_raw_fixes(spark, sf))


def units(spark, sf):
    """Telemetry as live records: every third has no vehicle id of its own."""
    t = D.telemetry(spark, sf)
    return t.withColumn("tr_id", F.when(F.col("k") % 3 > 0, F.col("tr_id")))


@query("J1", "SELECT row_id, t.unit_id, v.tr_id AS known_tr_id FROM f_telemetry t LEFT JOIN (SELECT * FROM f_vehicles WHERE unit_id % 7 <> 0) v ON v.unit_id = t.unit_id")
def vehicle_of_terminal(spark, sf):
    t = D.telemetry(spark, sf).select("row_id", "unit_id")
    return C.resolve_vehicle(t, D.vehicles(spark, sf).where("unit_id % 7 <> 0"))


@query(
    "J2",
    """SELECT row_id, r.tr_id, CASE WHEN r.tr_id IS NULL THEN 'unknown_vehicle' WHEN r.tr_id % 4 = 0 THEN 'unplanned' WHEN NOT ok THEN 'invalid_location' END AS skip
       FROM (SELECT row_id, ok, coalesce(CASE WHEN k % 3 > 0 THEN t.tr_id END, v.tr_id) AS tr_id FROM f_telemetry t
             LEFT JOIN (SELECT * FROM f_vehicles WHERE unit_id % 7 <> 0) v ON v.unit_id = t.unit_id) r""",
)
def resolved_ticks(spark, sf):
    known = D.vehicles(spark, sf).where("unit_id % 7 <> 0")
    planned = D.plan(spark, sf).where("tr_id % 4 <> 0")
    return M.resolve_ticks(units(spark, sf), known, planned).select("row_id", "tr_id", "skip")


@query(
    "J3",
    """SELECT m.tr_id, m.T, (SELECT arg_max(stop_id, t_plan) FROM f_plan p WHERE p.tr_id = m.tr_id AND p.t_plan <= m.T) AS last_stop_id
       FROM (SELECT tr_id, T - 300 AS T FROM f_moments) m""",
)
def last_planned_stop(spark, sf):
    m = D._moments(spark, sf, 36, 300).select("tr_id", (F.col("T") - 300).alias("T"))
    return TG.last_planned(m, D.plan(spark, sf), {"last_stop_id": "stop_id"})


@query(
    "J4",
    """SELECT m.tr_id, m.T, arg_min(stop_id, t_plan) AS target_stop_id, min(t_plan) AS t_target FROM f_moments m
       JOIN f_plan p ON p.tr_id = m.tr_id AND p.t_plan > m.T + 600 AND p.t_plan <= m.T + 900 GROUP BY ALL""",
)
def first_target(spark, sf):
    m = D._moments(spark, sf, 36, 300).drop("i")
    return TG.pick_target(m, D.plan(spark, sf))


@query(
    "J5",
    """SELECT sample_id, count(*) AS fixes, min(c.t) AS first_t, max(c.t) AS last_t FROM f_points p
       JOIN f_clean c ON c.tr_id = p.tr_id AND c.t BETWEEN p.T - 9000 AND p.T GROUP BY 1""",
)
def fixes_before_point(spark, sf):
    p = D.points(spark, sf).select("sample_id", "tr_id", "T")
    pairs = FE.recent_fixes(p, ticks(spark, sf), 9000.0)
    return pairs.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("fixes"), F.min("t").alias("first_t"), F.max("t").alias("last_t")
    )


POINT_VIEWS = {
    "f_ctx": """SELECT p.*, q.pos AS tpos, q.cum_m AS tcum, q.lat AS tlat, q.lon AS tlon,
        (SELECT max(pos) FROM f_prepared l WHERE l.tr_id = p.tr_id AND l.t_plan <= p.T) AS lpos FROM f_points p JOIN f_prepared q ON q.stop_id = p.target_stop_id""",
    "f_fix": """SELECT p.sample_id, arg_max(c.lat, c.t * 1e7 + c.row_id) AS lat, arg_max(c.lon, c.t * 1e7 + c.row_id) AS lon, max(c.t) AS t
        FROM f_points p JOIN f_clean c ON c.tr_id = p.tr_id AND c.ok AND c.t BETWEEN p.T - 9000 AND p.T GROUP BY 1""",
    "f_near": """SELECT sample_id, first(pos) AS pos, first(d) AS d, first(cum_m) AS cum_m FROM (SELECT x.sample_id, s.pos, s.cum_m,
        12742000 * asin(sqrt(pow(sin((radians(f.lat) - radians(s.lat)) / 2), 2) + cos(radians(s.lat)) * cos(radians(f.lat)) * pow(sin((radians(f.lon) - radians(s.lon)) / 2), 2))) AS d
        FROM f_ctx x JOIN f_fix f USING (sample_id) JOIN f_prepared s ON s.tr_id = x.tr_id AND s.pos BETWEEN greatest(coalesce(x.lpos, -1) - 6, 0) AND x.tpos
        ORDER BY sample_id, round(d, 6), pos) GROUP BY 1""",
}


@query("J6", "SELECT sample_id, pos, round(d, 3) AS d FROM f_near", POINT_VIEWS)
def route_position(spark, sf):
    prepared = cut_lineage(TT.prepare_plan(D.plan(spark, sf)))
    p = D.points(spark, sf).withColumn("T_cut", F.col("T"))
    base = cut_lineage(FE.with_plan_context(p, prepared))
    base = FE.with_last_fixes(base, ticks(spark, sf))
    near = FE.route_positions(base, prepared)
    return near.select("sample_id", "near.pos", F.round("near.d", 3).alias("d"))


@query(
    "J7",
    """SELECT row_id, min(stop_id) AS stop_id, min(t_plan) AS t_plan FROM (SELECT c.row_id, p.stop_id, p.t_plan,
       2 * 6371008.8 * asin(sqrt(pow(sin((radians(p.lat) - radians(c.lat)) / 2), 2) + cos(radians(c.lat)) * cos(radians(p.lat)) * pow(sin((radians(p.lon) - radians(c.lon)) / 2), 2))) AS d
       FROM f_clean c JOIN f_plan p ON p.tr_id = c.tr_id AND p.t_plan BETWEEN c.t - 300 AND c.t + 300) WHERE d <= 50 GROUP BY row_id HAVING count(*) = 1""",
)
def unambiguous_visits(spark, sf):
    return M.unambiguous_matches(ticks(spark, sf), D.plan(spark, sf))


@query("J8", "SELECT e.stop_id, e.time_fact - f.t_fact AS error_s, f.manual_fill FROM f_stop_events e JOIN f_facts f ON f.stop_id = e.stop_id")
def arrivals_with_facts(spark, sf):
    e = D.stop_events(spark, sf)
    return e.join(D.facts(spark, sf).select("stop_id", "t_fact", "manual_fill"), "stop_id").select(
        "stop_id", (F.col("time_fact") - F.col("t_fact")).alias("error_s"), "manual_fill"
    )


@query(
    "J9 A26",
    """SELECT f.stop_id, f.tr_id, f.t_fact, e.time_fact AS t_found, e.time_fact - f.t_fact AS error_s FROM f_facts f
       JOIN (SELECT tr_id, min(t) AS a, max(t) AS b FROM f_clean GROUP BY 1) w ON w.tr_id = f.tr_id AND f.t_fact BETWEEN a AND b
       LEFT JOIN f_stop_events e ON e.stop_id = f.stop_id""",
)
def facts_in_observed_span(spark, sf):
    return M.recall_rows(D.plan(spark, sf), D.facts(spark, sf), ticks(spark, sf), D.stop_events(spark, sf))


@query("J10", "SELECT row_id, tr_id FROM f_clean WHERE tr_id IN (SELECT tr_id FROM f_plan WHERE tr_id % 3 = 0)")
def planned_vehicles_only(spark, sf):
    return M.planned_only(ticks(spark, sf), D.plan(spark, sf).where("tr_id % 3 = 0")).select("row_id", "tr_id")


@query(
    "J12 T14",
    """SELECT sample_id, CASE WHEN e.delay_s IS NOT NULL THEN e.delay_s ELSE old END AS actual_delay_s,
       CASE WHEN e.delay_s IS NOT NULL AND e.delay_s IS DISTINCT FROM old THEN abs(prediction_s - e.delay_s) END AS abs_error_s,
       e.delay_s IS NOT NULL AND e.delay_s IS DISTINCT FROM old AS changed
       FROM (SELECT p.*, CASE WHEN i % 9 = 0 THEN f.t_fact - f.t_plan END AS old FROM f_predictions p JOIN f_facts f ON f.stop_id = p.target_stop_id) p
       LEFT JOIN f_stop_events e ON e.stop_id = p.target_stop_id""",
)
def checked_predictions(spark, sf):
    facts = D.facts(spark, sf).select(F.col("stop_id").alias("target_stop_id"), (F.col("t_fact") - F.col("t_plan")).alias("d"))
    p = D.predictions(spark, sf).join(facts, "target_stop_id")
    p = p.withColumn("actual_delay_s", F.when(F.col("i") % 9 == 0, F.col("d"))).withColumn("abs_error_s", F.lit(None).cast("double"))
    return L.check_predictions(p, D.stop_events(spark, sf)).select("sample_id", "actual_delay_s", "abs_error_s", "changed")


ALERT_VIEWS = {
    "f_alerts": """SELECT tr_id * 1000 + i AS id, tr_id, target_stop_id, CASE i % 3 WHEN 0 THEN 'cancelled' ELSE 'open' END AS status, t AS opened_at, prediction_s AS predicted_delay_s
       FROM f_predictions WHERE risk_level = 'red'""",
}


def alerts(spark, sf):
    return D.predictions(spark, sf).where("risk_level = 'red'").select(
        (F.col("tr_id") * 1000 + F.col("i")).alias("id"),
        "tr_id",
        "target_stop_id",
        F.expr("CASE i % 3 WHEN 0 THEN 'cancelled' ELSE 'open' END").alias("status"),
        F.col("t").alias("opened_at"),
        F.col("prediction_s").alias("predicted_delay_s"),
    )


@query(
    "J13",
    """SELECT id, time_fact AS closed_at, delay_s AS actual_delay_s, time_fact - opened_at AS lead_time_s FROM f_alerts a
       JOIN f_stop_events e ON e.tr_id = a.tr_id AND e.stop_id = a.target_stop_id WHERE status = 'open'""",
    ALERT_VIEWS,
)
def confirmed_alerts(spark, sf):
    return L.confirm_alerts(alerts(spark, sf), D.stop_events(spark, sf)).select("id", "closed_at", "actual_delay_s", "lead_time_s")


@query(
    "J14",
    """SELECT id, min(e.time_fact) AS closed_at FROM f_alerts a JOIN f_plan s ON s.stop_id = a.target_stop_id
       JOIN f_stop_events e ON e.tr_id = a.tr_id AND e.time_plan > s.t_plan WHERE status = 'open' GROUP BY id""",
    ALERT_VIEWS,
)
def passed_alerts(spark, sf):
    return L.close_passed_alerts(alerts(spark, sf), D.plan(spark, sf), D.stop_events(spark, sf)).select("id", "closed_at")


@query("J15", "SELECT sample_id, cur_dev_s FROM f_points")
def delay_known_at_point(spark, sf):
    return L.with_known_delay(D.points(spark, sf), D.stop_events(spark, sf)).select("sample_id", "cur_dev_s")


@query(
    "J16",
    """SELECT sample_id, (SELECT arg_max(stop_id, time_fact * 1e7 + stop_id % 1000) FROM f_stop_events e WHERE e.tr_id = p.tr_id AND e.time_fact <= p.t) AS last_passed FROM f_predictions p""",
)
def last_passed_stop(spark, sf):
    p = D.predictions(spark, sf).select("sample_id", "tr_id", "t")
    return M.passed_at(p, D.stop_events(spark, sf), "t").select("sample_id", "last_passed")


@query(
    "J17",
    """SELECT sample_id, (SELECT arg_max(delay_s, time_fact) FROM f_av e WHERE e.tr_id = p.tr_id AND e.available_at <= p.T) AS estimate_s,
       (SELECT arg_max(stop_id, time_fact) FROM f_av e WHERE e.tr_id = p.tr_id AND e.available_at <= p.T) AS last_stop_id FROM f_points p""",
    {"f_av": "SELECT * REPLACE (time_fact + 10 + (stop_id % 5) * 90 AS available_at) FROM f_stop_events"},
)
def latest_available_arrival(spark, sf):
    e = D.stop_events(spark, sf).withColumn("available_at", F.expr("time_fact + 10 + (stop_id % 5) * 90"))
    p = D.points(spark, sf).select("sample_id", "tr_id", "T")
    return M.latest_available(p, e).select("sample_id", "estimate_s", "last_stop_id")


REQUEST_SQL = """SELECT p.sample_id, coalesce(a.n, 0) AS fixes, a.first_t, s.n AS stops, s.facts, s.last_plan FROM f_points p
       LEFT JOIN (SELECT sample_id, count(*) AS n, min(c.t) AS first_t FROM f_points p JOIN f_clean c ON c.tr_id = p.tr_id AND c.t BETWEEN p.T - {w} AND p.T GROUP BY 1) a USING (sample_id)
       LEFT JOIN (SELECT sample_id, count(*) AS n, count(CASE WHEN e.time_fact <= p.T THEN 1 END) AS facts, max(q.t_plan) AS last_plan FROM f_points p
                  JOIN f_plan q ON q.tr_id = p.tr_id AND q.t_plan BETWEEN p.T - 86400 AND p.t_target LEFT JOIN f_stop_events e ON e.stop_id = q.stop_id GROUP BY 1) s USING (sample_id)"""


def _request_shape(r):
    return r.select(
        "sample_id",
        F.coalesce(F.size("telemetry"), F.lit(0)).cast("bigint").alias("fixes"),
        F.element_at("telemetry", 1)["t"].alias("first_t"),
        F.size("schedule").cast("bigint").alias("stops"),
        F.size(F.filter("schedule", lambda s: s["time_fact"].isNotNull())).cast("bigint").alias("facts"),
        F.element_at("schedule", -1)["time_plan"].alias("last_plan"),
    )


@query("J18", REQUEST_SQL.format(w=1800))
def scoring_requests(spark, sf):
    r = L.requests(D.points(spark, sf), D.plan(spark, sf), ticks(spark, sf), D.stop_events(spark, sf))
    return _request_shape(r.withColumn("telemetry", F.when(F.col("telemetry").isNotNull(), F.col("telemetry"))))


@query("M14", REQUEST_SQL.format(w=9000))
def history_requests(spark, sf):
    r = L.requests(D.points(spark, sf), D.plan(spark, sf), ticks(spark, sf), D.stop_events(spark, sf), window_s=9000)
    return _request_shape(r)


@query(
    "J19",
    """SELECT p.stop_id, p.tr_id, p.address, e.time_fact, e.delay_s FROM f_plan p LEFT JOIN f_stop_events e ON e.stop_id = p.stop_id
       WHERE p.t_plan BETWEEN 1767682800 AND 1767686400""",
)
def card_stop_rows(spark, sf):
    return L.card_stops(D.plan(spark, sf), D.stop_events(spark, sf), 1767682800, 1767686400).select(
        "stop_id", "tr_id", "address", "time_fact", "delay_s"
    )


@query("J20", "SELECT sample_id, q.address AS target_address FROM f_predictions p LEFT JOIN (SELECT * FROM f_plan WHERE stop_id % 5 > 0) q ON q.stop_id = p.target_stop_id")
def target_addresses(spark, sf):
    known = D.plan(spark, sf).where("stop_id % 5 > 0")
    return L.with_address(D.predictions(spark, sf), known).select("sample_id", "target_address")


@query(
    "J21 U5",
    """SELECT v.tr_id, min(s.other) AS route FROM (SELECT DISTINCT tr_id FROM f_plan_syn) v JOIN (
         SELECT a.tr_id, b.tr_id AS other FROM (SELECT DISTINCT tr_id, lon_e5, lat_e5 FROM f_plan_syn) a JOIN (SELECT DISTINCT tr_id, lon_e5, lat_e5 FROM f_plan_syn) b
         ON a.lon_e5 = b.lon_e5 AND a.lat_e5 = b.lat_e5 GROUP BY 1, 2
         HAVING count(*) >= 0.5 * any_value((SELECT count(*) FROM (SELECT DISTINCT tr_id, lon_e5, lat_e5 FROM f_plan_syn) c WHERE c.tr_id = a.tr_id))) s
       ON s.tr_id = v.tr_id GROUP BY 1""",
)
def shared_routes(spark, sf):
    return route_ids_(D.plan_synthetic(spark, sf))


@query(
    "J23",
    """SELECT row_id, round(min(12742 * asin(sqrt(pow(sin((radians(p.lat) - radians(c.lat)) / 2), 2)
       + cos(radians(c.lat)) * cos(radians(p.lat)) * pow(sin((radians(p.lon) - radians(c.lon)) / 2), 2)))), 6) AS stop_km
       FROM f_clean c JOIN (SELECT DISTINCT tr_id, lat, lon FROM f_plan) p ON p.tr_id = c.tr_id WHERE c.ok GROUP BY 1""",
)
def nearest_stop_distance(spark, sf):
    near = L.nearest_stop_km(ticks(spark, sf).where("ok"), D.plan(spark, sf))
    return near.select("row_id", F.round("stop_km", 6).alias("stop_km"))


_MEMBERS = "SELECT sample_id, part, target, row_number() OVER (ORDER BY sample_id) AS n FROM f_points"


@query(
    "J24",
    """SELECT count_if(a AND b) AS matched, count_if(a AND NOT b) AS only_left, count_if(b AND NOT a) AS only_right, CAST(0 AS BIGINT) AS repeated
       FROM (SELECT target_stop_id % 7 > 0 AS a, target_stop_id % 5 > 0 AS b FROM f_points) WHERE a OR b""",
)
def member_alignment(spark, sf):
    p = D.points(spark, sf)
    return J.alignment(p.where("target_stop_id % 7 > 0"), p.where("target_stop_id % 5 > 0"), ["sample_id", "part"])


@query("J25", "SELECT sample_id, CASE WHEN target_stop_id % 11 = 0 THEN 'left' ELSE 'right' END AS side FROM f_points WHERE (target_stop_id % 11 = 0) <> (target_stop_id % 13 = 0)")
def unanswered_requests(spark, sf):
    p = D.points(spark, sf).select("sample_id", "target_stop_id")
    asked, answered = p.where("target_stop_id % 13 <> 0"), p.where("target_stop_id % 11 <> 0")
    return J.unmatched(asked, answered, ["sample_id"])


@query(
    "U4",
    """SELECT tr_id, CASE WHEN tr_id % 5 = 0 THEN 'removed' ELSE 'changed' END AS change FROM (SELECT DISTINCT tr_id FROM f_ids)
       WHERE tr_id % 5 = 0 OR tr_id % 3 = 0 OR tr_id % 7 = 0""",
)
def snapshot_diff(spark, sf):
    v = D.vehicles(spark, sf).groupBy("tr_id").agg(F.min("unit_id").alias("unit_id"))
    old = v.where("tr_id % 7 <> 0 OR tr_id % 5 = 0")
    new = v.where("tr_id % 5 <> 0").withColumn("unit_id", F.expr("unit_id + CASE WHEN tr_id % 3 = 0 THEN 1 ELSE 0 END"))
    return L.view_diff(old, new)
