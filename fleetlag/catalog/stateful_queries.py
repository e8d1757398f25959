"""Sequential state machines run as segmented folds."""

from pyspark.sql import functions as F

from fleetlag.catalog import fleetday as D
from fleetlag.catalog.join_queries import ticks
from fleetlag.catalog.metric_queries import rounded
from fleetlag.catalog.registry import query
from fleetlag.operators import alerts as AL
from fleetlag.operators import clean as C
from fleetlag.operators import detector as DT
from fleetlag.operators import matching as M
from fleetlag.operators.joins import beside
from fleetlag.plans import evaluation as EV
from fleetlag.sources import commits as CO


def _events(spark, sf):
    return DT.detect_stops(C.one_fix_per_time(ticks(spark, sf)), D.plan(spark, sf))


@query("T4 T6")
def detected_stop_events(spark, sf):
    return _events(spark, sf)


def _report(spark, sf):
    """Report row, compared points and recovered events of the matcher."""
    from fleetlag.session import cut_lineage

    events = cut_lineage(_events(spark, sf))
    points = M.latest_available(D.points(spark, sf), events)
    coverage = EV.coverage_report(points.withColumn("reference_s", F.col("cur_dev_s")))
    recall = EV.recall_report(M.recall_rows(D.plan(spark, sf), D.facts(spark, sf), ticks(spark, sf), events))
    names = {c: f"arrival_{c}" for c in recall.columns}
    return rounded(beside(coverage, recall.withColumnsRenamed(names))), points, events


@query("S18 A17 J9")
def matcher_report(spark, sf):
    """Coverage of points and recall of arrivals as one row."""
    return _report(spark, sf)[0]


@query("S18")
def matcher_tables(spark, sf):
    """The three tables of the report, committed together and read back: rows and newest time of each."""
    from fleetlag.session import scratch_path

    root = scratch_path(spark, "matcher")
    CO.write_matcher_report(*_report(spark, sf), root)
    points, events = CO.read_table(spark, root, "points"), CO.read_table(spark, root, "events")
    covered = points.agg(F.count(F.lit(1)).alias("points"), F.count("estimate_s").alias("covered"))
    found = events.agg(F.count(F.lit(1)).alias("events"), F.count_if("recovered").alias("recovered"), F.max("time_fact").alias("newest"))
    return beside(beside(CO.read_table(spark, root, "report"), covered.withColumnRenamed("covered", "covered_points")), found)


@query(
    "T12",
    """SELECT tr_id, stop_id AS target_stop_id, min(t) AS opened_at, closed_at, arg_max(seconds, t) AS predicted_delay_s FROM (
       SELECT p.tr_id, p.target_stop_id AS stop_id, p.t, any_value(p.prediction_s) AS seconds, least(
         (SELECT min(q.t) FROM f_predictions q WHERE q.target_stop_id = p.target_stop_id AND q.risk_level <> 'red' AND q.t > p.t),
         (SELECT min(e.time_fact) FROM f_stop_events e WHERE e.tr_id = p.tr_id AND e.time_fact > p.t AND e.time_plan >= any_value(p.target_time_begin))) AS closed_at
       FROM f_predictions p WHERE p.risk_level = 'red' GROUP BY p.tr_id, p.target_stop_id, p.t) GROUP BY tr_id, stop_id, closed_at""",
)
def alert_lifecycle(spark, sf):
    a = AL.alert_lifecycle(D.predictions(spark, sf), D.plan(spark, sf), D.stop_events(spark, sf))
    return a.select("tr_id", "target_stop_id", "opened_at", "closed_at", "predicted_delay_s")


@query("T12 A13")
def alert_lifecycle_counts(spark, sf):
    from fleetlag.plans.live import alert_counts

    a = AL.alert_lifecycle(D.predictions(spark, sf), D.plan(spark, sf), D.stop_events(spark, sf))
    return rounded(alert_counts(a))
