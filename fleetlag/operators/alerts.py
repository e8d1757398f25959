"""Alert lifecycle per vehicle and target stop.

A red forecast opens an alert or updates the open one; a forecast below red cancels it; the arrival
at the target confirms it with its lead time; an arrival at a stop planned later cancels it. After
closing, red opens a new one. Only open alerts are state, at most a few per vehicle.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlag.operators.folds import segmented_fold
from fleetlag.operators.matching import passed_at
from fleetlag.operators.segments import bucket

ALERT_SEGMENT_S = 21_600

CHANGES = T.StructType(
    [
        T.StructField("tr_id", T.LongType()),
        T.StructField("target_stop_id", T.LongType()),
        T.StructField("opened_at", T.DoubleType()),
        T.StructField("segment_from_stop_id", T.LongType()),
        T.StructField("changed_at", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("closed_at", T.DoubleType()),
        T.StructField("predicted_delay_s", T.DoubleType()),
        T.StructField("actual_delay_s", T.DoubleType()),
        T.StructField("lead_time_s", T.DoubleType()),
    ]
)


def alert_log(predictions: DataFrame, plan: DataFrame, events: DataFrame) -> DataFrame:
    """Forecasts and arrivals of every vehicle as one log, arrivals first at equal times."""
    targets = plan.select(F.col("stop_id").alias("target_stop_id"), F.col("t_plan").alias("plan_t"))
    told = passed_at(predictions, events, "t").join(targets, "target_stop_id").select(
        "tr_id", "t", F.lit(1).alias("kind"), F.col("target_stop_id").alias("stop_id"), "plan_t",
        "sample_id", (F.col("risk_level") == "red").alias("red"),
        F.col("prediction_s").alias("seconds"), F.col("last_passed").alias("seg_from"),
    )
    return told.unionByName(arrival_log(events))


def arrival_log(events: DataFrame) -> DataFrame:
    """The arrivals' rows of the log."""
    return events.select(
        "tr_id", F.col("time_fact").alias("t"), F.lit(0).alias("kind"), "stop_id",
        F.col("time_plan").alias("plan_t"), F.col("stop_id").cast("string").alias("sample_id"),
        F.lit(False).alias("red"), F.col("delay_s").alias("seconds"),
        F.lit(None).cast("bigint").alias("seg_from"),
    )


def react(alerts: dict, row: dict) -> list[tuple]:
    """Apply one log row to the open ``alerts`` of a vehicle; returns change rows (without tr_id)."""
    stop, now = str(row["stop_id"]), row["t"]
    if row["kind"] == 0:
        out = []
        hit = alerts.pop(stop, None)
        if hit:
            out.append(_change(hit, now, "confirmed", row["seconds"]))
        for key in [k for k, a in alerts.items() if a["plan_t"] < row["plan_t"]]:
            out.append(_change(alerts.pop(key), now, "cancelled"))
        return out
    if not row["red"]:
        hit = alerts.pop(stop, None)
        return [_change(hit, now, "cancelled")] if hit else []
    alert = alerts.setdefault(
        stop,
        {"stop": row["stop_id"], "opened": now, "from": row["seg_from"], "plan_t": row["plan_t"]},
    )
    alert["seconds"] = row["seconds"]
    return [_change(alert, now, "open")]


def _change(a, now, status, actual=None):
    closed = None if status == "open" else now
    lead = now - a["opened"] if status == "confirmed" else None
    return (a["stop"], a["opened"], a["from"], now, status, closed, a["seconds"], actual, lead)


def _alert_step(records, state):
    alerts = state or {}
    out = []
    for row in records:
        out += [(row["tr_id"], *c) for c in react(alerts, row)]
    return out, alerts or None


def current_alerts(changes: DataFrame) -> DataFrame:
    """The newest state of every alert."""
    keys = ["tr_id", "target_stop_id", "opened_at"]
    rest = [c for c in changes.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("changed_at", F.col("closed_at").isNotNull())).alias("c")
    return changes.groupBy(*keys).agg(newest).select(*keys, "c.*")


def alert_lifecycle(
    predictions: DataFrame, plan: DataFrame, events: DataFrame, segment_s: float = ALERT_SEGMENT_S
) -> DataFrame:
    """Alerts of a recorded stream, each in its last state."""
    log = alert_log(predictions, plan, events).withColumn("seg", bucket("t", segment_s))
    changes = segmented_fold(log, ["tr_id"], "seg", ["t", "kind", "sample_id"], _alert_step, CHANGES)
    return current_alerts(changes)
