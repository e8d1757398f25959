"""Joins of telemetry, planned visits and arrivals used by stop matching and its evaluation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag import settings as S
from fleetlag.functions import scalars as X
from fleetlag.operators.grid import within
from fleetlag.operators.joins import asof_many
from fleetlag.operators.segments import PLAN_SEGMENT_S, bucket, running


def resolve_ticks(records: DataFrame, vehicles: DataFrame, plan: DataFrame) -> DataFrame:
    """Records with the vehicle resolved (own id first, then by terminal) and ``skip`` naming why
    a record is not matched: ``unknown_vehicle``, ``unplanned`` or ``invalid_location``."""
    known = vehicles.select(F.col("unit_id").alias("__u"), F.col("tr_id").alias("by_unit"))
    planned = plan.select(F.col("tr_id").alias("__p")).distinct()
    spread = F.xxhash64(*records.columns)  # rows without a key go everywhere instead of to one task

    def attached(rows, side, key, other):
        return rows.join(side, (F.coalesce(key, spread) == F.col(other)) & F.col(key).isNotNull(), "left")

    named = attached(records, known, "unit_id", "__u").withColumn("tr_id", F.coalesce("tr_id", "by_unit"))
    joined = attached(named.drop("__u", "by_unit"), planned, "tr_id", "__p").withColumnRenamed("__p", "planned")
    skip = (
        F.when(F.col("tr_id").isNull(), "unknown_vehicle")
        .when(F.col("planned").isNull(), "unplanned")
        .when(~X.has_position("ok", "lat", "lon"), "invalid_location")
    )
    return joined.withColumn("skip", skip).drop("planned")


def planned_only(fixes: DataFrame, plan: DataFrame) -> DataFrame:
    return fixes.join(plan.select("tr_id").distinct(), "tr_id", "left_semi")


def visit_candidates(ticks: DataFrame, plan: DataFrame, settings: dict = S.DETECTOR) -> DataFrame:
    """(tick, visit) pairs: same vehicle, planned within the tolerance, inside the radius."""
    visits = plan.select(
        "tr_id", "stop_id", "t_plan", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")
    )
    tol = settings["visit_time_tolerance_sec"]
    return within(
        visits, ticks, ["tr_id"], F.col("t_plan") - tol, F.col("t_plan") + tol, "t", 2 * tol,
        settings["stop_radius_m"], S.MATCHER_EARTH_RADIUS_M,
    )


def unambiguous_matches(ticks: DataFrame, plan: DataFrame, settings: dict = S.DETECTOR) -> DataFrame:
    """``row_id, stop_id, t_plan`` of ticks with exactly one candidate visit."""
    pairs = visit_candidates(ticks, plan, settings)
    one = pairs.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("stop_id").alias("stop_id"), F.min("t_plan").alias("t_plan")
    )
    return one.where("n = 1").drop("n")


def late_ticks(fixes: DataFrame) -> DataFrame:
    """Fixes in arrival order (``row_id``) with ``late``: not after the vehicle's newest so far."""
    from fleetlag.operators.segments import ID_SEGMENT

    seen = running(
        fixes,
        ["tr_id"],
        ["row_id"],
        [F.expr(f"row_id div {ID_SEGMENT}")],
        {"__newest": ("max", "t")},
        inclusive=False,
    )
    late = F.coalesce(F.col("t") <= F.col("__newest"), F.lit(False))
    return seen.withColumn("late", late).drop("__newest")


def latest_available(samples: DataFrame, events: DataFrame) -> DataFrame:
    """Samples with the newest arrival (by arrival time) known at T by ``available_at``."""
    newest = F.struct("time_fact", "stop_id", "delay_s")
    left = samples.select("tr_id", F.col("T").alias("__t"), F.lit(1).alias("__side"), F.struct(*samples.columns).alias("__l"))
    right = events.select("tr_id", F.col("available_at").alias("__t"), F.lit(0).alias("__side"), newest.alias("__r"))
    both = left.unionByName(right, allowMissingColumns=True)
    tie = F.coalesce("__r.stop_id", F.lit(0))
    out = running(
        both, ["tr_id"], ["__t", "__side", tie], [bucket("__t", PLAN_SEGMENT_S)], {"__m": ("max", F.col("__r"))}
    )
    return out.where("__side = 1").select(
        *[F.col(f"__l.{c}").alias(c) for c in samples.columns],
        F.col("__m.delay_s").alias("estimate_s"),
        F.col("__m.stop_id").alias("last_stop_id"),
        F.col("__m.time_fact").alias("last_time_fact"),
    )


def observed_bounds(fixes: DataFrame) -> DataFrame:
    return fixes.groupBy("tr_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def recall_rows(plan: DataFrame, facts: DataFrame, fixes: DataFrame, events: DataFrame) -> DataFrame:
    """Facts that fall into their vehicle's observed span, with the detected arrival if any."""
    found = events.select("stop_id", F.col("time_fact").alias("t_found"))
    return (
        facts.select("stop_id", "t_fact")
        .join(plan.select("stop_id", "tr_id"), "stop_id")
        .join(observed_bounds(fixes), "tr_id")
        .where(F.col("t_fact").between(F.col("first_t"), F.col("last_t")))
        .join(found, "stop_id", "left")
        .select("stop_id", "tr_id", "t_fact", "t_found", (F.col("t_found") - F.col("t_fact")).alias("error_s"))
    )


def passed_at(samples: DataFrame, events: DataFrame, t: str = "T") -> DataFrame:
    """Samples with the stop the vehicle passed last at or before their time."""
    out = asof_many(
        samples, events, ["tr_id"], t, "time_fact", {"last_passed": F.col("stop_id")}, tie=["stop_id"], width=PLAN_SEGMENT_S
    )
    return out
