"""Forecast targets and what is known of a vehicle at a moment."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag import settings as S
from fleetlag.operators.joins import asof_join, interval_join
from fleetlag.operators.segments import PLAN_SEGMENT_S


def pick_target(moments: DataFrame, plan: DataFrame, t: str = "T") -> DataFrame:
    """Moments that have a stop planned in (T + 10 min, T + 15 min], with the first such stop.

    The five-minute window touches at most two five-minute buckets, so a moment meets a handful of
    stops; the first is kept by a partial aggregate.
    """
    stops = plan.select("tr_id", "stop_id", "t_plan")
    hits = interval_join(
        moments,
        stops,
        ["tr_id"],
        F.col(t) + S.LEAD_MIN_S,
        F.col(t) + S.LEAD_MAX_S,
        "t_plan",
        width=S.LEAD_MAX_S - S.LEAD_MIN_S,
        low_open=True,
    )
    first = F.min(F.struct("t_plan", "stop_id")).alias("__first")
    return (
        hits.groupBy(*moments.columns)
        .agg(first)
        .select(
            *moments.columns,
            F.col("__first.stop_id").alias("target_stop_id"),
            F.col("__first.t_plan").alias("t_target"),
        )
    )


def last_planned(moments: DataFrame, plan: DataFrame, take: dict[str, str], t: str = "T") -> DataFrame:
    """Each moment with columns of the last stop planned at or before it."""
    return asof_join(
        moments, plan, ["tr_id"], t, "t_plan", take, tie=["stop_id"], width=PLAN_SEGMENT_S
    )


def latest_known_delay(moments: DataFrame, events: DataFrame, t: str = "T") -> DataFrame:
    """Each moment with ``cur_dev_s``, the delay at the vehicle's latest arrival up to then."""
    return asof_join(
        moments,
        events,
        ["tr_id"],
        t,
        "time_fact",
        {"cur_dev_s": "delay_s"},
        tie=["stop_id"],
        width=PLAN_SEGMENT_S,
    )


def points_at(plan: DataFrame, moments: DataFrame) -> DataFrame:
    """Points for the given moments: every vehicle that has a target then.

    A stop is the possible target of moments in [t − 900, t − 600), so each stop is matched with
    the few moments of its own five minutes instead of pairing vehicles with all moments.
    """
    from fleetlag.functions import scalars as X

    stops = plan.select("tr_id", "stop_id", "t_plan").withColumn("one", F.lit(1))
    times = moments.select(F.col("T").cast("double").alias("T")).distinct().withColumn("one", F.lit(1))
    pairs = interval_join(
        stops, times, ["one"], F.col("t_plan") - S.LEAD_MAX_S, F.col("t_plan") - S.LEAD_MIN_S, "T",
        width=S.LEAD_MAX_S - S.LEAD_MIN_S,
    ).where(F.col("t_plan") > F.col("T") + S.LEAD_MIN_S)
    first = F.min(F.struct("t_plan", "stop_id")).alias("f")
    return pairs.groupBy("tr_id", "T").agg(first).select(
        X.sample_id("tr_id", "T").alias("sample_id"), "tr_id", "T",
        F.col("f.stop_id").alias("target_stop_id"), F.col("f.t_plan").alias("t_target"),
    )
