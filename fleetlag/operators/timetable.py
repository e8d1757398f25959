"""Timetable structure: position in the day, gaps, trips, distances, runs of points, lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag import settings as S
from fleetlag.functions import scalars as X
from fleetlag.operators.segments import PLAN_SEGMENT_S, bucket, islands, previous, running


def refuse_facts(plan: DataFrame) -> None:
    """Features may only be built from planned data."""
    leaking = [c for c in plan.columns if "fact" in c]
    if leaking:
        raise ValueError(f"plan carries fact columns: {', '.join(leaking)}")


def stop_order(plan: DataFrame, t: str = "t_plan") -> DataFrame:
    """``pos``, the 0-based place of a stop in its vehicle's day."""
    return running(
        plan,
        ["tr_id"],
        [t, "stop_id"],
        [bucket(t, PLAN_SEGMENT_S)],
        {"pos": ("count", None)},
        inclusive=False,
    )


def prepare_plan(plan: DataFrame) -> DataFrame:
    """Add ``pos, gap_s, step_m, trip, seq, trip_len, cum_m, lay_cum_s, key`` to planned stops.

    A trip starts at a vehicle's first stop and after every planned pause of seven minutes or
    more. Two split scans (previous stop, then running trip and distance) and one count per trip.
    """
    order, seg = ["t_plan", "stop_id"], [bucket("t_plan", PLAN_SEGMENT_S)]
    before = running(
        plan,
        ["tr_id"],
        order,
        seg,
        {"pos": ("count", None), "__p": ("last", F.struct("t_plan", "lat", "lon"))},
        inclusive=False,
    )
    steps = (
        before.withColumn("gap_s", F.col("t_plan") - F.col("__p.t_plan"))
        .withColumn(
            "step_m",
            F.coalesce(X.haversine_m("__p.lat", "__p.lon", "lat", "lon"), F.lit(0.0)),
        )
        .withColumn("__start", F.col("gap_s").isNull() | (F.col("gap_s") >= S.LAYOVER_GAP_S))
        .drop("__p")
    )
    scanned = running(
        steps,
        ["tr_id"],
        order,
        seg,
        {
            "trip": ("sum", F.col("__start").cast("long")),
            "cum_m": ("sum", "step_m"),
            "lay_cum_s": (
                "sum",
                F.when(F.col("gap_s") >= S.LAYOVER_GAP_S, F.col("gap_s")).otherwise(0.0),
            ),
            "__first": ("max", F.when(F.col("__start"), F.col("pos"))),
        },
    )
    trips = (
        scanned.withColumn("trip", F.col("trip") - 1)
        .withColumn("seq", F.col("pos") - F.col("__first"))
        .drop("__start", "__first")
    )
    lengths = trips.groupBy("tr_id", "trip").agg(F.count(F.lit(1)).alias("trip_len"))
    return trips.hint("merge").join(lengths, ["tr_id", "trip"]).withColumn("key", X.stop_key("lat", "lon"))


def trip_lines(plan: DataFrame) -> DataFrame:
    """Ordered coordinates of every trip with at least two stops.

    The array of a trip is as long as the trip: it ends at the first seven-minute pause.
    """
    ordered = previous(
        stop_order(plan),
        ["tr_id"],
        ["t_plan", "stop_id"],
        [bucket("t_plan", PLAN_SEGMENT_S)],
        {"__t": "t_plan"},
    )
    cut = F.col("__t").isNull() | (F.col("t_plan") - F.col("__t") >= S.LAYOVER_GAP_S)
    numbered = islands(
        ordered, ["tr_id"], ["t_plan", "stop_id"], [bucket("t_plan", PLAN_SEGMENT_S)], cut, "trip"
    )
    items = F.sort_array(F.collect_list(F.struct("pos", "lon", "lat")))
    return (
        numbered.groupBy("tr_id", "trip")
        .agg(F.count(F.lit(1)).alias("stops"), items.alias("__items"))
        .where("stops >= 2")
        .select(
            "tr_id",
            "trip",
            "stops",
            F.transform("__items", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("line"),
        )
    )


def point_runs(points: DataFrame) -> DataFrame:
    """Number runs of points from 1: same vehicle, same part, no pause above fifteen minutes.

    Runs are numbered per vehicle first; vehicles then get an offset from a scan over one row per
    vehicle, so no step orders all points in one task.
    """
    order = ["T", "sample_id"]
    width = [bucket("T", PLAN_SEGMENT_S)]
    seen = previous(points, ["tr_id"], order, width, {"__T": "T", "__part": "part"})
    starts = (
        F.col("__T").isNull()
        | (F.col("T") - F.col("__T") > S.RUN_GAP_S)
        | ~F.col("part").eqNullSafe(F.col("__part"))
    )
    own = islands(seen, ["tr_id"], order, width, starts, "__run")
    sizes = own.groupBy("tr_id").agg((F.max("__run") + 1).alias("__runs"))
    offsets = running(
        sizes,
        [],
        ["tr_id"],
        [F.expr("tr_id div 4096")],
        {"__before": ("sum", "__runs")},
        inclusive=False,
    ).select("tr_id", F.coalesce("__before", F.lit(0)).alias("__before"))
    return own.join(offsets, "tr_id").select(
        *points.columns, (F.col("__before") + F.col("__run") + 1).cast("long").alias("run")
    )
