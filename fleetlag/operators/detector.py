"""Stop detector for the live stream and its batch twin.

Geometry is done in columns: every tick gets the visits planned around it that are within the
radius. What stays sequential is a small state machine per vehicle, shared by the batch fold and
the streaming processor.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlag import settings as S
from fleetlag.functions import scalars as X
from fleetlag.operators.folds import segmented_fold
from fleetlag.operators.segments import bucket

DETECT_SEGMENT_S = 86_400

EVENTS = T.StructType(
    [
        T.StructField("tr_id", T.LongType()),
        T.StructField("stop_id", T.LongType()),
        T.StructField("time_plan", T.DoubleType()),
        T.StructField("time_fact", T.DoubleType()),
        T.StructField("available_at", T.DoubleType()),
        T.StructField("departure", T.DoubleType()),
        T.StructField("recovered", T.BooleanType()),
    ]
)


def check_settings(settings: dict) -> dict:
    for name, value in settings.items():
        if not math.isfinite(value) or value <= 0:
            raise ValueError(f"detector setting {name} must be finite and positive, got {value}")
    return settings


def visits_by_bucket(plan: DataFrame, settings: dict) -> DataFrame:
    """Per (vehicle, time bucket) the visits a tick of that bucket may match, as a short array.

    A visit is placed in every bucket its tolerance touches (at most three), so a tick needs one
    equi join and no grouping afterwards.
    """
    tol = settings["visit_time_tolerance_sec"]
    spread = F.sequence(bucket(F.col("t_plan") - tol, 2 * tol), bucket(F.col("t_plan") + tol, 2 * tol))
    return (
        plan.select("tr_id", F.struct("t_plan", "stop_id", "lat", "lon").alias("v"), F.explode(spread).alias("__b"))
        .groupBy("tr_id", "__b")
        .agg(F.sort_array(F.collect_list("v")).alias("visits"))
    )


def with_candidates(ticks: DataFrame, plan: DataFrame, settings: dict = S.DETECTOR) -> DataFrame:
    """Ticks (``tr_id, t, ok, lat, lon, speed``, and ``position`` if they have one) with ``near``: visits within time
    and radius."""
    tol, radius = settings["visit_time_tolerance_sec"], settings["stop_radius_m"]
    joined = ticks.withColumn("__b", bucket("t", 2 * tol)).join(
        visits_by_bucket(plan, settings), ["tr_id", "__b"], "left"
    )

    def close(v):
        d = X.haversine_m("lat", "lon", v["lat"], v["lon"], S.MATCHER_EARTH_RADIUS_M)
        return (F.abs(v["t_plan"] - F.col("t")) <= tol) & (d <= radius)

    near = F.when(F.col("ok") & F.col("lat").isNotNull(), F.filter("visits", close))
    kept = [c for c in ("position",) if c in ticks.columns]
    return joined.select("tr_id", "t", "ok", "lat", "lon", "speed", *kept, near.alias("near"))


def _metres(tick, stop) -> float:
    a1, a2 = math.radians(tick["lat"]), math.radians(stop["lat"])
    h = math.sin((a2 - a1) / 2) ** 2
    h += math.cos(a1) * math.cos(a2) * math.sin(math.radians(stop["lon"] - tick["lon"]) / 2) ** 2
    return 2 * S.MATCHER_EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, h)))


def new_state() -> dict:
    return {"last": None, "valid": None, "passed": {}, "visit": None, "late": 0}


def feed(state: dict, tick: dict, settings: dict) -> list[tuple]:
    """Advance one vehicle's ``state`` by a tick; returns the emitted event rows (without tr_id).

    An event appears at the arrival and again when its departure becomes known. ``passed`` holds
    per planned day the last visit done; ``visit`` is the one the vehicle is at.
    """
    at = tick["t"]
    if state["last"] is not None and at <= state["last"]:
        state["late"] += 1
        return []
    state["last"] = at
    if not tick["ok"] or tick["lat"] is None or tick["lon"] is None:
        return []
    before, state["valid"] = state["valid"], at
    slow = tick["speed"] is not None and tick["speed"] < settings["stopped_speed_kmh"]
    out = []
    visit = state["visit"]
    if visit and before is not None and at - before > settings["stale_after_sec"]:
        if visit["arrived"] is not None:
            _pass(state, visit)
        visit = state["visit"] = None
    if visit:
        gap = _metres(tick, visit)
        if gap <= settings["stop_radius_m"]:
            if gap < visit["closest"]:
                visit["closest"], visit["closest_at"] = gap, at
            if visit["arrived"] is None and slow:
                visit["arrived"] = at
                out.append(_event(visit, at, at, None, False))
            return out
        if visit["arrived"] is None:
            when = visit["closest_at"]
            out.append(_event(visit, when, at, when, True))
        else:
            out.append(_event(visit, visit["arrived"], visit["arrived"], at, False))
        _pass(state, visit)
        state["visit"] = None
    fresh = [v for v in tick["near"] or [] if _order(v) > _passed(state, v)]
    if len(fresh) == 1:
        v = fresh[0]
        visit = {k: v[k] for k in ("stop_id", "t_plan", "lat", "lon")}
        visit.update(closest=_metres(tick, v), closest_at=at, arrived=at if slow else None)
        state["visit"] = visit
        if slow:
            out.append(_event(visit, at, at, None, False))
    return out


def _order(v):
    return [v["t_plan"], v["stop_id"]]


def _day(v) -> str:
    return str(int(v["t_plan"] // 86400))


def _passed(state, v):
    return state["passed"].get(_day(v), [float("-inf"), 0])


def _pass(state, visit):
    state["passed"][_day(visit)] = _order(visit)


def _event(visit, arrival, available, departure, recovered):
    return (visit["stop_id"], visit["t_plan"], arrival, available, departure, recovered)


def forget_old(state: dict, settings: dict) -> dict:
    """Drop passed visits too old to matter: a later tick cannot match anything planned before
    its time minus the tolerance."""
    if state["last"] is not None:
        edge = state["last"] - settings["visit_time_tolerance_sec"]
        state["passed"] = {d: p for d, p in state["passed"].items() if p[0] >= edge}
    return state


def _detect_step(settings):
    def step(records, state):
        state = state or new_state()
        out = []
        for tick in records:
            out += [(tick["tr_id"], *e) for e in feed(state, tick, settings)]
        state["late"] = 0
        return out, forget_old(state, settings)

    return step


def matters_until(settings):
    """The last time at which a state can still influence a tick.

    A visit lives on while valid ticks follow within the stale gap; a passed visit only hides visits
    planned up to its own time, which no tick later than that plus the tolerance can match.
    """
    tol, stale = settings["visit_time_tolerance_sec"], settings["stale_after_sec"]

    def until(state):
        ends = [p[0] + tol for p in state["passed"].values()]
        if state["visit"]:
            ends += [state["valid"] + stale, state["visit"]["t_plan"] + tol]
        return max(ends, default=float("-inf"))

    return until


def merge_event_log(log: DataFrame) -> DataFrame:
    """One row per visit from the arrival and departure rows, with the delay."""
    merged = log.groupBy("tr_id", "stop_id", "time_plan").agg(
        F.min("time_fact").alias("time_fact"),
        F.min("available_at").alias("available_at"),
        F.max("departure").alias("departure"),
        F.max("recovered").alias("recovered"),
    )
    return merged.withColumn("delay_s", F.col("time_fact") - F.col("time_plan"))


def detect_stops(
    ticks: DataFrame, plan: DataFrame, settings: dict = S.DETECTOR, segment_s: float = DETECT_SEGMENT_S
) -> DataFrame:
    """Stop events of a recorded stream: one tick per (vehicle, time), folded in time order."""
    check_settings(settings)
    rows = with_candidates(ticks, plan, settings).withColumn("seg", bucket("t", segment_s))
    log = segmented_fold(rows, ["tr_id"], "seg", ["t"], _detect_step(settings), EVENTS, matters_until(settings))
    return merge_event_log(log)
