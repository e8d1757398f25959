"""The 43 features of a forecast point, from the plan and from telemetry up to its moment."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag import settings as S
from fleetlag.functions import scalars as X
from fleetlag.operators.arrivals import known_arrivals
from fleetlag.operators.clean import lose_position
from fleetlag.operators.joins import asof_join, asof_many, interval_join
from fleetlag.operators.segments import PLAN_SEGMENT_S
from fleetlag.operators.timetable import prepare_plan, refuse_facts
from fleetlag.session import cut_all, cut_lineage

POSITION_WIDTH = 16


def with_plan_context(points: DataFrame, prepared: DataFrame) -> DataFrame:
    """Points with ``target`` and ``last`` structs of plan rows and the stop count before T − 30 min.

    The target comes by an equi join, the last planned stop by an as-of scan.
    """
    row = ["pos", "t_plan", "lat", "lon", "trip", "seq", "trip_len", "cum_m", "lay_cum_s", "key"]
    target = prepared.select(F.col("stop_id").alias("target_stop_id"), F.struct(*row).alias("tgt")).hint("merge")
    joined = points.join(target, "target_stop_id")
    last = asof_many(
        joined, prepared, ["tr_id"], "T", "t_plan", {"last": F.struct(*row)}, tie=["stop_id"], width=PLAN_SEGMENT_S
    )
    half_hour = last.withColumn("__half", F.col("T") - 1800)
    early = asof_join(
        half_hour, prepared, ["tr_id"], "__half", "t_plan", {"__early": "pos"},
        tie=["stop_id"], width=PLAN_SEGMENT_S, strict=True,
    )
    return early.withColumn(
        "planned_30m", F.coalesce("last.pos", F.lit(-1)) - F.coalesce("__early", F.lit(-1))
    ).drop("__half", "__early")


def timetable_columns() -> dict:
    """Timetable features over a frame with ``T, tgt, last`` (15 columns)."""
    tgt, last = F.col("tgt"), F.col("last")
    started = last.isNotNull()
    frac = lambda s: s["seq"] / F.greatest(s["trip_len"] - 1, F.lit(1))
    return {
        "lead_s": tgt["t_plan"] - F.col("T"),
        "hour": X.local_hour("T"),
        "since_last_plan_s": F.col("T") - last["t_plan"],
        "stops_ahead": F.when(started, tgt["pos"] - last["pos"]).otherwise(tgt["pos"] + 1),
        "plan_dist_ahead_m": tgt["cum_m"] - last["cum_m"],
        "plan_run_s": tgt["t_plan"] - last["t_plan"],
        "layover_ahead_s": tgt["lay_cum_s"] - F.coalesce(last["lay_cum_s"], F.lit(0.0)),
        "new_trip_ahead": F.when(started, (tgt["trip"] != last["trip"]).cast("double")).otherwise(1.0),
        "last_trip_frac": F.when(started, frac(last)),
        "target_seq": tgt["seq"],
        "target_trip_frac": frac(tgt),
        "trip_stops": tgt["trip_len"],
        "trip_no": tgt["trip"],
        "target_lat": tgt["lat"],
        "target_lon": tgt["lon"],
    }


def recent_fixes(points: DataFrame, telemetry: DataFrame, seconds: float) -> DataFrame:
    """(point, fix) pairs with the fix in [at − seconds, at], where ``at`` is the point's moment,
    after the point's outage if it has one."""
    fixes = telemetry.select("tr_id", "t", "ok", "lat", "lon", "speed")
    asked = points.withColumnRenamed("T", "at")
    pairs = interval_join(asked, fixes, ["tr_id"], F.col("at") - seconds, F.col("at"), "t", width=seconds)
    return lose_position(pairs) if "gap_s" in points.columns else pairs


def with_last_fixes(points: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Points with ``fix`` (last usable), ``spoke_t`` (last usable with a speed) and ``moved_t``
    (last moving), each no older than the history. One scan over points and fixes."""
    has_speed = F.col("ok") & F.col("speed").isNotNull()
    found = asof_many(
        points,
        telemetry,
        ["tr_id"],
        "T_cut",
        "t",
        {
            "fix": F.when(F.col("ok"), F.struct("t", "lat", "lon")),
            "spoke_t": F.when(has_speed, F.col("t")),
            "moved_t": F.when(has_speed & (F.col("speed") >= S.MOVING_KMH), F.col("t")),
        },
        tie=["row_id"],
    )
    oldest = F.col("T") - S.HISTORY_S
    return found.withColumns(
        {
            "fix": F.when(F.col("fix.t") >= oldest, F.col("fix")),
            "spoke_t": F.when(F.col("spoke_t") >= oldest, F.col("spoke_t")),
            "moved_t": F.when(F.col("moved_t") >= oldest, F.col("moved_t")),
        }
    )


def route_positions(points: DataFrame, prepared: DataFrame) -> DataFrame:
    """``sample_id, near, near_last``: the stop nearest to the last fix among the six before the
    last planned one up to the target, and up to the stop after the last planned one."""
    last = F.coalesce("last.pos", F.lit(-1))
    asked = points.where(F.col("fix").isNotNull()).select(
        "sample_id", "tr_id", "fix", last.alias("last_pos"), F.col("tgt.pos").alias("target_pos")
    )
    stops = prepared.select("tr_id", "pos", "lat", "lon", "cum_m")
    pairs = interval_join(
        asked, stops, ["tr_id"], F.greatest(F.col("last_pos") - S.ROUTE_LOOKBACK, F.lit(0)),
        F.col("target_pos"), "pos", width=POSITION_WIDTH,
    )
    # whole micrometres first, so that equal distances tie and the first stop wins everywhere
    d = X.haversine_m("lat", "lon", "fix.lat", "fix.lon")
    spot = F.struct(F.round(d, 6).alias("rank"), "pos", d.alias("d"), "cum_m")
    return pairs.groupBy("sample_id").agg(
        F.min(spot).alias("near"),
        F.min(F.when(F.col("pos") <= F.col("last_pos") + 1, spot)).alias("near_last"),
    )


def motion_aggregates(pairs: DataFrame) -> DataFrame:
    """Per-point counts and speed figures over (point, fix) pairs of the last fifteen minutes."""
    talks = F.col("ok") & F.col("speed").isNotNull()
    within = lambda m: F.col("t") >= F.col("at") - 60 * m
    speed = lambda m: F.when(talks & within(m), F.col("speed"))
    return pairs.groupBy("sample_id").agg(
        F.count(F.lit(1)).cast("double").alias("fixes_15m"),
        F.avg(F.col("ok").cast("double")).alias("ok_share_15m"),
        F.avg(speed(5)).alias("speed_mean_5m"),
        F.avg(speed(15)).alias("speed_mean_15m"),
        F.max(speed(5)).alias("speed_max_5m"),
        F.avg((speed(10) < S.MOVING_KMH).cast("double")).alias("stopped_share_10m"),
    )


def motion_columns() -> dict:
    """Motion features over a frame with ``fix, spoke_t, moved_t, near, tgt`` and the aggregates."""
    fix, tgt, near, t = F.col("fix"), F.col("tgt"), F.col("near"), F.col("T")
    ahead = tgt["cum_m"] - near["cum_m"]
    pace = F.greatest(F.col("speed_mean_15m") / 3.6, F.lit(S.MIN_SPEED_MS))
    eta = t + ahead / pace - tgt["t_plan"]
    return {
        "tel_age_s": t - fix["t"],
        "fixes_15m": F.coalesce("fixes_15m", F.lit(0.0)),
        "ok_share_15m": F.col("ok_share_15m"),
        "speed_mean_5m": F.col("speed_mean_5m"),
        "speed_mean_15m": F.col("speed_mean_15m"),
        "speed_max_5m": F.col("speed_max_5m"),
        "stopped_share_10m": F.col("stopped_share_10m"),
        "standing_s": F.when(F.col("moved_t").isNotNull(), t - F.col("moved_t")).when(
            F.col("spoke_t").isNotNull(), float(S.HISTORY_S)
        ),
        "dist_to_target_m": X.haversine_m(fix["lat"], fix["lon"], tgt["lat"], tgt["lon"]),
        "route_offset_m": near["d"],
        "gps_dist_ahead_m": ahead,
        "gps_stops_ahead": tgt["pos"] - near["pos"],
        "eta_dev_s": F.when(F.col("speed_mean_15m").isNotNull(), X.clip(eta, -1800.0, 1800.0)),
    }


def _last(items):
    return F.when(F.size(items) > 0, F.element_at(items, -1))


def _mean_of_last3(items, value):
    tail = F.slice(items, F.greatest(F.size(items) - 2, F.lit(1)), 3)
    total = F.aggregate(tail, F.lit(0.0), lambda acc, x: acc + value(x))
    return F.when(F.size(items) > 0, total / F.size(tail))


def _delay(x):
    return x["t_arr"] - x["t_plan"]


def with_history_columns(df: DataFrame) -> DataFrame:
    """Arrival-history features over a frame with ``known, near, tgt, planned_30m, T``.

    Stops beyond the vehicle's position cannot have been reached; matches there are dropped.
    """
    t, tgt = F.col("T"), F.col("tgt")
    seen = F.when(
        F.col("near").isNotNull(), F.filter("known", lambda x: x["pos"] <= F.col("near.pos"))
    )
    df = df.withColumn("seen", seen)
    df = df.withColumn("k", _last(F.col("seen")))
    df = df.withColumn(
        "loop",
        _last(
            F.filter(
                "seen",
                lambda x: (x["key"] == tgt["key"]) & (x["t_plan"] <= tgt["t_plan"] - S.LOOP_MIN_S),
            )
        ),
    )
    df = df.withColumn(
        "ref",
        _last(
            F.filter(
                "seen", lambda x: (x["pos"] < F.col("loop.pos")) & (x["key"] == F.col("k.key"))
            )
        ),
    )
    k, loop = F.col("k"), F.col("loop")
    sixth = F.element_at("seen", F.greatest(F.size("seen") - 5, F.lit(1)))
    lately = F.filter("seen", lambda x: x["t_plan"].between(t - 1800, t))
    overdue = t - k["t_next"]
    return df.withColumns(
        {
            "gps_dev_last_s": _delay(k),
            "gps_dev_age_s": t - k["t_arr"],
            "gps_dev_mean3_s": _mean_of_last3(F.col("seen"), _delay),
            "gps_dev_trend_s": F.when(k.isNotNull(), _delay(k) - _delay(sixth)),
            "gps_overdue_s": overdue,
            "gps_dev_now_s": F.when(overdue.isNotNull(), F.greatest(_delay(k), overdue)),
            "gps_found_share": F.when(
                F.col("seen").isNotNull() & (F.col("planned_30m") > 0),
                F.size(lately) / F.col("planned_30m"),
            ),
            "dwell_last_s": k["dwell_s"],
            "dwell_mean3_s": _mean_of_last3(F.col("seen"), lambda x: x["dwell_s"]),
            "prev_loop_dev_s": _delay(loop),
            "prev_loop_age_s": t - loop["t_arr"],
            "prev_loop_gain_s": _delay(loop) - _delay(F.col("ref")),
        }
    )


def recent_delays(points: DataFrame, events: DataFrame, history_s: float = S.HISTORY_S) -> DataFrame:
    """``sample_id, last_s, mean3_s, trend_s`` from the arrivals up to T within the history.

    The array of a point is bounded by the arrivals of its history window.
    """
    asked = points.select("sample_id", "tr_id", "T")
    facts = events.select("tr_id", "time_fact", "stop_id", "delay_s")
    pairs = interval_join(
        asked, facts, ["tr_id"], F.col("T") - history_s, F.col("T"), "time_fact", width=history_s / 2
    )
    seen = F.sort_array(F.collect_list(F.struct("time_fact", "stop_id", "delay_s"))).alias("seen")
    sixth = F.element_at("seen", F.greatest(F.size("seen") - 5, F.lit(1)))
    newest = F.element_at("seen", -1)
    return pairs.groupBy("sample_id").agg(seen).select(
        "sample_id",
        newest["delay_s"].alias("last_s"),
        _mean_of_last3(F.col("seen"), lambda x: x["delay_s"]).alias("mean3_s"),
        (newest["delay_s"] - sixth["delay_s"]).alias("trend_s"),
    )


def gps_delay():
    """Current deviation from GPS alone, over a frame with ``known, last, near_last, fix, T``."""
    t, last = F.col("T"), F.col("last")
    place = F.col("near_last.pos")
    seen = F.filter("known", lambda x: (x["pos"] <= last["pos"]) & (x["pos"] <= place))
    k = _last(seen)
    last_seen = F.coalesce(_delay(k), F.lit(0.0))
    overdue = F.least(t - last["t_plan"], F.lit(float(S.MAX_OVERDUE_S)))
    at_last = k["pos"] == last["pos"]
    return F.when(
        last.isNotNull() & place.isNotNull() & (last["t_plan"] >= t - S.HISTORY_S),
        F.when(F.coalesce(at_last, F.lit(False)) | (place >= last["pos"]), last_seen).otherwise(
            F.greatest(last_seen, overdue)
        ),
    )


def build_features(points: DataFrame, plan: DataFrame, telemetry: DataFrame, hint: str = "given") -> DataFrame:
    """One row of features per point.

    ``hint="given"`` keeps the point's ``cur_dev_s``, ``"gps"`` replaces it by the estimate the
    live stream would have. Points with ``gap_s, outage`` lose their position ``gap_s`` before T.
    Every join cuts telemetry at T, so later fixes cannot reach a feature.
    """
    refuse_facts(plan)
    if hint not in ("given", "gps"):
        raise ValueError(f"hint must be 'given' or 'gps', got {hint!r}")
    outage = ["gap_s", "outage"] if "gap_s" in points.columns else []
    cut = F.col("T")
    if outage:
        lost = F.coalesce(F.col("outage").isin(*S.OUTAGE_KINDS), F.lit(False))
        cut = F.when(lost, F.col("T") - F.col("gap_s")).otherwise(F.col("T"))
    # Each of these feeds several scans and joins: written once, read pruned.
    prepared, telemetry, points = cut_all(
        prepare_plan(plan.select("stop_id", "tr_id", "t_plan", "lat", "lon")),
        telemetry.select("tr_id", "t", "ok", "lat", "lon", "speed", "row_id"),
        points.withColumn("T_cut", cut),
    )
    context, fixes = cut_all(
        with_plan_context(points, prepared),
        with_last_fixes(points.select("sample_id", "tr_id", "T", "T_cut"), telemetry),
    )
    base = context.hint("merge").join(fixes.select("sample_id", "fix", "spoke_t", "moved_t"), "sample_id")
    slim = context.select("sample_id", "tr_id", "T", *outage)
    known = known_arrivals(
        context.select("sample_id", "tr_id", "T", "T_cut", F.col("tgt.pos").alias("target_pos")),
        prepared,
        telemetry,
    )
    full = (
        base.hint("merge").join(motion_aggregates(recent_fixes(slim, telemetry, 900.0)), "sample_id", "left")
        .hint("merge").join(route_positions(base, prepared), "sample_id", "left")
        .hint("merge").join(known, "sample_id", "left")
    )
    if hint == "gps":
        full = full.withColumn("cur_dev_s", gps_delay())
    full = full.withColumns({**timetable_columns(), **motion_columns()})
    full = with_history_columns(full)
    cur = F.col("cur_dev_s")
    full = full.withColumn(
        "layover_slack_s",
        F.when(
            (F.col("layover_ahead_s") > 0) & cur.isNotNull(),
            F.col("layover_ahead_s") - F.greatest(cur, F.lit(0.0)),
        ),
    ).withColumn("gps_minus_cur_s", F.col("gps_dev_last_s") - cur)
    meta = ["sample_id", "tr_id", "part", "T", "target"]
    return full.select(
        *meta,
        X.is_synthetic("tr_id").alias("synthetic"),
        *outage,
        *[F.col(f).cast("double").alias(f) for f in S.FEATURES],
    )


def timetable_features(points: DataFrame, plan: DataFrame) -> DataFrame:
    """Only the timetable features, for work that needs no telemetry."""
    base = with_plan_context(points, cut_lineage(prepare_plan(plan)))
    columns = timetable_columns()
    return base.select(*points.columns, *[c.cast("double").alias(n) for n, c in columns.items()])
