"""Live scoring, forecast verification, alerts and dispatcher views as batch jobs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag import settings as S
from fleetlag.functions import scalars as X
from fleetlag.operators.grid import nearest
from fleetlag.operators.joins import beside, interval_join
from fleetlag.operators.segments import ID_SEGMENT, PLAN_SEGMENT_S, bucket, previous, running
from fleetlag.plans.targets import latest_known_delay, pick_target

# --- clock and window ------------------------------------------------------------------------


def running_clock(records: DataFrame, order: str = "row_id") -> DataFrame:
    """Records in arrival order with ``clock``, the newest event time so far over the whole fleet."""
    return running(
        records, [], [order], [F.expr(f"{order} div {ID_SEGMENT}")], {"clock": ("max", "t")}
    )


def clock_jumps(records: DataFrame, order: str = "row_id", window_s: float = S.TELEMETRY_WINDOW_S) -> DataFrame:
    """Records that advance the clock by more than the window at once."""
    seg = [F.expr(f"{order} div {ID_SEGMENT}")]
    before = running(records, [], [order], seg, {"clock_before": ("max", "t")}, inclusive=False)
    return before.where(F.col("t") - F.col("clock_before") > window_s)


def in_window(records: DataFrame, clock: float, window_s: float = S.TELEMETRY_WINDOW_S) -> DataFrame:
    """Points of known vehicles not older than the window, which keeps its edge."""
    return records.where(F.col("tr_id").isNotNull() & (F.col("t") >= clock - window_s))


def clock_of(records: DataFrame) -> DataFrame:
    """One row with the event clock and the first event time; records without a vehicle count."""
    return records.agg(F.max("t").alias("clock"), F.min("t").alias("observed_since"))


def history_for_recovery(records: DataFrame, window_s: float = S.TELEMETRY_WINDOW_S) -> DataFrame:
    """What a restart has to read: from the newest delivery (``row_id``) back to the first record
    older than the window before the newest time read so far, that record included."""
    back = running(
        records.withColumn("__back", -F.col("row_id")), [], ["__back"],
        [bucket("__back", ID_SEGMENT)], {"__clock": ("max", "t")},
    )
    old = F.col("t") < F.col("__clock") - window_s
    edge = back.where(old).agg(F.max("row_id")).scalar()
    return records.where(edge.isNull() | (F.col("row_id") >= edge))


def warming_up(observed_since, t, window_s: float = S.TELEMETRY_WINDOW_S):
    return X.col(observed_since).isNull() | (X.col(observed_since) > X.col(t) - window_s)


def last_event_per_stop(events: DataFrame, order: str = "row_id") -> DataFrame:
    """A repeated event for a stop replaces the earlier one."""
    rest = [c for c in events.columns if c not in ("tr_id", "stop_id")]
    newest = F.max_by(F.struct(*rest), F.col(order)).alias("__e")
    return events.groupBy("tr_id", "stop_id").agg(newest).select("tr_id", "stop_id", "__e.*")


# --- requests and scoring --------------------------------------------------------------------


def last_seen(records: DataFrame, t: float) -> DataFrame:
    """Per vehicle the newest event time in the window that ends at ``t``."""
    held = in_window(records, t).where(F.col("t") <= t)
    return held.groupBy("tr_id").agg(F.max("t").alias("last_t"))


def candidates_at(records: DataFrame, plan: DataFrame, events: DataFrame, t: float) -> DataFrame:
    """Vehicles to score at ``t``: heard from within fifteen minutes and with a target stop."""
    seen = last_seen(records, t).where(F.lit(t) - F.col("last_t") <= S.DROP_AFTER_S)
    asked = seen.withColumn("T", F.lit(float(t)))
    hits = pick_target(asked, plan)
    # one vehicle has one moment here, so the newest arrival is a plain aggregate
    known = events.where(F.col("time_fact") <= t).groupBy("tr_id").agg(
        F.max_by("delay_s", F.struct("time_fact", "stop_id")).alias("cur_dev_s")
    )
    return hits.join(known, "tr_id", "left").select(
        X.sample_id("tr_id", "T").alias("sample_id"),
        "tr_id",
        "T",
        "target_stop_id",
        "t_target",
        "cur_dev_s",
        (F.lit(t) - F.col("last_t") > S.STALE_AFTER_S).alias("stale"),
    )


def fallback_forecast(df: DataFrame) -> DataFrame:
    """The current deviation persists; zero when unknown."""
    return df.withColumns(
        {
            "prediction_s": F.coalesce("cur_dev_s", F.lit(0.0)),
            "p_late": F.lit(None).cast("double"),
            "reasons": F.array(F.lit("unknown")),
        }
    )


def prediction_rows(scored: DataFrame) -> DataFrame:
    """Rows to store. ``scored`` has the request, the answer and ``fallback, stale, warming_up``."""
    reason = X.degraded_reason("fallback", "stale", "warming_up")
    return scored.select(
        "sample_id",
        "tr_id",
        F.col("T").alias("t"),
        "target_stop_id",
        F.col("t_target").alias("target_time_begin"),
        "cur_dev_s",
        "prediction_s",
        "p_late",
        X.with_stale_code("reasons", "stale").alias("reasons"),
        X.risk_level("prediction_s").alias("risk_level"),
        reason.isNotNull().alias("degraded"),
        reason.alias("degraded_reason"),
        "model_version",
        F.lit(None).cast("double").alias("actual_delay_s"),
        F.lit(None).cast("double").alias("abs_error_s"),
    )


def score_at(records: DataFrame, plan: DataFrame, events: DataFrame, t: float, forecast=None) -> DataFrame:
    """Prediction rows of one tick. ``forecast(candidates)`` answers with ``sample_id,
    prediction_s, p_late, reasons, model_version``; unanswered rows get the fallback."""
    asked = candidates_at(records, plan, events, t)
    asked = beside(asked, records.agg(F.min("t").alias("__since")))
    asked = asked.withColumn("warming_up", warming_up("__since", "T")).drop("__since")
    plain = fallback_forecast(asked)
    if forecast is None:
        scored = plain.withColumns({"fallback": F.lit(True), "model_version": F.lit("fallback")})
        return prediction_rows(scored)
    answers = forecast(asked).select("sample_id", F.struct("prediction_s", "p_late", "reasons", "model_version").alias("a"))
    both = plain.join(answers, "sample_id", "left")
    missing = F.col("a").isNull()
    scored = both.withColumns(
        {
            "fallback": missing,
            "prediction_s": F.coalesce("a.prediction_s", "prediction_s"),
            "p_late": F.col("a.p_late"),
            "reasons": F.coalesce("a.reasons", "reasons"),
            "model_version": F.coalesce("a.model_version", F.lit("fallback")),
        }
    )
    return prediction_rows(scored)


def requests(
    points: DataFrame,
    plan: DataFrame,
    records: DataFrame,
    events: DataFrame,
    window_s: float = S.TELEMETRY_WINDOW_S,
    back_s: float = S.SCHEDULE_BACK_S,
) -> DataFrame:
    """Self-contained requests: the point with its telemetry window and the timetable around it,
    nothing after T. Both arrays are bounded by their time windows."""
    asked = points.select("sample_id", "tr_id", "T", "target_stop_id", "t_target", "cur_dev_s")
    key = asked.select("sample_id", "tr_id", "T", "t_target")
    fixes = records.select(
        "tr_id", F.struct("t", "row_id", "lat", "lon", F.col("ok").alias("location_valid"), F.col("speed").alias("speed_kmh")).alias("fix"), F.col("t").alias("__t")
    )
    heard = interval_join(key, fixes, ["tr_id"], F.col("T") - window_s, F.col("T"), "__t", width=window_s)
    heard = heard.groupBy("sample_id").agg(F.sort_array(F.collect_list("fix")).alias("telemetry"))
    stops = plan.select("tr_id", "stop_id", F.col("t_plan").alias("time_plan"), "lat", "lon")
    ahead = interval_join(
        key, stops, ["tr_id"], F.col("T") - back_s, F.col("t_target"), "time_plan", width=PLAN_SEGMENT_S
    )
    facts = events.select("stop_id", "time_fact")
    ahead = ahead.join(facts, "stop_id", "left").withColumn(
        "time_fact", F.when(F.col("time_fact") <= F.col("T"), F.col("time_fact"))
    )
    ahead = ahead.groupBy("sample_id").agg(
        F.sort_array(F.collect_list(F.struct("time_plan", "stop_id", "lat", "lon", "time_fact"))).alias("schedule")
    )
    return asked.join(heard, "sample_id", "left").join(ahead, "sample_id", "left")


# --- verification ----------------------------------------------------------------------------


def check_predictions(predictions: DataFrame, events: DataFrame) -> DataFrame:
    """Predictions with the fact of their target stop; ``changed`` marks rows it altered."""
    facts = events.select(F.col("stop_id").alias("target_stop_id"), F.col("delay_s").alias("__d"))
    joined = predictions.join(facts, "target_stop_id", "left")
    new = F.col("__d").isNotNull() & ~F.col("__d").eqNullSafe(F.col("actual_delay_s"))
    error = F.abs(F.col("prediction_s") - F.col("__d"))
    return joined.select(
        *[c for c in predictions.columns if c not in ("actual_delay_s", "abs_error_s")],
        F.when(new, F.col("__d")).otherwise(F.col("actual_delay_s")).alias("actual_delay_s"),
        F.when(new, error).otherwise(F.col("abs_error_s")).alias("abs_error_s"),
        new.alias("changed"),
    )


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.avg("abs_error_s").alias("mae_s"), F.count("abs_error_s").alias("checked")
    )


def confirm_alerts(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Open alerts whose target stop was reached, confirmed with their lead time."""
    facts = events.select("tr_id", F.col("stop_id").alias("target_stop_id"), "time_fact", "delay_s")
    return alerts.where("status = 'open'").join(facts, ["tr_id", "target_stop_id"]).select(
        "id", "tr_id", "target_stop_id", F.lit("confirmed").alias("status"), "opened_at",
        F.col("time_fact").alias("closed_at"), F.col("delay_s").alias("actual_delay_s"),
        (F.col("time_fact") - F.col("opened_at")).alias("lead_time_s"),
    )


def close_passed_alerts(alerts: DataFrame, plan: DataFrame, events: DataFrame) -> DataFrame:
    """Open alerts whose vehicle arrived at a stop planned after the target, cancelled at the
    earliest such arrival.

    The earliest arrival over all later-planned stops is a running minimum from the end of the
    timetable, so no (alert, later stop) pairs are formed.
    """
    targets = plan.select(F.col("stop_id").alias("target_stop_id"), F.col("t_plan").alias("__p"))
    left = alerts.where("status = 'open'").join(targets, "target_stop_id")
    cols = [c for c in left.columns if c != "__p"]
    a = left.select("tr_id", (-F.col("__p")).alias("__t"), F.lit(0).alias("__side"), F.col("id").alias("__n"), F.struct(*cols).alias("__l"))
    e = events.select("tr_id", (-F.col("time_plan")).alias("__t"), F.lit(1).alias("__side"), F.col("stop_id").alias("__n"), "time_fact")
    out = running(
        a.unionByName(e, allowMissingColumns=True), ["tr_id"], ["__t", "__side", "__n"],
        [bucket("__t", PLAN_SEGMENT_S)], {"closed_at": ("min", "time_fact")},
    )
    return out.where((F.col("__side") == 0) & F.col("closed_at").isNotNull()).select(
        *[F.col(f"__l.{c}").alias(c) for c in cols if c not in ("status", "closed_at")],
        F.lit("cancelled").alias("status"),
        "closed_at",
    )


# --- views -----------------------------------------------------------------------------------


def latest_predictions(predictions: DataFrame, since: float | None = None) -> DataFrame:
    """The newest prediction per vehicle (a later one wins at equal times): one aggregate."""
    rows = predictions if since is None else predictions.where(F.col("t") >= since)
    newest = F.max_by(F.struct(*rows.columns), F.struct("t", "sample_id")).alias("__r")
    return rows.groupBy("tr_id").agg(newest).select("__r.*")


def current_predictions(predictions: DataFrame, events: DataFrame, seen: DataFrame, clock: float) -> DataFrame:
    """Newest predictions that still apply: target not passed and vehicle not offline."""
    live = seen.where(F.lit(clock) - F.col("last_t") <= S.DROP_AFTER_S).select("tr_id")
    passed = events.select("tr_id", F.col("stop_id").alias("target_stop_id"))
    return (
        latest_predictions(predictions)
        .join(live, "tr_id", "left_semi")
        .join(passed, ["tr_id", "target_stop_id"], "left_anti")
    )


def vehicle_states(records: DataFrame, clock: float) -> DataFrame:
    """Last point and last valid position of each vehicle in the window."""
    order = F.struct("t", "row_id")
    placed = X.has_position("ok", "lat", "lon")
    held = in_window(records, clock).where(F.col("t") <= clock)
    states = held.groupBy("tr_id").agg(
        F.max_by(F.struct("unit_id", "t"), order).alias("p"),
        F.max_by(F.struct("lat", "lon", "speed"), F.when(placed, order)).alias("f"),
    )
    return states.select(
        "tr_id", "p.unit_id", "f.lat", "f.lon", F.col("f.speed").alias("speed_kmh"),
        F.col("p.t").alias("last_t"), X.freshness("p.t", F.lit(float(clock))).alias("freshness"),
    )


def with_address(predictions: DataFrame, plan: DataFrame) -> DataFrame:
    """Predictions with the address of the target stop."""
    names = plan.select(F.col("stop_id").alias("target_stop_id"), F.col("address").alias("target_address"))
    return predictions.join(names, "target_stop_id", "left")


PREDICTION_VIEW = [
    "sample_id", "t", "target_stop_id", "target_address", "target_time_begin", "prediction_s",
    "risk_level", "model_version",
]


def fleet_snapshot(records, predictions, events, plan, clock: float) -> DataFrame:
    """One row per vehicle in the window with its current prediction as a struct."""
    states = vehicle_states(records, clock)
    current = with_address(current_predictions(predictions, events, states, clock), plan)
    view = current.select("tr_id", F.struct(*PREDICTION_VIEW).alias("prediction"))
    return states.join(view, "tr_id", "left")


def fleet_summary(snapshot: DataFrame) -> DataFrame:
    """Vehicles per risk level and per freshness."""
    risk = F.coalesce("prediction.risk_level", F.lit("none"))
    return snapshot.agg(
        *[F.count_if(risk == r).alias(f"risk_{r}") for r in ("green", "yellow", "red", "none")],
        *[F.count_if(F.col("freshness") == f).alias(f) for f in ("active", "stale", "offline")],
    )


def view_diff(published: DataFrame, current: DataFrame) -> DataFrame:
    """``tr_id, change``: ``changed`` (new or different) and ``removed`` vehicles."""
    old = published.select("tr_id", F.struct(*[c for c in published.columns if c != "tr_id"]).alias("o"))
    new = current.select("tr_id", F.struct(*[c for c in published.columns if c != "tr_id"]).alias("n"))
    both = old.join(new, "tr_id", "full_outer").where(~F.col("o").eqNullSafe(F.col("n")))
    return both.select("tr_id", F.when(F.col("n").isNull(), "removed").otherwise("changed").alias("change"))


def track_points(records: DataFrame, since: float, until: float) -> DataFrame:
    return records.where(F.col("t").between(since, until) & X.has_position("ok", "lat", "lon")).select(
        "tr_id", "t", "row_id", "lat", "lon", F.col("speed").alias("speed_kmh")
    )


def card_stops(plan: DataFrame, events: DataFrame, begin: float, end: float) -> DataFrame:
    """Planned stops in [begin, end] with the fact where one came."""
    facts = events.select("stop_id", "time_fact", "delay_s")
    return plan.where(F.col("t_plan").between(begin, end)).select(
        "tr_id", "stop_id", "t_plan", "address", "lat", "lon"
    ).join(facts, "stop_id", "left")


def vehicle_cards(records, plan, events, predictions, clock: float, span_s: float = S.CARD_SPAN_S) -> DataFrame:
    """Per vehicle: track of the last half hour, stops around now, predictions, newest first.

    The arrays hold one half-hour window each way.
    """
    track = track_points(in_window(records, clock), clock - span_s, clock)
    track = track.groupBy("tr_id").agg(
        F.sort_array(F.collect_list(F.struct("t", "row_id", "lat", "lon", "speed_kmh"))).alias("track")
    )
    stops = card_stops(plan, events, clock - span_s, clock + span_s).groupBy("tr_id").agg(
        F.sort_array(F.collect_list(F.struct("t_plan", "stop_id", "address", "time_fact", "delay_s"))).alias("stops")
    )
    recent = predictions.where(F.col("t").between(clock - span_s, clock)).groupBy("tr_id").agg(
        F.sort_array(F.collect_list(F.struct("t", "sample_id", "prediction_s")), asc=False).alias("predictions")
    )
    return track.join(stops, "tr_id", "full_outer").join(recent, "tr_id", "full_outer")


def nearest_stop_km(track: DataFrame, plan: DataFrame) -> DataFrame:
    """Track points with ``stop_km``, the distance to the nearest stop of their vehicle, by grids of growing rings."""
    return nearest(track, plan, ["tr_id"], "stop_km", S.MAP_EARTH_DIAMETER_KM / 2, S.FIRST_RING_KM)


def track_sections(track: DataFrame, plan: DataFrame) -> DataFrame:
    """Segments between neighbouring track points at most two minutes apart; ``away`` when either
    end is more than three kilometres from every stop. One grid answers that: nothing else is searched."""
    limit = S.AWAY_FROM_PLAN_KM
    close = nearest(track, plan, ["tr_id"], "__km", S.MAP_EARTH_DIAMETER_KM / 2, limit, limit)
    planned = plan.select("tr_id").distinct().withColumn("__planned", F.lit(True))
    placed = F.col("__planned") & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    far = close.join(planned, "tr_id", "left").withColumn("__far", F.coalesce(placed & F.col("__km").isNull(), F.lit(False)))
    pairs = previous(
        far, ["tr_id"], ["t", "row_id"], [bucket("t", 3600)],
        {"from_t": "t", "from_lat": "lat", "from_lon": "lon", "__from_far": "__far"},
    )
    return pairs.where(F.col("t") - F.col("from_t") <= S.TRACK_GAP_S).select(
        "tr_id", "from_t", "t", "from_lat", "from_lon", "lat", "lon",
        (F.col("__far") | F.col("__from_far")).alias("away"),
    )


def alert_list(alerts: DataFrame, status: str | None, limit: int) -> DataFrame:
    low, high = S.ALERT_LIMITS
    if not low <= limit <= high:
        raise ValueError(f"limit must be {low}..{high}")
    rows = alerts if status is None else alerts.where(F.col("status") == status)
    return rows.orderBy(F.desc("opened_at"), F.desc("id")).limit(limit)


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("open", "confirmed", "cancelled")],
        F.avg(F.when(F.col("status") == "confirmed", F.col("lead_time_s"))).alias("mean_lead_s"),
    )


def incidents(alerts: DataFrame) -> DataFrame:
    """The newest open alert of each vehicle, the largest predicted delay first."""
    newest = F.max_by(F.struct(*alerts.columns), F.struct("opened_at", "id")).alias("__a")
    top = alerts.where("status = 'open'").groupBy("tr_id").agg(newest).select("__a.*")
    return top.orderBy(F.desc("predicted_delay_s"), "tr_id")


def merge_history(card: DataFrame, messages: DataFrame, keep: int = S.CARD_HISTORY_ROWS) -> DataFrame:
    """Card predictions with newer messages merged in (``seq`` above the card's), the newest rows
    of each vehicle. A rank limit is applied before the shuffle."""
    from pyspark.sql import Window

    cards = card.select("tr_id", "sample_id", "t", "prediction_s", F.lit(-1).cast("bigint").alias("seq"), F.col("card_seq"))
    heads = card.groupBy("tr_id").agg(F.max("card_seq").alias("card_seq"))
    newer = messages.join(heads, "tr_id").where("seq > card_seq")
    rows = cards.unionByName(newer.select(*cards.columns))
    newest = F.max_by(F.struct("t", "prediction_s"), "seq").alias("r")
    merged = rows.groupBy("tr_id", "sample_id").agg(newest).select("tr_id", "sample_id", "r.*")
    rank = F.row_number().over(Window.partitionBy("tr_id").orderBy(F.desc("t"), "sample_id"))
    return merged.withColumn("n", rank).where(F.col("n") <= keep).drop("n")


def apply_messages(snapshot: DataFrame, messages: DataFrame, seq: int) -> DataFrame:
    """Vehicles of a snapshot at ``seq`` after the messages that follow without a gap.

    ``messages`` has one row per touched vehicle: ``seq, tr_id, removed`` and the columns of the
    snapshot. Messages not newer than the snapshot are ignored; nothing is applied from the first
    missing number on.
    """
    later = messages.where(F.col("seq") > seq)
    numbers = later.select("seq").distinct()
    gaps = previous(numbers, [], ["seq"], [F.expr("seq div 65536")], {"before": "seq"})
    broken = gaps.where(F.col("seq") - F.coalesce("before", F.lit(seq)) > 1)
    valid = beside(later, broken.agg(F.min("seq").alias("__stop")))
    valid = valid.where(F.col("__stop").isNull() | (F.col("seq") < F.col("__stop")))
    cols = [c for c in snapshot.columns if c != "tr_id"]
    rows = snapshot.select("tr_id", *cols, F.lit(seq).cast("bigint").alias("seq"), F.lit(False).alias("removed")).unionByName(
        valid.select("tr_id", *cols, F.col("seq").cast("bigint").alias("seq"), "removed")
    )
    newest = F.max_by(F.struct(*cols, "removed"), "seq").alias("r")
    return rows.groupBy("tr_id").agg(newest).where("NOT r.removed").select("tr_id", *[F.col(f"r.{c}").alias(c) for c in cols])


def open_alerts_after(snapshot: DataFrame, messages: DataFrame) -> DataFrame:
    """Open alerts after the alert messages: the newest state of each alert, closed ones gone."""
    cols = [c for c in snapshot.columns if c != "id"]
    rows = snapshot.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(messages.select(*snapshot.columns, F.col("seq").cast("bigint").alias("seq")))
    newest = F.max_by(F.struct(*cols), "seq").alias("r")
    return rows.groupBy("id").agg(newest).where("r.status = 'open'").select("id", *[F.col(f"r.{c}").alias(c) for c in cols])


def with_known_delay(points: DataFrame, events: DataFrame) -> DataFrame:
    return latest_known_delay(points.drop("cur_dev_s"), events)
