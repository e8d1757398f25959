"""Arrivals at planned stops recovered from GPS fixes.

The geometry runs in the JVM: a join by vehicle, time bucket and grid cell brings each stop the fixes
around it from seven minutes before to fifteen minutes after the planned time, and those within 80 m stay. What is
left, a short array per stop, is folded in timetable order, because an arrival bounds the search at
the next stop and the last delay moves the expected time.
"""

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fleetlag import settings as S
from fleetlag.operators.folds import segmented_fold
from fleetlag.operators.grid import within
from fleetlag.operators.segments import PLAN_SEGMENT_S, TRACK_SEGMENT_S, bucket, running

SEARCH_WIDTH_S = S.ARRIVAL_BEFORE_S + S.ARRIVAL_AFTER_S


def numbered_good_fixes(telemetry: DataFrame) -> DataFrame:
    """Usable fixes with ``fix_no``, their place in the vehicle's track."""
    good = telemetry.where("ok").select("tr_id", "t", "lat", "lon", "row_id")
    return running(
        good,
        ["tr_id"],
        ["t", "row_id"],
        [bucket("t", TRACK_SEGMENT_S)],
        {"fix_no": ("count", None)},
        inclusive=False,
    )


def stop_passes(plan: DataFrame, telemetry: DataFrame, radius_m: float = S.ARRIVAL_RADIUS_M) -> DataFrame:
    """Stops that had a fix within the radius, with those fixes in ``near`` ordered by number.

    ``near`` is bounded by the fixes of a 22-minute window. Broken consecutive numbers end a pass.
    """
    stops = plan.select("stop_id", "tr_id", "t_plan", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    near = within(
        stops,
        numbered_good_fixes(telemetry),
        ["tr_id"],
        F.col("t_plan") - S.ARRIVAL_BEFORE_S,
        F.col("t_plan") + S.ARRIVAL_AFTER_S,
        "t",
        SEARCH_WIDTH_S,
        radius_m,
        S.EARTH_RADIUS_M,
    )
    return near.groupBy("stop_id").agg(
        F.sort_array(F.collect_list(F.struct("fix_no", "t", "d"))).alias("near")
    )


def pass_runs(passes: DataFrame) -> DataFrame:
    """One row per pass: a stretch of consecutive fixes near a stop.

    The place in the short array minus the fix number is constant inside a stretch.
    """
    fixes = passes.select("stop_id", F.posexplode("near").alias("i", "f"))
    return fixes.groupBy("stop_id", (F.col("f.fix_no") - F.col("i")).alias("__run")).agg(
        F.min("f.t").alias("from_t"), F.max("f.t").alias("to_t"),
        F.count(F.lit(1)).alias("fixes"), F.min("f.d").alias("closest_m"),
    ).drop("__run")


def choose_pass(near, low, high, expected, departs):
    """Best pass among ``near`` fixes with ``low <= t <= high``.

    Returns (arrival, dwell, closest) or None. A pass is a stretch of consecutive fixes; its time
    is the closest fix, or for a departure the last one almost as close.
    """
    inside = [f for f in near if low <= f["t"] <= high]
    best = None
    start = 0
    for end in range(1, len(inside) + 1):
        if end < len(inside) and inside[end]["fix_no"] == inside[end - 1]["fix_no"] + 1:
            continue
        stay = inside[start:end]
        start = end
        closest = min(stay, key=lambda f: f["d"])
        at = closest
        if departs:
            limit = closest["d"] + S.DEPART_TOLERANCE_M
            at = next(f for f in reversed(stay) if f["d"] <= limit)
        miss = abs(at["t"] - expected)
        if best is None or miss < best[0]:
            best = (miss, at["t"], stay[-1]["t"] - stay[0]["t"], closest["d"])
    return best and best[1:]


def fold_stops(stops, track_from=float("-inf"), track_to=float("inf"), state=None):
    """Arrivals at ``stops`` (in plan order, each with ``near``) and the state after them."""
    not_before, delay = state or (None, 0.0)
    found = []
    for s in stops:
        low = max(s["t_plan"] - S.ARRIVAL_BEFORE_S, track_from, float("-inf") if not_before is None else not_before)
        high = min(s["t_plan"] + S.ARRIVAL_AFTER_S, track_to)
        hit = choose_pass(s["near"], low, high, s["t_plan"] + delay, s["departs"])
        if hit:
            not_before, delay = hit[0], hit[0] - s["t_plan"]
            found.append((s, *hit))
    return found, [not_before, delay]


ARRIVALS = T.StructType(
    [
        T.StructField("stop_id", T.LongType()),
        T.StructField("t_arr", T.DoubleType()),
        T.StructField("dwell_s", T.DoubleType()),
        T.StructField("closest_m", T.DoubleType()),
    ]
)


def _arrival_step(records, state):
    found, after = fold_stops(records, state=state)
    return [(s["stop_id"], *hit) for s, *hit in found], after


def detect_arrivals(prepared: DataFrame, telemetry: DataFrame, segment_s: float = PLAN_SEGMENT_S) -> DataFrame:
    """Prepared stops with ``t_arr, dwell_s, closest_m`` (NULL where no pass was found)."""
    passes = stop_passes(prepared, telemetry)
    rows = (
        prepared.select("stop_id", "tr_id", "t_plan", (F.col("seq") == 0).alias("departs"))
        .hint("merge")
        .join(passes, "stop_id")
        .withColumn("seg", bucket("t_plan", segment_s))
    )
    found = segmented_fold(rows, ["tr_id"], "seg", ["t_plan", "stop_id"], _arrival_step, ARRIVALS)
    return prepared.join(found, "stop_id", "left")


# --- arrivals as known at each forecast point -----------------------------------------------

KNOWN = T.ArrayType(
    T.StructType(
        [
            T.StructField("pos", T.LongType()),
            T.StructField("t_plan", T.DoubleType()),
            T.StructField("t_arr", T.DoubleType()),
            T.StructField("dwell_s", T.DoubleType()),
            T.StructField("key", T.LongType()),
            T.StructField("t_next", T.DoubleType()),
        ]
    )
)
POINT_SEGMENT_S = 7_200


def known_arrivals(points: DataFrame, prepared: DataFrame, telemetry: DataFrame) -> DataFrame:
    """``sample_id, known``: arrivals at stops planned in [T − 9000 s, T + 120 s] before the
    target, recovered from fixes in [T − 9000 s, T_cut] only.

    ``points`` has ``sample_id, tr_id, T, T_cut, target_pos``. Points meet the stops of their own
    time segment, so a group holds at most four and a half hours of one vehicle's timetable.
    """
    # merge joins: a compressed file of the timetable is many times smaller than its rows in a broadcast
    nxt = prepared.select("tr_id", (F.col("pos") - 1).alias("pos"), F.col("t_plan").alias("t_next")).hint("merge")
    stops = (
        prepared.select("stop_id", "tr_id", "t_plan", "pos", "key", (F.col("seq") == 0).alias("departs"))
        .hint("merge")
        .join(stop_passes(prepared, telemetry), "stop_id")
        .join(nxt, ["tr_id", "pos"], "left")
        .withColumn(
            "seg",
            F.explode(
                F.sequence(
                    bucket(F.col("t_plan") - S.EARLY_LOOKAHEAD_S, POINT_SEGMENT_S),
                    bucket(F.col("t_plan") + S.HISTORY_S, POINT_SEGMENT_S),
                )
            ),
        )
    )
    asked = points.select(
        "sample_id", "tr_id", "T", "T_cut", "target_pos", bucket("T", POINT_SEGMENT_S).alias("seg")
    )
    schema = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("known", KNOWN)])

    arrow = to_arrow_schema(schema)

    def answer(asked_rows: pa.Table, stop_rows: pa.Table) -> pa.Table:
        stop_rows = stop_rows.sort_by([("t_plan", "ascending"), ("stop_id", "ascending")])
        day = [s | {"row": i} for i, s in enumerate(stop_rows.select(["t_plan", "pos", "departs", "near"]).to_pylist())]
        times = [s["t_plan"] for s in day]
        asks: dict = {}  # copies of a point differ in what they lost: they share the stops before it
        for p in asked_rows.select(["sample_id", "T", "T_cut", "target_pos"]).to_pylist():
            asks.setdefault((p["T"], p["target_pos"]), {}).setdefault(p["T_cut"], []).append(p["sample_id"])
        ids, ends, rows, arrived, dwelt = [], [0], [], [], []
        for (t, target_pos), cuts in asks.items():
            lo = bisect_left(times, t - S.HISTORY_S)
            hi = bisect_right(times, t + S.EARLY_LOOKAHEAD_S)
            mine = [s for s in day[lo:hi] if s["pos"] < target_pos]
            early = min(cuts)
            reached = sum(s["t_plan"] + S.ARRIVAL_AFTER_S <= early for s in mine)
            settled, state = fold_stops(mine[:reached], t - S.HISTORY_S, early)
            for cut, samples in cuts.items():
                found = settled + fold_stops(mine[reached:], t - S.HISTORY_S, cut, state)[0]
                for sample in samples:
                    ids.append(sample)
                    rows += [s["row"] for s, *_ in found]
                    arrived += [f[1] for f in found]
                    dwelt += [f[2] for f in found]
                    ends.append(len(rows))
        taken = stop_rows.select(["pos", "t_plan", "key", "t_next"]).take(pa.array(rows, pa.int64())).combine_chunks()
        found_type = arrow.field("known").type
        columns = {c: taken.column(c).combine_chunks() for c in taken.column_names}
        columns |= {"t_arr": pa.array(arrived, pa.float64()), "dwell_s": pa.array(dwelt, pa.float64())}
        found_rows = pa.StructArray.from_arrays([columns[f.name] for f in found_type.value_type], fields=list(found_type.value_type))
        known = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found_rows, type=found_type)
        return pa.Table.from_arrays([pa.array(ids, pa.string()), known], schema=arrow)

    return (
        asked.groupBy("tr_id", "seg")
        .cogroup(stops.groupBy("tr_id", "seg"))
        .applyInArrow(answer, schema)
    )
