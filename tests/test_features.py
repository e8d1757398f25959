"""Arrivals and features on the synthetic street: known answers, no leaks, brute force."""

import math

import pytest
from pyspark.sql import functions as F

import city
from fleetlag import settings as S
from fleetlag.operators import arrivals as A
from fleetlag.operators.timetable import point_runs, prepare_plan, trip_lines
from fleetlag.plans.features import build_features
from fleetlag.plans.targets import pick_target

POINT = "sample_id string, tr_id bigint, T double, target_stop_id bigint, t_target double, cur_dev_s double, target double, part string"


def frames(spark, plan, fixes):
    return spark.createDataFrame(plan, city.PLAN), spark.createDataFrame(fixes, city.FIX)


def by_stop(df):
    return {r.stop_id: r for r in df.collect()}


def test_trips_are_cut_at_long_pauses(spark):
    plan = spark.createDataFrame(city.plan_rows(1, 10, 60.0, {4: 600.0}), city.PLAN)
    rows = sorted(prepare_plan(plan).collect(), key=lambda r: r.pos)
    assert [r.trip for r in rows] == [0] * 5 + [1] * 5
    assert rows[5].gap_s == 660 and rows[0].gap_s is None
    assert [r.seq for r in rows] == list(range(5)) * 2 and {r.trip_len for r in rows} == {5}
    assert rows[9].cum_m == pytest.approx(9 * 313, rel=0.01)
    assert sorted(x.stops for x in trip_lines(plan).collect()) == [5, 5]


def test_plan_over_segment_borders(spark):
    plan = city.plan_rows(1, 60, 1800.0, {10: 3000.0})
    df = spark.createDataFrame(plan, city.PLAN)
    rows = sorted(prepare_plan(df).collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == list(range(60))
    assert all(r.gap_s == b[2] - a[2] for r, a, b in zip(rows[1:], plan, plan[1:]))
    assert [r.trip for r in rows] == list(range(60))  # every gap is half an hour


def test_target_is_first_stop_in_window(spark):
    plan = spark.createDataFrame(city.plan_rows(1, 30), city.PLAN)
    m = spark.createDataFrame([(1, 400.0), (1, 1000.0), (1, 1739.0)], "tr_id bigint, T double")
    got = {r["T"]: r.target_stop_id for r in pick_target(m, plan).collect()}
    assert got == {400.0: 1017, 1000.0: 1027}


def test_run_numbers(spark):
    rows = [
        ("a", 1, 0.0, "train"), ("b", 1, 300.0, "train"), ("c", 1, 600.0, "test"), ("d", 1, 900.0, "test"),
        ("e", 1, 2400.0, "test"), ("f", 2, 0.0, "test"), ("g", 2, 900.0, "test"),
    ]
    df = spark.createDataFrame(rows, "sample_id string, tr_id bigint, T double, part string")
    got = {r.sample_id: r.run for r in point_runs(df).collect()}
    assert [got[k] for k in "abcdefg"] == [1, 1, 2, 2, 3, 4, 4]


def test_arrivals_and_departures(spark):
    plan = city.plan_rows(1, 10)
    p, f = frames(spark, plan, city.track_rows(plan, [30.0] * 10))
    got = by_stop(A.detect_arrivals(prepare_plan(p), f))
    assert got[1000].t_arr == 50.0  # the trip start wants the departure, 20 s later
    for k in range(1, 10):
        assert abs(got[1000 + k].t_arr - (60 * k + 30)) <= 10
        assert got[1000 + k].closest_m < 60


def test_fold_result_does_not_depend_on_segments(spark):
    plan = city.plan_rows(1, 40) + city.plan_rows(2, 40, row=1)
    fixes = city.track_rows(plan[:40], [45.0 + (7 * k) % 60 for k in range(40)])
    fixes += city.track_rows(plan[40:], [-30.0 + (11 * k) % 90 for k in range(40)])
    p, f = frames(spark, plan, fixes)
    prepared = prepare_plan(p)
    whole = by_stop(A.detect_arrivals(prepared, f, segment_s=1e9))
    for width in (120.0, 700.0):
        cut = by_stop(A.detect_arrivals(prepared, f, segment_s=width))
        assert {k: r.t_arr for k, r in cut.items()} == {k: r.t_arr for k, r in whole.items()}


# --- brute force over plain lists --------------------------------------------------------------


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * S.EARTH_RADIUS_M * math.asin(math.sqrt(h))


def brute_arrivals(stops, fixes):
    """(time, dwell) per stop or None; stops carry ``first`` for a trip's first stop."""
    out, floor, delay = [], -1e18, 0.0
    for s in stops:
        window = [x for x in fixes if max(s["t"] - 420, floor) <= x["t"] <= s["t"] + 900]
        groups, open_group = [], None
        for x in window:
            d = metres((x["lat"], x["lon"]), (s["lat"], s["lon"]))
            if d <= 80:
                if open_group is None:
                    open_group = []
                    groups.append(open_group)
                open_group.append((x["t"], d))
            else:
                open_group = None
        options = []
        for g in groups:
            low = min(d for _, d in g)
            when = next(t for t, d in g if d == low)
            if s["first"]:
                when = [t for t, d in g if d <= low + 5][-1]
            options.append((abs(when - s["t"] - delay), when, g[-1][0] - g[0][0]))
        if not options:
            out.append(None)
            continue
        _, when, dwell = min(options, key=lambda o: o[0])
        out.append((when, dwell))
        floor, delay = when, when - s["t"]
    return out


def brute_history(stops, fixes, T, target):
    seen_fixes = [x for x in fixes if T - 9000 <= x["t"] <= T and x["ok"]]
    if not seen_fixes:
        return {}
    last = max((i for i, s in enumerate(stops) if s["t"] <= T), default=-1)
    at = seen_fixes[-1]
    spot = lambda lo, hi: min(range(lo, hi + 1), key=lambda i: (metres((stops[i]["lat"], stops[i]["lon"]), (at["lat"], at["lon"])), i))
    here = spot(max(last - 6, 0), target)
    chosen = [i for i, s in enumerate(stops) if s["t"] >= T - 9000 and s["t"] <= T + 120 and i < target]
    found = {i: a for i, a in zip(chosen, brute_arrivals([stops[i] for i in chosen], seen_fixes)) if a}
    kept = {i: a for i, a in found.items() if i <= here}
    out = {}
    recent = [i for i in chosen if T - 1800 <= stops[i]["t"] <= T]
    if recent:
        out["gps_found_share"] = sum(i in kept for i in recent) / len(recent)
    if kept:
        order = sorted(kept)
        k = order[-1]
        dev = {i: kept[i][0] - stops[i]["t"] for i in order}
        out["gps_dev_last_s"] = dev[k]
        out["gps_dev_age_s"] = T - kept[k][0]
        out["gps_dev_mean3_s"] = sum(dev[i] for i in order[-3:]) / len(order[-3:])
        out["gps_dev_trend_s"] = dev[k] - dev[order[max(len(order) - 6, 0)]]
        out["dwell_last_s"] = kept[k][1]
        out["dwell_mean3_s"] = sum(kept[i][1] for i in order[-3:]) / len(order[-3:])
        if k + 1 < len(stops):
            out["gps_overdue_s"] = T - stops[k + 1]["t"]
            out["gps_dev_now_s"] = max(dev[k], out["gps_overdue_s"])
        same = lambda i, j: (stops[i]["lat"], stops[i]["lon"]) == (stops[j]["lat"], stops[j]["lon"])
        loops = [i for i in order if same(i, target) and stops[i]["t"] <= stops[target]["t"] - 1200]
        if loops:
            e = loops[-1]
            out["prev_loop_dev_s"], out["prev_loop_age_s"] = dev[e], T - kept[e][0]
            refs = [i for i in order if i < e and same(i, k)]
            if refs:
                out["prev_loop_gain_s"] = dev[e] - dev[refs[-1]]
    if last >= 0 and stops[last]["t"] >= T - 9000:
        place = spot(max(last - 6, 0), min(last + 1, len(stops) - 1))
        early = {i: found[i][0] - stops[i]["t"] for i in found if i <= min(last, place)}
        newest = early[max(early)] if early else 0.0
        if last in early or place >= last:
            out["cur"] = newest
        else:
            out["cur"] = max(newest, min(T - stops[last]["t"], 900.0))
    return out


@pytest.fixture(scope="module")
def looping(spark):
    """A bus running the same eight stops back and forth with wandering delays, a dead GPS spell and
    a dropped half hour."""
    plan, t = [], 0.0
    for lap in range(12):
        line = range(8) if lap % 2 == 0 else range(7, -1, -1)
        for j in line:
            plan.append((1000 + len(plan), 1, t, city.LAT, city.LON + city.STEP_DEG * j))
            t += 90.0
        t += 500.0
    delays = [((k * 37) % 200) - 40.0 + k for k in range(len(plan))]
    for k in range(1, len(delays)):  # never overtake the previous stop
        delays[k] = max(delays[k], plan[k - 1][2] + delays[k - 1] + 30 - plan[k][2])
    fixes = city.track_rows(plan, delays, skip=[(4000.0, 5800.0)])
    fixes = [(a, b, not 7000 < b < 7300, *((None, None) if 7000 < b < 7300 else (lat, lon)), v, n) for a, b, _, lat, lon, v, n in fixes]
    points = []
    for i in range(45):
        T = 250.0 * i + 3
        nxt = [p for p in plan if T + 600 < p[2] <= T + 900]
        if nxt:
            points.append((f"1_{i}", 1, T, nxt[0][0], nxt[0][2], None if i % 5 == 0 else 20.0 + i, 0.0, "train"))
    return plan, fixes, points


def compare(row, want, names):
    for n in names:
        got = row[n]
        assert (got is None) == (n not in want), (row["sample_id"], n, got, want.get(n))
        if got is not None:
            assert got == pytest.approx(want[n], abs=1e-6), (row["sample_id"], n)


HISTORY = [
    "gps_dev_last_s", "gps_dev_age_s", "gps_dev_mean3_s", "gps_dev_trend_s", "gps_overdue_s", "gps_dev_now_s",
    "gps_found_share", "dwell_last_s", "dwell_mean3_s", "prev_loop_dev_s", "prev_loop_age_s", "prev_loop_gain_s",
]


def test_features_match_brute_force(spark, looping):
    plan, fixes, points = looping
    p, f = frames(spark, plan, fixes)
    pts = spark.createDataFrame(points, POINT)
    given = {r.sample_id: r for r in build_features(pts, p, f).collect()}
    gps = {r.sample_id: r for r in build_features(pts, p, f, "gps").collect()}
    stops, prev = [], None
    for s in plan:
        stops.append({"t": s[2], "lat": s[3], "lon": s[4], "first": prev is None or s[2] - prev >= 420})
        prev = s[2]
    flat = [{"t": x[1], "ok": x[2], "lat": x[3], "lon": x[4]} for x in fixes]
    assert len(given) == len(points) > 30
    loops = 0
    for q in points:
        want = brute_history(stops, flat, q[2], q[3] - 1000)
        compare(given[q[0]], want, HISTORY)
        loops += "prev_loop_gain_s" in want
        assert gps[q[0]].cur_dev_s == (pytest.approx(want["cur"]) if "cur" in want else None)
    assert loops > 3


def test_later_fixes_change_nothing(spark, looping):
    plan, fixes, points = looping
    T = 6001.0
    one = [(q[0], 1, T, next(p[0] for p in plan if p[2] > T + 600), next(p[2] for p in plan if p[2] > T + 600), 10.0, 0.0, "test") for q in points[:1]]
    spoiled = [x if x[1] <= T else (x[0], x[1], True, 55.9, 37.9, 140.0, x[6]) for x in fixes]
    pts = spark.createDataFrame(one, POINT)
    p, a = frames(spark, plan, fixes)
    _, b = frames(spark, plan, spoiled)
    assert build_features(pts, p, a, "gps").collect() == build_features(pts, p, b, "gps").collect()


def test_outage_equals_cut_track(spark, looping):
    plan, fixes, points = looping
    pts = spark.createDataFrame(points[10:20], POINT)
    p, f = frames(spark, plan, fixes)
    silent = build_features(pts.withColumns({"gap_s": F.lit(300.0), "outage": F.lit("silence")}), p, f)
    rows = {r.sample_id: r for r in silent.collect()}
    for q in points[10:12]:
        mine = spark.createDataFrame([q], POINT)
        cut = spark.createDataFrame([x for x in fixes if x[1] <= q[2] - 300] or [fixes[0]], city.FIX)
        want = build_features(mine, p, cut).first()
        assert all(rows[q[0]][n] == want[n] for n in S.FEATURES)
    blank = build_features(pts.withColumns({"gap_s": F.lit(300.0), "outage": F.lit("no_position")}), p, f)
    blanks = blank.collect()
    for r in blanks:
        assert r.fixes_15m >= rows[r.sample_id].fixes_15m and r.tel_age_s == rows[r.sample_id].tel_age_s
    assert any(r.fixes_15m > rows[r.sample_id].fixes_15m for r in blanks)


def test_copies_of_a_point_know_what_each_would_alone(spark, looping):
    plan, fixes, points = looping
    p, f = frames(spark, plan, fixes)
    prepared = prepare_plan(p)
    pos = {r.stop_id: r.pos for r in prepared.collect()}
    asks = [
        (f"{q[0]}/{gap}/{copy}", 1, q[2], q[2] - gap, pos[q[3]])
        for q in points[10:14] for gap, copy in ((0.0, 0), (300.0, 0), (300.0, 1), (2000.0, 0))
    ]
    schema = "sample_id string, tr_id bigint, T double, T_cut double, target_pos bigint"
    known = lambda rows: {r.sample_id: r.known for r in A.known_arrivals(spark.createDataFrame(rows, schema), prepared, f).collect()}
    together = known(asks)
    assert len(together) == len(asks)
    for gap in ("0.0/0", "300.0/0", "300.0/1", "2000.0/0"):
        alone = known([a for a in asks if a[0].endswith(f"/{gap}")])
        assert alone and all(together[k] == v for k, v in alone.items())
    first = points[10][0]
    assert len(together[f"{first}/0.0/0"]) > len(together[f"{first}/2000.0/0"]) > 0


def test_layover_features(spark):
    plan = city.plan_rows(1, 30, 60.0, {19: 480.0})
    p, f = frames(spark, plan, city.track_rows(plan, [0.0] * 30))
    T = 1000.0
    target = next(s for s in plan if s[2] > T + 600)
    pts = spark.createDataFrame([("x", 1, T, target[0], target[2], 200.0, 0.0, "train")], POINT)
    r = build_features(pts, p, f).first()
    assert (r.layover_ahead_s, r.layover_slack_s, r.new_trip_ahead) == (540.0, 340.0, 1.0)


def test_refuses_facts_and_unknown_hint(spark):
    p = spark.createDataFrame(city.plan_rows(1, 3), city.PLAN)
    with pytest.raises(ValueError, match="fact"):
        build_features(None, p.withColumn("t_fact", F.lit(0.0)), None)
    with pytest.raises(ValueError, match="hint"):
        build_features(None, p, None, "guess")
