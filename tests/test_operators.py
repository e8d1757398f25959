"""Scans, joins, percentiles, routes, folds and the detector's rules on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

import city
from fleetlag import settings as S
from fleetlag.operators import baselines as B
from fleetlag.operators import detector as DT
from fleetlag.operators import metrics as ME
from fleetlag.operators.joins import asof_join, interval_join, require_aligned
from fleetlag.operators.quantiles import quantiles
from fleetlag.operators.routes import route_ids
from fleetlag.operators.segments import bucket, islands, previous, running
from fleetlag.operators.timetable import prepare_plan


def test_running_equals_plain_scan_for_a_hot_key(spark):
    rnd = random.Random(1)
    rows = [(1 if rnd.random() < 0.6 else rnd.randrange(2, 9), rnd.randrange(5000) * 1.0, i, rnd.choice([None, rnd.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, t double, n bigint, v double")
    outs = {"c": ("count", None), "s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v"), "l": ("last", "v"), "all": ("total", "v")}
    for inclusive in (True, False):
        got = {r.n: r for r in running(df, ["k"], ["t", "n"], [bucket("t", 400)], outs, inclusive).collect()}
        for key in {r[0] for r in rows}:
            mine = sorted([r for r in rows if r[0] == key], key=lambda r: (r[1], r[2]))
            for i, r in enumerate(mine):
                vals = [x[3] for x in mine[: i + inclusive] if x[3] is not None]
                g = got[r[2]]
                assert g.c == i + inclusive
                assert g.hi == (max(vals) if vals else None) and g.lo == (min(vals) if vals else None)
                assert g.l == (vals[-1] if vals else None)
                assert g.s == (pytest.approx(sum(vals)) if vals else None)
                assert g["all"] == pytest.approx(sum(x[3] for x in mine if x[3] is not None))


def test_previous_and_islands(spark):
    df = spark.createDataFrame([(1, float(t)) for t in (0, 10, 500, 510, 2000)], "k bigint, t double")
    seen = previous(df, ["k"], ["t"], [bucket("t", 100)], {"before": "t"})
    out = islands(seen, ["k"], ["t"], [bucket("t", 100)], F.col("before").isNull() | (F.col("t") - F.col("before") > 60), "g")
    assert [r.g for r in out.orderBy("t").collect()] == [0, 0, 1, 1, 2]


def test_asof_ties_and_strictness(spark):
    left = spark.createDataFrame([(1, 10.0), (1, 9.0), (1, 20000.0), (2, 5.0)], "k bigint, t double")
    right = spark.createDataFrame([(1, 10.0, 1), (1, 10.0, 2), (1, 3.0, 0)], "k bigint, u double, v bigint")
    got = {(r.k, r.t): r.x for r in asof_join(left, right, ["k"], "t", "u", {"x": "v"}, tie=["v"], width=50).collect()}
    assert got == {(1, 10.0): 2, (1, 9.0): 0, (1, 20000.0): 2, (2, 5.0): None}
    strict = asof_join(left, right, ["k"], "t", "u", {"x": "v"}, tie=["v"], width=50, strict=True)
    assert {(r.k, r.t): r.x for r in strict.collect()}[(1, 10.0)] == 0


def test_interval_join_edges(spark):
    left = spark.createDataFrame([(1, 0.0, 100.0)], "k bigint, a double, b double")
    right = spark.createDataFrame([(1, t) for t in (-1.0, 0.0, 50.0, 100.0, 101.0)], "k bigint, t double")
    pairs = interval_join(left, right, ["k"], F.col("a"), F.col("b"), "t", 30)
    assert sorted(r.t for r in pairs.collect()) == [0.0, 50.0, 100.0]
    half = interval_join(left, right, ["k"], F.col("a"), F.col("b"), "t", 30, low_open=True)
    assert sorted(r.t for r in half.collect()) == [50.0, 100.0]


def test_alignment_guard(spark):
    a = spark.createDataFrame([("x",), ("y",)], "id string")
    require_aligned(a, a, ["id"], "same")
    with pytest.raises(ValueError, match="line up"):
        require_aligned(a, a.where("id = 'x'"), ["id"], "answers")
    with pytest.raises(ValueError, match="line up"):
        require_aligned(a, a.unionByName(a), ["id"], "answers")


def test_quantiles_with_repeats_and_weights(spark):
    import numpy as np

    rnd = random.Random(3)
    vals = [rnd.choice([5.0, 5.0, rnd.gauss(0, 40)]) for _ in range(501)]
    df = spark.createDataFrame([("a", v) for v in vals] + [("b", 7.0)], "g string, v double")
    q = quantiles(df, ["g"], "v", {"m": ("cont", 0.5), "p": ("cont", 0.95), "d": ("disc", 0.95)})
    got = {r.g: r for r in q.collect()}
    assert got["a"].m == pytest.approx(np.percentile(vals, 50)) and got["a"].p == pytest.approx(np.percentile(vals, 95))
    assert got["a"].d == sorted(vals)[-(-95 * 501 // 100) - 1] and got["b"].m == 7.0
    weighted = spark.createDataFrame([(1.0, 3), (9.0, 1)], "v double, n bigint")
    assert quantiles(weighted, [], "v", {"m": ("cont", 0.5)}, weight="n").first().m == 1.0


def brute_routes(stops, share=0.5):
    route = {}
    for v in sorted(stops):
        for o in sorted(route):
            if route[o] == o and len(stops[v] & stops[o]) / len(stops[v]) >= share:
                route[v] = o
                break
        else:
            route[v] = v
    return route


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_routes_match_greedy(spark, seed):
    rnd = random.Random(seed)
    stops = {v: set(rnd.sample(range(25), rnd.randrange(2, 10))) | {99} for v in range(1, 25)}
    stops[30] = set(stops[3])  # a copy
    rows = [(v * 100 + s, v, 0.0, 55.0 + s / 1000, 37.0) for v, ss in stops.items() for s in ss]
    got = {r.tr_id: r.route for r in route_ids(spark.createDataFrame(rows, city.PLAN)).collect()}
    assert got == brute_routes(stops)


def test_folds_are_balanced_and_whole(spark):
    rows = [(g, i) for g in range(40) for i in range(1 + g % 7)]
    out = B.group_folds(spark.createDataFrame(rows, "g bigint, i bigint"), "g", 5).collect()
    folds = {}
    for r in out:
        folds.setdefault(r.g, set()).add(r.fold)
    assert all(len(f) == 1 for f in folds.values())
    sizes = [sum(r.fold == k for r in out) for k in range(5)]
    assert max(sizes) - min(sizes) <= 7
    with pytest.raises(ValueError, match="not enough"):
        B.check_group_count(spark.createDataFrame(rows[:3], "g bigint, i bigint"), "g", 5)


def test_line_fit_recovers_slope(spark):
    rows = [(float(x), 0.4 * x + 7 + (1 if x % 2 else -1)) for x in range(-60, 61)]
    fit = B.fit_l1_lines(spark.createDataFrame(rows, "x double, y double"), [], "x", "y").first()
    assert fit.a == pytest.approx(0.4, abs=0.011) and fit.b == pytest.approx(7, abs=1.1)


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(True, 0.9), (False, 0.1), (True, 0.5), (False, 0.5)], "y boolean, p double")
    assert ME.roc_auc(df, "y", "p").first().auc == 0.875
    assert ME.roc_auc(df.where("y"), "y", "p").first().auc is None


def test_bootstrap_interval(spark):
    rows = [(g, 2.0 + (g % 5 - 2) * 0.5) for g in range(60) for _ in range(3)]
    df = spark.createDataFrame(rows, "g bigint, d double")
    a = ME.paired_interval(df, "d", "g", samples=400).first()
    mean = sum(r[1] for r in rows) / len(rows)
    assert a.lo < mean < a.hi and a.hi - a.lo < 0.6
    assert ME.paired_interval(df, "d", "g", samples=400).first() == a
    one = ME.paired_interval(df.where("g = 1"), "d", "g", samples=50).first()
    assert one.lo == one.hi == 1.5


def test_intervals_of_several_columns_share_their_draws(spark, monkeypatch):
    monkeypatch.setattr(ME, "GROUP_BITS", 4)
    monkeypatch.setattr(ME, "DRAWS_AT_ONCE", 700)
    rows = [(g, (g * 37 % 19) / 7, float(g % 5) if g % 3 else None, None) for g in range(50) for _ in range(g % 4 + 1)]
    df = spark.createDataFrame(rows, "g bigint, d double, e double, none double")
    found = ME.paired_intervals(df, ["d", "none", "e"], "g", samples=60)
    got = {r.difference: (r.lo, r.hi) for r in found.collect()}
    draws = spark.range(60).crossJoin(spark.range(50).withColumnRenamed("id", "draw")).select(
        F.col("id").alias("sample"), F.pmod(F.xxhash64("id", "draw", F.lit(0)), F.lit(50)).alias("n")
    ).collect()
    order = [r.g for r in df.select("g").distinct().withColumn("h", F.xxhash64("g")).orderBy("h", "g").collect()]
    for place, column in ((0, 1), (2, 2)):
        means = []
        for sample in range(60):
            taken = [r[column] for x in draws if x.sample == sample for r in rows if r[0] == order[x.n] and r[column] is not None]
            means.append(sum(taken) / len(taken))
        means.sort()
        low, high = (means[int(p)] + (means[int(p) + 1] - means[int(p)]) * (p - int(p)) for p in (0.05 * 59, 0.95 * 59))
        assert got.pop(place) == pytest.approx((low, high))
        one = ME.paired_interval(df, "de"[place // 2], "g", samples=60).first()
        assert (one.lo, one.hi) == pytest.approx((low, high))
    assert not got  # a column without values has no interval
    assert ME.paired_interval(df, "none", "g", samples=60).first().lo is None
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64(sample") == ME.paired_interval(df, "d", "g")._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(sample")


# --- the detector's rules -----------------------------------------------------------------------

DAY = 1767657600.0  # 2026-01-06 00:00 UTC
STOP = (55.0, 37.0)


def visit(i, t, lat=STOP[0], lon=STOP[1]):
    return (i, 1, t, lat, lon)


def tick(t, lat=STOP[0], lon=STOP[1], speed=10.0, ok=True):
    return (1, t, ok, lat, lon, speed, int(t - DAY) + 90000)


def detect(spark, visits, ticks, **kw):
    p, f = spark.createDataFrame(visits, city.PLAN), spark.createDataFrame(ticks, city.FIX)
    return sorted(DT.detect_stops(f.drop("row_id"), p, **kw).collect(), key=lambda r: r.time_fact)


NOON = DAY + 43200
AWAY = (55.01, 37.0)


def test_slow_tick_is_arrival_and_exit_is_departure(spark):
    out = detect(spark, [visit(5, NOON)], [tick(NOON, speed=0.0), tick(NOON + 20, speed=0.0), tick(NOON + 40, *AWAY)])
    assert [(r.stop_id, r.time_fact, r.departure, r.recovered) for r in out] == [(5, NOON, NOON + 40, False)]


def test_fast_pass_is_recovered_on_exit(spark):
    near = (STOP[0] + 0.0003, STOP[1])
    out = detect(spark, [visit(5, NOON)], [tick(NOON, *near), tick(NOON + 10), tick(NOON + 20, *AWAY)])
    assert [(r.time_fact, r.available_at, r.recovered) for r in out] == [(NOON + 10, NOON + 20, True)]


def test_two_close_visits_are_ambiguous(spark):
    assert detect(spark, [visit(5, NOON), visit(6, NOON + 60)], [tick(NOON, speed=0.0), tick(NOON + 30, *AWAY)]) == []


def test_outside_tolerance_is_ignored(spark):
    assert detect(spark, [visit(5, NOON)], [tick(NOON + 301, speed=0.0)]) == []
    assert len(detect(spark, [visit(5, NOON)], [tick(NOON + 300, speed=0.0)])) == 1


def test_gap_keeps_arrival_but_invents_no_departure(spark):
    out = detect(spark, [visit(5, NOON)], [tick(NOON, speed=0.0), tick(NOON + 400, *AWAY)])
    assert [(r.time_fact, r.departure) for r in out] == [(NOON, None)]


def test_midnight_visit_is_found_from_the_next_day(spark):
    night = DAY + 86400
    out = detect(spark, [visit(5, night - 30)], [tick(night + 20, speed=0.0), tick(night + 60, *AWAY)])
    assert [r.stop_id for r in out] == [5]


def test_visits_only_move_forward(spark):
    far = (55.02, 37.0)
    visits = [visit(5, NOON), visit(6, NOON + 200, *far)]
    ticks = [tick(NOON + 100, *far, speed=0.0), tick(NOON + 120, 55.01, 37.0), tick(NOON + 140, speed=0.0), tick(NOON + 160, *AWAY)]
    assert [r.stop_id for r in detect(spark, visits, ticks)] == [6]


def test_invalid_position_only_moves_time(spark):
    out = detect(spark, [visit(5, NOON)], [tick(NOON, speed=0.0), tick(NOON + 10, ok=False), tick(NOON + 20, *AWAY)])
    assert [r.departure for r in out] == [NOON + 20]


def test_segments_never_change_events(spark):
    plan = city.plan_rows(1, 25, 120.0, start=NOON) + city.plan_rows(2, 25, 120.0, start=NOON, row=1)
    fixes = city.track_rows(plan[:25], [20.0 + k for k in range(25)]) + city.track_rows(plan[25:], [-10.0] * 25)
    p, f = spark.createDataFrame(plan, city.PLAN), spark.createDataFrame(fixes, city.FIX).drop("row_id")
    key = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    whole = key(DT.detect_stops(f, p, segment_s=1e9))
    assert len(whole) >= 45
    for width in (130.0, 610.0):
        assert key(DT.detect_stops(f, p, segment_s=width)) == whole


def test_feed_counts_late_ticks():
    state = DT.new_state()
    row = {"ok": True, "lat": 55.0, "lon": 37.0, "speed": 1.0, "near": []}
    for t in (10.0, 10.0, 9.0, 11.0):
        DT.feed(state, {**row, "t": t}, S.DETECTOR)
    assert state["late"] == 2 and state["last"] == 11.0


def test_draws_and_derived_plans_are_merged_not_broadcast(spark, tmp_path):
    from fleetlag.catalog import fleetday as D

    def joins(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    rows = spark.createDataFrame([(g, float(g)) for g in range(30)], "run long, d double")
    assert "strategy=merge" in joins(ME.paired_interval(rows, "d", "run", samples=20))
    spark.sql("SELECT 1L event_id, timestamp'2024-01-02' ts, 5L user_id, 'a' event_type, 1D value, '{\"k\": 1}' props").write.parquet(
        f"{tmp_path}/events.parquet"
    )
    for made in (D.plan(spark, tmp_path), D._moments(spark, tmp_path, 3, 60)):
        assert "strategy=merge" in joins(made.join(made.select("tr_id").withColumn("x", F.lit(1)), "tr_id"))


def test_scans_trips_and_folds_are_merged_not_broadcast(spark):
    plan = spark.createDataFrame([(1, 1, 0.0, 55.0, 37.0), (2, 1, 60.0, 55.0, 37.1)], city.PLAN)
    rows = spark.createDataFrame([(g % 7, float(g)) for g in range(21)], "run long, t double")
    for made in (
        running(rows, ["run"], ["t"], [bucket("t", 5)], {"n": ("count", None)}),
        prepare_plan(plan),
        B.group_folds(rows, "run", 3),
    ):
        made.collect()
        text = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
