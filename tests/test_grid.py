"""Grid joins against all pairs, on places that are hard for a grid."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fleetlag import settings as S
from fleetlag.operators import grid
from fleetlag.operators.joins import interval_join

EARTH = S.EARTH_RADIUS_M


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH * math.asin(math.sqrt(min(1.0, h)))


def around(r, lat, lon, far_m):
    d = r.random() * far_m / EARTH
    turn = r.random() * 2 * math.pi
    la = math.degrees(math.asin(math.sin(math.radians(lat)) * math.cos(d) + math.cos(math.radians(lat)) * math.sin(d) * math.cos(turn)))
    y = math.sin(turn) * math.sin(d) * math.cos(math.radians(lat))
    lo = lon + math.degrees(math.atan2(y, math.cos(d) - math.sin(math.radians(lat)) * math.sin(math.radians(la))))
    return la, (lo + 180) % 360 - 180


HARD = [(55.75, 37.6), (0.0, 0.0), (89.9999, 10.0), (-90.0, 0.0), (10.0, 179.99999), (-33.0, -180.0), (60.0, 180.0), (90.0, -77.0)]


@pytest.mark.parametrize("radius", [30.0, 80.0, 50_000.0, 9_000_000.0])
def test_within_equals_all_pairs(spark, radius):
    r = random.Random(int(radius))
    places = [(i, 1 + i % 2, float(100 * (i % 3)), *HARD[i % len(HARD)]) for i in range(16)]
    fixes = [(j, 1 + j % 2, float(r.randint(-50, 400)), *around(r, *HARD[j % len(HARD)], 2 * radius)) for j in range(400)]
    p = spark.createDataFrame([*places, (99, 1, 0.0, None, 3.0)], "stop_id long, tr_id long, t_plan double, s_lat double, s_lon double")
    f = spark.createDataFrame([*fixes, (999, 1, 0.0, None, None)], "row_id long, tr_id long, t double, lat double, lon double")
    found = grid.within(p, f, ["tr_id"], F.col("t_plan") - 60, F.col("t_plan") + 120, "t", 180, radius, EARTH).collect()
    want = {(i, j) for i, v, tp, *a in places for j, w, t, *b in fixes if v == w and tp - 60 <= t <= tp + 120 and metres(b, a) <= radius}
    assert want and len(found) == len(want) and {(x.stop_id, x.row_id) for x in found} == want


def test_candidates_are_few(spark):
    r = random.Random(1)
    stops = [(i, 1, 60.0 * i, 55.75, 37.6 + 0.005 * (i % 40)) for i in range(400)]
    fixes = [(j, 1, float(j * 3), 55.75 + r.uniform(-2e-4, 2e-4), 37.6 + 0.005 * 40 * r.random()) for j in range(8000)]
    p = spark.createDataFrame(stops, "stop_id long, tr_id long, t_plan double, s_lat double, s_lon double")
    f = spark.createDataFrame(fixes, "row_id long, tr_id long, t double, lat double, lon double")
    low, high = F.col("t_plan") - 420, F.col("t_plan") + 900
    met = grid.candidates(p, f, ["tr_id"], low, high, "t", 1320, grid.Grid(80.0, EARTH)).count()
    hits = grid.within(p, f, ["tr_id"], low, high, "t", 1320, 80.0, EARTH).count()
    in_time = interval_join(p, f, ["tr_id"], low, high, "t", width=1320).count()
    assert hits > 1000 and hits <= met <= 3 * hits and 10 * met < in_time


def test_nearest_equals_all_pairs(spark):
    r = random.Random(4)
    places = [(1 + i % 3, *around(r, *HARD[i % len(HARD)], 3000.0)) for i in range(40)]
    points = [(j, 1 + j % 5, *around(r, *HARD[j % len(HARD)], 10.0 ** r.uniform(0, 7))) for j in range(300)]
    spots = spark.createDataFrame([*places, *places[:3], (2, None, 1.0)], "tr_id long, lat double, lon double")
    track = spark.createDataFrame([*points, (1000, 1, None, 2.0)], "row_id long, tr_id long, lat double, lon double")
    found = {x.row_id: x.near for x in grid.nearest(track, spots, ["tr_id"], "near", EARTH, 500.0).collect()}
    assert len(found) == 301 and found[1000] is None
    short = {x.row_id: x.near for x in grid.nearest(track, spots, ["tr_id"], "near", EARTH, 900.0, 900.0).collect()}
    for j, v, *at in points:
        want = min((metres(at, b) for w, *b in places if w == v), default=None)
        assert (found[j] is None) == (want is None) and (want is None or abs(found[j] - want) < 1e-6 * max(1.0, want))
        assert (short[j] is not None) == (want is not None and want <= 900.0)


def test_repeated_places_are_merged_not_broadcast(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 55.0, 37.0)], "stop_id long, tr_id long, t_plan double, s_lat double, s_lon double")
    f = spark.createDataFrame([(7, 1, 10.0, 55.0, 37.0)], "row_id long, tr_id long, t double, lat double, lon double")
    low, high = F.col("t_plan") - 60, F.col("t_plan") + 60
    for met in (
        grid.within(p, f, ["tr_id"], low, high, "t", 120.0, 50.0, EARTH),
        interval_join(p, f.select("tr_id", "t", "row_id"), ["tr_id"], low, high, "t", 120.0),
    ):
        assert [(r.stop_id, r.row_id) for r in met.collect()] == [(1, 7)]
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
