"""Window of whole points, last event per stop, stream-stream verification and counters of running jobs."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from fleetlag import settings as S
from fleetlag.plans import live as L
from fleetlag.streaming import counters as C
from fleetlag.streaming import processors as PR
from fleetlag.streaming import records as R

START = 1_767_600_000.0
POINT = "row_id bigint, tr_id bigint, t double, event_time timestamp, lat double, ok boolean, note string"
EVENT = "row_id bigint, tr_id bigint, stop_id bigint, time_fact double, event_time timestamp, delay_s double"


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PR.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def stamp(t):
    return datetime.datetime.fromtimestamp(t, datetime.timezone.utc)


def stream_of(spark, folder, rows, schema, size):
    """A stream of files of ``size`` rows in the given order."""
    folder.mkdir(parents=True)
    for k, i in enumerate(range(0, len(rows), size)):
        path = folder / f"{k:03d}.json"
        lines = spark.createDataFrame(rows[i : i + size], schema).select(F.to_json(F.struct("*"))).collect()
        path.write_text("\n".join(r[0] for r in lines) + "\n")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def drain(df, spark, mode, folder, name):
    target = str(folder / name)
    q = (
        df.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{target}/batch={i}"))
        .outputMode(mode).option("checkpointLocation", str(folder / f"{name}-ck")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(target), q


def points():
    rows = []
    for n in range(60):
        t = START + 90.0 * n - (600.0 if n % 7 == 3 else 0.0)  # some come ten minutes late
        tr = None if n % 11 == 5 else 1 + n % 3 if n < 25 else 1 + n % 2  # vehicle 3 falls silent
        rows.append((n, tr, t, stamp(t), None if n % 4 == 0 else 55.0 + n, n % 2 == 0, None if n % 5 else f"n{n}"))
    return rows + [rows[-1]]  # a repeated row


@pytest.mark.parametrize("size", [4, 9, 61])
def test_window_points_of_the_stream_equal_the_batch(spark, tmp_path, size):
    rows = points()
    got, _ = drain(PR.window_stream(stream_of(spark, tmp_path / "in", rows, POINT, size)), spark, "update", tmp_path, "out")
    last = got.groupBy("tr_id").agg(F.max_by(F.struct("points", "held"), "batch").alias("w"))
    assert all(r.w.points == len(r.w.held) for r in last.collect())
    held = last.select("tr_id", F.explode("w.held").alias("p")).select("tr_id", "p.*")
    table = spark.createDataFrame(rows, POINT)
    clock = max(r[2] for r in rows)
    want = L.in_window(table, clock).drop("event_time")
    key = lambda df: sorted(str(r) for r in df.select(*want.columns).collect())
    assert key(held) == key(want) and want.count() > 15
    assert last.where("tr_id = 3").first().w.points == 0  # forgotten by the timer alone


@pytest.mark.parametrize("size", [3, 40])
def test_last_events_of_the_stream_equal_the_batch(spark, tmp_path, size):
    rows = [(n, 1 + n % 2, 100 + n % 5, START + n, stamp(START + n), None if n % 6 == 0 else float(n)) for n in range(40)]
    got, _ = drain(PR.last_events_stream(stream_of(spark, tmp_path / "in", rows, EVENT, size)), spark, "update", tmp_path, "out")
    batch = L.last_event_per_stop(spark.createDataFrame(rows, EVENT))
    last = got.groupBy("tr_id", "stop_id").agg(F.max_by(F.struct("row_id", "time_fact", "delay_s"), "batch").alias("e"))
    last = last.select("tr_id", "stop_id", "e.*")
    key = lambda df: sorted(map(str, df.select("tr_id", "stop_id", "row_id", "time_fact", "delay_s").collect()))
    assert key(last) == key(batch) and batch.count() == 10


def test_a_replayed_older_event_changes_nothing(spark, tmp_path):
    at = stamp(START)
    rows = [(5, 1, 100, START, at, 1.0), (9, 1, 100, START + 1, at, 2.0), (5, 1, 100, START, at, 1.0), (None, 1, 100, START, at, 3.0)]
    got, _ = drain(PR.last_events_stream(stream_of(spark, tmp_path / "in", rows, EVENT, 1)), spark, "update", tmp_path, "out")
    assert sorted(r.row_id for r in got.collect()) == [5, 9]


def test_last_events_are_forgotten_with_time(spark, tmp_path):
    rows = [(n, 1, n, START + 3_600.0 * n, stamp(START + 3_600.0 * n), 1.0) for n in range(12)]
    stream = PR.last_events_stream(stream_of(spark, tmp_path / "in", rows, EVENT, 1), keep_s=7_200)
    got, query = drain(stream, spark, "update", tmp_path, "out")
    kept = [sum(o["numRowsTotal"] for o in json.loads(p.json)["stateOperators"]) for p in query.recentProgress]
    assert got.count() == 12 and max(kept) < 12


FACT = "stop_id bigint, delay_s double, event_time timestamp"
TOLD = "sample_id string, target_stop_id bigint, prediction_s double, made_time timestamp"


def test_forecasts_and_arrivals_as_two_streams(spark, tmp_path):
    told, facts = [], []
    for k in range(60):
        made = START + 300.0 * k
        told.append((f"s{k}", k, 10.0, stamp(made)))
        facts.append((k, 10.0 + k, stamp(made + 700.0)))
    told[20], told[21] = told[21], told[20]  # a late forecast
    facts[30], facts[33] = facts[33], facts[30]  # a late arrival
    told.insert(25, told[24])
    facts.insert(41, facts[40])  # repeated ones
    facts.append((59, 99.0, facts[-1][2]))  # a corrected one
    facts.append((7, 1.0, stamp(START + 300.0 * 60)))  # beyond the horizon of its forecast
    joined = PR.verified_pairs(
        stream_of(spark, tmp_path / "facts", facts, FACT, 5), stream_of(spark, tmp_path / "told", told, TOLD, 5), 1_800, 1_800
    )
    got, query = drain(joined, spark, "append", tmp_path, "out")
    errors = sorted((r.sample_id, r.abs_error_s) for r in got.collect())
    assert errors == sorted([*((f"s{k}", float(k)) for k in range(60)), ("s59", 89.0)])
    # state holds what the horizon and the allowed lateness leave, not the whole stream
    kept = [max((o["numRowsTotal"] for o in json.loads(p.json)["stateOperators"]), default=0) for p in query.recentProgress]
    assert max(kept) < 60


def test_rejects_are_counted_by_the_action_itself(spark):
    rows = [(1, None), (2, "id"), (3, "geom"), (4, "id"), (5, "odd")]
    df, seen = C.observed_rejects(spark.createDataFrame(rows, "n int, reject_reason string"))
    assert df.where("reject_reason IS NULL").count() == 1
    assert seen.get == {"rows": 5, "id": 2, "geom": 1, "time_begin": 0, "other": 1}


def test_counters_of_a_running_stream(spark, tmp_path):
    good = {"tr_id": 1, "unit_id": 2, "event_time": "2026-01-06T06:00:00Z", "lat": 1.0, "lon": 2.0, "location_valid": True,
            "speed_kmh": 1.0, "heading_deg": 1.0, "source": "replay"}
    (tmp_path / "in").mkdir()
    for k, lines in enumerate([[json.dumps(good), "{broken"], ["nope", json.dumps(good)], [json.dumps(good)]]):
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(lines) + "\n")
    parsed = R.parse_telemetry(R.read_lines(spark, str(tmp_path / "in"), 1))
    watched = C.observed_stream(parsed, "telemetry", appended=F.col("t"))
    at = datetime.datetime(2026, 1, 6, 6, 0, 7, tzinfo=datetime.timezone.utc).timestamp()
    listener = C.StreamCounters(clock=lambda: at)
    _, query = drain(watched, spark, "append", tmp_path, "out")
    for p in query.recentProgress:
        listener.take(json.loads(p.json))
        listener.take(json.loads(p.json))  # reported again
    assert listener.totals["telemetry"] == {"rows": 5, "malformed": 2, "other": 0}
    assert listener.lag_s["telemetry"] == 7.0


def test_unread_entries():
    kafka = {"endOffset": {"gps": {"0": 5, "1": 7}}, "latestOffset": {"gps": {"0": 9, "1": 7, "2": 3}}}
    assert C.unread_entries(kafka) == 7
    assert C.unread_entries({"endOffset": "3", "latestOffset": "10"}) == 7
    assert C.unread_entries({"endOffset": None, "latestOffset": 4}) == 4
    assert C.unread_entries({"endOffset": {"logOffset": 2}, "latestOffset": None}) is None
    assert S.TELEMETRY_WINDOW_S == 1_800
