import json
import os

import pytest
from pyspark.sql import functions as F

import city
from fleetlag import settings as S
from fleetlag.operators import alerts as AL
from fleetlag.operators import detector as DT
from fleetlag.streaming import loop as LP
from fleetlag.streaming import processors as PR
from fleetlag.streaming import records as R
from fleetlag.session import cut_lineage


def line(tr, t, lat, lon, speed=0.0, ok=True, **extra):
    import datetime

    stamp = datetime.datetime.fromtimestamp(t, datetime.timezone.utc).isoformat()
    return json.dumps(
        {"tr_id": tr, "unit_id": 9000 + (tr or 0), "event_time": stamp, "lat": lat, "lon": lon,
         "location_valid": ok, "speed_kmh": speed, "heading_deg": 90.0, "source": "replay", **extra}
    )


def write_batches(folder, batches):
    folder.mkdir(parents=True, exist_ok=True)
    for i, lines in enumerate(batches):
        path = folder / f"{i:03d}.txt"
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in this order


def collect(query_df, spark, mode, checkpoint, target):
    q = (
        query_df.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{target}/batch={i}"))
        .outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(target)


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PR.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def world(spark):
    plan = city.plan_rows(1, 12, 120.0, start=86400.0) + city.plan_rows(2, 12, 120.0, start=86400.0, row=1)
    fixes = []
    for tr, delay in ((1, 30.0), (2, -20.0)):
        mine = [p for p in plan if p[1] == tr]
        fixes += city.track_rows(mine, [delay] * 12)
    plan_df = spark.createDataFrame(plan, city.PLAN)
    fix_df = spark.createDataFrame(fixes, city.FIX)
    return plan_df, fix_df, sorted(fixes, key=lambda f: (f[1], f[0]))


def test_json_source_rejects(spark, tmp_path):
    good = line(1, 100.0, 55.7, 37.6)
    naive = json.dumps({**json.loads(good), "event_time": "2026-01-06T06:00:00"})
    odd = json.dumps({**json.loads(good), "source": "magic"})
    write_batches(tmp_path / "in", [[good, "{broken", naive], [odd, line(None, 101.0, 55.7, 37.6), line(1, 5, 1, 2, extra=1)]])
    parsed = R.parse_telemetry(R.read_lines(spark, str(tmp_path / "in"), 1))
    out = collect(parsed, spark, "append", str(tmp_path / "ck"), str(tmp_path / "out"))
    counts = {r.reject_reason: r["count"] for r in out.groupBy("reject_reason").count().collect()}
    assert counts == {None: 2, "malformed": 4}


def test_json_sink_round_trip(spark, tmp_path):
    write_batches(tmp_path / "in", [[line(1, 100.0, 55.7, 37.6), line(None, 101.0, 55.7, 37.6)]])
    parsed = R.parse_telemetry(R.read_lines(spark, str(tmp_path / "in")))
    q = R.write_json_stream(parsed.select("tr_id", "t"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    rows = sorted(json.loads(r.value)["t"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert rows == [100.0, 101.0]


def event_key(rows):
    return sorted((r.tr_id, r.stop_id, r.time_fact, r.available_at, r.departure, r.recovered) for r in rows)


@pytest.mark.parametrize("batches", [1, 4])
def test_detector_stream_equals_batch(spark, world, tmp_path, batches):
    plan, fixes, ordered = world
    size = -(-len(ordered) // batches)
    cut = [ordered[i : i + size] for i in range(0, len(ordered), size)]
    write_batches(tmp_path / "in", [[line(f[0], f[1], f[3], f[4], f[5]) for f in part] for part in cut])
    ticks = R.parse_telemetry(R.read_lines(spark, str(tmp_path / "in"), 1)).where("reject_reason IS NULL")
    log = PR.detect_stream(ticks, plan)
    streamed = collect(log, spark, "append", str(tmp_path / "ck"), str(tmp_path / "out")).drop("batch")
    batch = DT.detect_stops(fixes.drop("row_id"), plan)
    assert event_key(DT.merge_event_log(streamed).collect()) == event_key(batch.collect())
    assert batch.count() >= 20


def test_detector_follows_the_stream_and_not_the_batch_cut(spark, world, tmp_path):
    plan, _, ordered = world
    moved = list(ordered)
    for i in range(5, len(moved) - 6, 9):  # some ticks come late
        moved[i], moved[i + 4] = moved[i + 4], moved[i]
    schema = "position bigint, tr_id bigint, t double, lat double, lon double, speed double, ok boolean"
    rows = [(n, f[0], f[1], f[3], f[4], f[5], True) for n, f in enumerate(moved)]
    late, state, seen = 0, {}, {}
    for r in rows:
        late += r[2] <= state.get(r[1], float("-inf"))
        state[r[1]] = max(r[2], state.get(r[1], float("-inf")))
    assert late
    for batches in (1, 4, 9):
        size = -(-len(rows) // batches)
        for k, i in enumerate(range(0, len(rows), size)):
            path = tmp_path / f"in{batches}" / f"{k}.json"
            path.parent.mkdir(exist_ok=True)
            spark.createDataFrame(rows[i : i + size][::-1], schema).toPandas().to_json(path, orient="records", lines=True)
            os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
        ticks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / f"in{batches}"))
        log = collect(PR.detect_stream(ticks, plan), spark, "append", str(tmp_path / f"ck{batches}"), str(tmp_path / f"out{batches}"))
        seen[batches] = event_key(DT.merge_event_log(log.drop("batch")).collect())
    assert seen[1] and seen[1] == seen[4] == seen[9]


def test_detector_initial_state(spark, world, tmp_path):
    plan, fixes, ordered = world
    half = len(ordered) // 2
    state = {}
    rows = DT.with_candidates(fixes.drop("row_id"), plan).orderBy("t", "tr_id").collect()
    first_log = []
    for r in rows:
        if r.t > ordered[half][1]:
            continue
        tick = {**r.asDict(recursive=True)}
        s = state.setdefault(r.tr_id, DT.new_state())
        first_log += [(r.tr_id, *e) for e in DT.feed(s, tick, S.DETECTOR)]
    initial = spark.createDataFrame([(k, json.dumps(v)) for k, v in state.items()], "tr_id bigint, state string")
    rest = [f for f in ordered if f[1] > ordered[half][1]]
    write_batches(tmp_path / "in", [[line(f[0], f[1], f[3], f[4], f[5]) for f in rest]])
    ticks = R.parse_telemetry(R.read_lines(spark, str(tmp_path / "in"))).where("reject_reason IS NULL")
    log = PR.detect_stream(ticks, plan, initial=initial)
    later = collect(log, spark, "append", str(tmp_path / "ck"), str(tmp_path / "out")).drop("batch")
    both = later.unionByName(spark.createDataFrame(first_log, DT.EVENTS))
    whole = DT.detect_stops(fixes.drop("row_id"), plan)
    assert event_key(DT.merge_event_log(both).collect()) == event_key(whole.collect())


def test_changed_settings_refused(spark, tmp_path):
    path = str(tmp_path / "settings")
    PR.check_saved_settings(spark, path, S.DETECTOR)
    PR.check_saved_settings(spark, path, S.DETECTOR)
    with pytest.raises(ValueError, match="other settings"):
        PR.check_saved_settings(spark, path, {**S.DETECTOR, "stop_radius_m": 60.0})
    with pytest.raises(ValueError, match="finite and positive"):
        PR.check_saved_settings(spark, path, {**S.DETECTOR, "stop_radius_m": 0.0})


def test_alert_stream_equals_batch(spark, world, tmp_path):
    plan, _, _ = world
    told, facts = [], []
    for tr in (1, 2):
        for j in range(40):
            t = 86400.0 + 30.0 * j
            stop = tr * 1000 + min(int((t - 86400 + 720) // 120), 11)
            level = "red" if (j // 3) % 3 else "green"
            told.append((f"{tr}_{j}", tr, t, stop, level, 350.0 + j))
        facts += [(tr, tr * 1000 + k, 86400.0 + 120 * k, 86400.0 + 120 * k + 400, 400.0) for k in range(12) if k % 4]
    p = spark.createDataFrame(told, "sample_id string, tr_id bigint, t double, target_stop_id bigint, risk_level string, prediction_s double")
    e = spark.createDataFrame(facts, "tr_id bigint, stop_id bigint, time_plan double, time_fact double, delay_s double")
    batch = AL.alert_lifecycle(p, plan, e, segment_s=600.0)
    log = AL.alert_log(p, plan, e)
    ordered = log.orderBy("t", "kind", "sample_id").collect()
    for i in range(0, len(ordered), 30):
        spark.createDataFrame(ordered[i : i + 30], log.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    for i, f in enumerate(files):
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = collect(PR.alert_stream(stream), spark, "append", str(tmp_path / "ck"), str(tmp_path / "out")).drop("batch")
    key = lambda df: sorted(map(str, (tuple(r) for r in df.orderBy("tr_id", "opened_at").collect())))
    assert key(AL.current_alerts(out)) == key(batch)
    assert {r.status for r in batch.collect()} >= {"confirmed", "cancelled"}


def test_window_stream_keeps_edge(spark, tmp_path):
    a = [line(1, t, 55.7, 37.6) for t in (0.0, 100.0, 1000.0)]
    b = [line(2, 1900.0, 55.7, 37.6), line(1, 1900.0, 55.7, 37.6)]
    c = [line(1, 2000.0, 55.7, 37.6)]
    write_batches(tmp_path / "in", [a, b, c])
    records = R.parse_telemetry(R.read_lines(spark, str(tmp_path / "in"), 1)).where("reject_reason IS NULL")
    out = collect(PR.window_stream(records), spark, "update", str(tmp_path / "ck"), str(tmp_path / "out"))
    last = out.where("tr_id = 1 AND last_t IS NOT NULL").orderBy(F.desc("last_t"), F.desc("batch")).first()
    assert (last.points, last.first_t, last.last_t) == (3, 1000.0, 2000.0)
    middle = out.where("tr_id = 1 AND last_t = 1900").orderBy("batch").first()
    assert middle.points == 3 and middle.first_t == 100.0


def test_verification_stream(spark, tmp_path):
    lines = [json.dumps({"tr_id": 1, "stop_id": 5, "time_plan": "2026-01-06T06:00:00Z", "time_fact": "2026-01-06T06:02:00Z", "delay_s": 120.0}), "nope"]
    write_batches(tmp_path / "in", [lines])
    events = R.parse_stop_events(R.read_lines(spark, str(tmp_path / "in"))).where("reject_reason IS NULL")
    p = spark.createDataFrame([("a", 5, 100.0), ("b", 6, 1.0)], "sample_id string, target_stop_id bigint, prediction_s double")
    out = collect(PR.verified_stream(events, p), spark, "append", str(tmp_path / "ck"), str(tmp_path / "out"))
    assert [(r.sample_id, r.abs_error_s) for r in out.collect()] == [("a", 20.0)]


def test_live_loop(spark, world, tmp_path):
    plan, fixes, ordered = world
    plan = plan.withColumn("address", F.concat(F.lit("stop "), "stop_id"))
    events = spark.createDataFrame(
        [(1, 1000 + k, 86400.0 + 120 * k, 86430.0 + 120 * k, 30.0) for k in range(12)],
        "tr_id bigint, stop_id bigint, time_plan double, time_fact double, delay_s double",
    )
    cuts = [[f for f in ordered if lo <= f[1] < lo + 45] for lo in range(86370, 86370 + 270, 45)]
    write_batches(tmp_path / "in", [[line(f[0], f[1], f[3], f[4], f[5]) for f in c] for c in cuts])
    records = R.parse_telemetry(R.read_lines(spark, str(tmp_path / "in"), 1)).where("reject_reason IS NULL")
    records = records.withColumn("row_id", F.col("t").cast("bigint") * 10 + F.col("tr_id"))
    root = str(tmp_path / "live")
    loop = LP.LiveLoop(root, plan, events, period_s=60)
    LP.run_loop(records, loop, str(tmp_path / "ck")).awaitTermination()
    states = loop.table(spark, "state").orderBy("__batch").collect()
    ticks = sorted({s.last_tick for s in states})
    assert len(states) == len(cuts) and all(b - a >= 60 for a, b in zip(ticks, ticks[1:]))
    told = loop.table(spark, "predictions").collect()
    assert len({r.sample_id for r in told}) == len(told) and {r.t for r in told} <= set(ticks)
    late = [r for r in told if r.tr_id == 1 and r.t > 86440]
    assert late and all(r.prediction_s == 30.0 for r in late)
    changes = loop.table(spark, "changes")
    assert [r.tr_id for r in changes.where("seq = 1").collect()] == [2]  # vehicle 1 starts later
    assert {r.tr_id for r in changes.collect()} == {1, 2}
    # repeating a batch writes the same again
    before = sorted(r.sample_id for r in told)
    again = cut_lineage(spark.read.parquet(f"{root}/telemetry/batch=3"))  # the loop rewrites the folder
    loop(again, 3)
    assert sorted(r.sample_id for r in loop.table(spark, "predictions").collect()) == before


@pytest.mark.parametrize("step", [225, 300, 450])
def test_alerts_of_the_running_loop_equal_the_batch_lifecycle(spark, world, tmp_path, step):
    """Arrivals come in while the loop runs, it stops and goes on."""
    plan, _, ordered = world
    plan = plan.withColumn("address", F.lit("street"))
    schema = "tr_id bigint, stop_id bigint, time_plan double, time_fact double, delay_s double"
    facts = [(tr, tr * 1000 + k, 86400.0 + 120 * k, 86400.0 + 120 * k + 30, 30.0) for tr in (1, 2) for k in range(12) if (k + tr) % 4]
    arrivals = LP.ArrivalLog(str(tmp_path / "arrivals"))

    def forecast(asked):
        red = (F.floor(F.col("T") / 150) + F.col("tr_id")) % 3 > 0
        return asked.select(
            "sample_id", F.when(red, 900.0).otherwise(10.0).alias("prediction_s"), F.lit(0.5).alias("p_late"),
            F.array(F.lit("current_delay")).alias("reasons"), F.lit("rule").alias("model_version"),
        )

    begin, end = 86370, 87270
    cuts = [[f for f in ordered if lo <= f[1] < lo + step] for lo in range(begin, end, step)]
    half, root = len(cuts) // 2, str(tmp_path / "live")
    for part, files in enumerate((cuts[:half], cuts[half:])):  # the second run is a restart
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        for i, c in enumerate(files, part * half):
            path = folder / f"{i:03d}.txt"
            path.write_text("\n".join(line(f[0], f[1], f[3], f[4], f[5]) for f in c) + "\n")
            os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
        if part == 0:
            arrivals.append(spark.createDataFrame([f for f in facts if f[3] < begin + half * step], schema), 0)
        else:
            arrivals.append(spark.createDataFrame([f for f in facts if f[3] >= begin + half * step], schema), 1)
        records = R.parse_telemetry(R.read_lines(spark, str(folder), 1)).where("reject_reason IS NULL")
        records = records.withColumn("row_id", F.col("t").cast("bigint") * 10 + F.col("tr_id"))
        loop = LP.LiveLoop(root, plan, arrivals, period_s=60, forecast=forecast)
        LP.run_loop(records, loop, str(tmp_path / "ck")).awaitTermination()
    told = loop.table(spark, "predictions").drop("__batch")
    last = loop.state(spark, len(cuts)).last_tick
    known = spark.createDataFrame([f for f in facts if f[3] <= last], schema)
    key = lambda df: sorted(str(r.asDict()) for r in df.collect())
    want = AL.alert_lifecycle(told, plan, known, segment_s=600.0)
    got = loop.alerts(spark).select(*want.columns)
    assert key(got) == key(want) and got.count() >= 1
    assert loop.alerts(spark).groupBy("tr_id", "target_stop_id", "opened_at").count().where("count > 1").isEmpty()


def test_a_tick_reads_no_more_as_the_stream_ages(spark, world, tmp_path, monkeypatch):
    plan = world[0].withColumn("address", F.lit("street"))
    loop = LP.LiveLoop(str(tmp_path / "live"), plan, LP.ArrivalLog(str(tmp_path / "none")), period_s=60)
    schema = "tr_id bigint, unit_id bigint, t double, ok boolean, lat double, lon double, speed double, row_id bigint"
    asked = []
    listed = loop._folders
    monkeypatch.setattr(loop, "_folders", lambda name, held: asked.append(len(held)) or listed(name, held))
    for i in range(6):
        rows = [(1, 9, 86400.0 + 600.0 * i + j, True, 55.75, 37.6, 0.0, 10 * i + j) for j in range(3)]
        loop(cut_lineage(spark.createDataFrame(rows, schema)), i)
    assert asked[:4] == [1, 2, 3, 4] and set(asked[3:]) == {4}  # half an hour of batches, ten minutes apart
    late = LP.ArrivalLog(str(tmp_path / "log"))
    late.append(spark.createDataFrame([(1, 5, 0.0, 3600.0 * h + 5, 1.0) for h in range(40)], LP._ARRIVALS), 0)
    late.append(spark.createDataFrame([(1, 5, 0.0, 3600.0 * h + 5, 1.0) for h in range(40)], LP._ARRIVALS), 0)
    near = late(spark, 3600.0 * 30, 3600.0 * 31 + 10)
    assert near.count() == 2 and len(near.inputFiles()) <= 2 * 8
    assert late(spark, 1e9, 1e9 + 10) is None
