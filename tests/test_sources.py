"""Files, packets, sinks and reloads."""

import struct

import pytest
from pyspark.sql import functions as F

from fleetlag.catalog import fleetday as D
from fleetlag.functions import scalars as X
from fleetlag.operators import clean as C
from fleetlag.sources import files as FL
from fleetlag.sources import packets as PK
from fleetlag.sources import sinks as SK

TRAFFIC = """packet_id,tr_id,unit_id,event_time,device_event_id,location_valid,gps_time,receive_time,lon,lat,alt,speed,heading,is_hist_data
1,7,70.0,2026-01-06 06:00:00.500000,1,True,x,x,37.6,55.7,0,12,90,False
2,7,70,2026-01-06 06:00:00.500000,1,True,x,x,37.6,55.7,0,12,90,False
3,7,70,2026-01-06 06:00:10,1,False,x,x,0,0,0,12,90,False
4,7,70,2026-01-06 06:00:20,1,True,x,x,30.0,55.7,0,200,90,False
5,8,80,2026-01-06 06:00:20,1,true,x,x,37.7,55.8,0,-1,90,False
"""
SCHEDULE = """tt_action_item_id,tr_id,time_begin,time_fact_begin,order_date,manual_fill,geom,building_address
9007199254740993,7,2026-01-06 06:10:00,2026-01-06 06:11:00,2026-01-06,False,POINT (37.6 55.7),a street
12,7,2026-01-06 06:12:00,,2026-01-06,True,POINT (37.61 55.7),b street
"""
POINTS = """sample_id,tr_id,T,target_stop_id,target_time_begin,cur_dev_s
7_1767679200,7,2026-01-06 06:00:00,12,2026-01-06 06:12:00,
"""


@pytest.fixture
def root(tmp_path):
    for part, sched, pts in (("train", "schedule.csv", "labels_train.csv"), ("validate", "schedule_plan.csv", None)):
        (tmp_path / part).mkdir()
        (tmp_path / part / "traffic.csv").write_text(TRAFFIC)
        text = SCHEDULE if part == "train" else "\n".join(",".join(c for i, c in enumerate(l.split(",")) if i != 3) for l in SCHEDULE.splitlines()) + "\n"
        (tmp_path / part / sched).write_text(text)
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "labels_train.csv").write_text(POINTS.replace("cur_dev_s", "cur_dev_s,target_delay_s").replace("06:12:00,\n", "06:12:00,,42.5\n"))
    (tmp_path / "validate" / "points.csv").write_text(POINTS)
    return tmp_path


def test_load_part(spark, root):
    part = FL.load_part(spark, str(root), "train")
    fixes = sorted(part.telemetry.collect(), key=lambda r: (r.tr_id, r.t))
    assert [(r.tr_id, r.ok, r.speed) for r in fixes] == [(7, True, 12.0), (7, False, 12.0), (7, False, None), (8, True, None)]
    assert fixes[0].t == 1767679200.5 and fixes[1].lat is None
    assert {r.stop_id for r in part.plan.collect()} == {9007199254740993, 12}
    assert "fact" not in " ".join(part.plan.columns)
    assert {r.stop_id: (r.t_fact, r.manual_fill) for r in part.facts.collect()} == {9007199254740993: (1767679860.0, False), 12: (None, True)}
    assert part.points.first().target == 42.5 and part.points.first().cur_dev_s is None
    live = FL.load_part(spark, str(root), "validate")
    assert live.facts is None and live.points.first().target is None
    with pytest.raises(ValueError, match="unknown part"):
        FL.load_part(spark, str(root), "holdout")


def test_scan_reads_only_needed_columns(spark, root):
    df = FL.read_raw_telemetry(spark, str(root / "train/traffic.csv"))
    text = df._jdf.queryExecution().executedPlan().toString()
    schema = text[text.index("ReadSchema") :]
    assert "gps_time" not in schema and "heading" not in schema and "speed" in schema


def test_header_is_checked_first(spark, tmp_path):
    (tmp_path / "a.csv").write_text("tr_id,speed\n1,2\n")
    with pytest.raises(ValueError, match="missing columns event_time, lat"):
        FL.check_header(spark, str(tmp_path / "a.csv"), ["tr_id", "lat", "event_time"])


def test_strict_rows_fail_on_short_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3\n")
    path = str(tmp_path / "a.csv")
    assert FL.read_text_rows(spark, path, ["a"]).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        FL.read_text_rows(spark, path, ["a"], strict=True).collect()


def test_repeated_stop_is_refused(spark, tmp_path):
    (tmp_path / "s.csv").write_text(SCHEDULE + SCHEDULE.splitlines()[2] + "\n")
    with pytest.raises(ValueError, match="stop id 12 appears 2 times"):
        FL.read_plan(spark, str(tmp_path / "s.csv"))


def test_reload_keeps_table_when_nothing_is_valid(spark, tmp_path):
    good = spark.createDataFrame([(1, None), (2, "id")], "stop_id bigint, reject_reason string")
    FL.replace_reference(good, None, str(tmp_path))
    bad = good.where("stop_id = 2")
    with pytest.raises(ValueError, match="no valid rows"):
        FL.replace_reference(bad, good, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "plan")).count() == 1
    assert not (tmp_path / "vehicles").exists()


def test_telemetry_sink_is_idempotent(spark, tmp_path):
    schema = "run_id bigint, source_key string, v double"
    one = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (1, "b", 2.0)], schema)
    path = str(tmp_path / "t")
    for _ in range(2):
        SK.append_once(one, path, SK.new_telemetry)
    SK.append_once(spark.createDataFrame([(2, "a", 5.0)], schema), path, SK.new_telemetry)
    assert spark.read.parquet(path).count() == 3


def test_submission_file(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.25), ("b", -2.0)], "sample_id string, prediction double")
    SK.write_submission(df, str(tmp_path / "s"))
    back = spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "s"))
    assert {(r.sample_id, float(r.prediction)) for r in back.collect()} == {("a", 1.2), ("b", -2.0)}
    assert SK.submission_problems(back, df).count() == 0
    with pytest.raises(ValueError, match="missing or infinite"):
        SK.write_submission(df.withColumn("prediction", F.lit(float("nan"))), str(tmp_path / "x"))


def test_ids_and_times(spark):
    rows = ["123.0", " 42 ", "1.5", "", "abc", "9007199254740993", "9223372036854775808", "nan"]
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    assert [r.v for r in df.select(X.integral_id("x").alias("v")).collect()] == [123, 42, None, None, None, 9007199254740993, None, None]
    times = [("2026-01-06 06:00:00", 1767668400.0), ("2026-01-06T06:00:00.25+00:00", 1767679200.25), ("2026-01-06T06:00:00Z", 1767679200.0), ("06:00", None), ("", None)]
    df = spark.createDataFrame([(t,) for t, _ in times], "x string")
    got = df.select(X.epoch_s(X.iso_time("x", "Europe/Moscow")).alias("v"), X.plan_time("x", "Europe/Moscow").alias("p")).collect()
    assert [r.v for r in got] == [v for _, v in times]
    assert [r.p is None for r in got] == [False, True, True, True, True]
    fold = spark.createDataFrame([("2025-10-26 02:30:00",), ("2025-10-26 04:30:00",)], "x string")
    assert [r.v is None for r in fold.select(X.unambiguous_time("x", "Europe/Berlin").alias("v")).collect()] == [True, False]


def test_points_of_three_strictness_levels(spark):
    df = spark.createDataFrame([("POINT (37.5 55.7)",), ("point(+37.5 55.)",), ("POINT (3e1 55)",), ("LINE (1 2)",)], "g string")
    got = df.select(*[X.wkt_point("g", s)[0].alias(s) for s in ("loose", "plain", "signed")]).collect()
    assert [tuple(r) for r in got] == [(37.5, 37.5, 37.5), (None, None, 37.5), (30.0, None, None), (None, None, None)]


# --- packets --------------------------------------------------------------------------------------


def frame(unit=77, service=1, kind=101, body=None, flags=1, signature=0x7E7E, break_crc=False, outer_flags=0):
    nav = struct.pack("<IIIBBHHHHHBB", 1767679200, 376000000, 557500000, 0b11100000, 0, 25, 0, 90, 0, 0, 0, 0)
    body = b"\0\0" + nav if body is None else body
    payload = struct.pack("<HHHI", service, kind, flags, 5) + body
    crc = PK.checksum(payload)
    crc = ((crc & 0xFF) << 8 | crc >> 8) ^ (1 if break_crc else 0)
    return struct.pack("<HHHHBIH", signature, len(payload), outer_flags, crc, 2, unit, 0) + payload


def hello(unit=77, address=77, major=6):
    return frame(unit, 0, 100, struct.pack("<HHHIII", major, 2, 0, address, 1024, 0))


def test_checksum_vector():
    assert PK.checksum(b"123456789") == 0x4B37


def test_packet_decoding(spark):
    nav = frame()[25:]
    cases = [
        (frame(), None), (hello(), None), (frame(break_crc=True), "crc"), (frame(signature=1), "signature"),
        (frame()[:10], "short_npl"), (frame()[:-3], "short_payload"), (frame(flags=0), "nph_flags"), (frame(kind=9), "expected_realtime"),
        (frame(body=b"\0\0abc"), "missing_nav"), (hello(address=5), "handshake_address"), (hello(major=5), "handshake_fields"),
        (frame(0xFFFFFFFF), None), (frame(outer_flags=3), "npl_type_or_flags"), (None, "short_npl"),
        (frame(body=nav + b"\x08\0" + b"x" * 6), None), (frame(body=nav + b"\x09\0"), None), (frame(body=nav + b"\x08\0x"), None),
        (frame(body=nav + b"\x08"), None),
    ]
    df = spark.createDataFrame([(i, bytearray(f) if f else None) for i, (f, _) in enumerate(cases)], "row_id bigint, frame binary")
    got = {r.row_id: r for r in PK.decode_frames(df).collect()}
    assert [got[i].reject_reason for i in range(len(cases))] == [r for _, r in cases]
    first = got[0]
    assert (first.unit_id, first.timestamp, first.longitude, first.latitude, first.speed_avg, first.course) == (77, 1767679200, 376000000, 557500000, 25, 90)
    assert got[1].message == "handshake" and got[1].longitude is None and got[11].unit_id == 0xFFFFFFFF
    assert [(got[i].stop_reason, got[i].stop_cell, got[i].stop_offset) for i in (14, 15, 16, 17)] == [
        (None, None, None), ("unknown_cell", 9, 28), ("short_cell", 8, 28), ("short_cell_header", 8, 28)]
    other = PK.decode_frames(df.where("row_id = 0").withColumn("expected_unit_id", F.lit(5).cast("bigint")))
    assert other.first().reject_reason == "peer_address"
    record = C.records_from_packets(
        PK.decode_frames(df.where("row_id = 0")).withColumn("shift_s", F.lit(10.0)),
        spark.createDataFrame([(77, 1)], "unit_id bigint, tr_id bigint"),
    ).first()
    assert (record.tr_id, record.lat, record.lon, record.location_valid) == (1, 55.75, 37.6, True)


def test_view_sql_order():
    sql = D.with_views("SELECT * FROM f_points")
    assert sql.index("f_plan0 AS") < sql.index("f_plan AS") < sql.index("f_points AS")


def test_an_ordered_range_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(0, 300, 1, 3).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("t"))
    got = FL.ordered_range(rows.mapInArrow(count, rows.schema), 2, 5, (3, 150)).collect()
    want = sorted((i % 7, i) for i in range(300) if 2 <= i % 7 <= 5 and (i % 7, i) > (3, 150))
    assert [(r.t, r.row_id) for r in got] == want
    assert seen.value == 300
