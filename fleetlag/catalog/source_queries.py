"""Readers, record normalisation and cleaning over the derived text tables."""

import pyarrow as pa
from pyspark.sql import functions as F

from fleetlag.catalog import fleetday as D
from fleetlag.catalog.registry import query
from fleetlag.functions import scalars as X
from fleetlag.operators import clean as C
from fleetlag.sources import files as files_
from fleetlag.sources import sinks
from fleetlag.sources.packets import checksum, decode_frames

ZONE = "Europe/Moscow"

_RAW = {
    "f_raw": """SELECT row_id, try_cast(nullif(trim(tr_id), '') AS BIGINT) AS tr_id,
      CASE WHEN try_cast(trim(unit_id) AS DECIMAL(38,18)) IS NOT NULL THEN CAST(try_cast(trim(unit_id) AS DOUBLE) AS BIGINT) END AS unit_id,
      epoch_us(try_cast(event_time AS TIMESTAMP)) / 1e6::DOUBLE AS t, location_valid, lat, lon, speed, heading,
      trim(tr_id) <> '' AS hinted FROM f_telemetry_raw""",
    "f_rec": """SELECT r.*, v.tr_id AS known,
      CASE WHEN r.unit_id IS NULL THEN 'unit_id' WHEN r.t IS NULL THEN 'event_time'
           WHEN r.hinted AND r.tr_id IS NULL THEN 'tr_id' WHEN r.tr_id <> v.tr_id THEN 'tr_id_mismatch' END AS reject_reason,
      location_valid = 'True' AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AS valid
      FROM f_raw r LEFT JOIN (SELECT * FROM f_vehicles WHERE unit_id % 7 <> 0) v ON v.unit_id = r.unit_id""",
    "f_lenient": """SELECT stop_id, tr_id, t_plan, lat, lon, address, CASE WHEN stop_id IS NULL OR tr_id IS NULL THEN 'id' WHEN lon IS NULL OR lat IS NULL THEN 'geom'
      WHEN t_plan IS NULL THEN 'time_begin' END AS reject_reason FROM (SELECT
      CAST(try_cast(tt_action_item_id AS DECIMAL(38,18)) AS BIGINT) AS stop_id, CAST(tr_id AS BIGINT) AS tr_id,
      epoch_us(try_cast(left(time_begin, 26) AS TIMESTAMP)) / 1e6::DOUBLE - 10800 AS t_plan,
      try_cast(regexp_extract(geom, '^POINT \\(([0-9.]+) ([0-9.]+)\\)$', 2) AS DOUBLE) AS lat,
      try_cast(regexp_extract(geom, '^POINT \\(([0-9.]+) ([0-9.]+)\\)$', 1) AS DOUBLE) AS lon,
      building_address AS address FROM f_plan_raw)""",
}


def _known_vehicles(spark, sf):
    return D.vehicles(spark, sf).where("unit_id % 7 <> 0")


def _records(spark, sf):
    return C.records_from_text(D.telemetry_raw(spark, sf), _known_vehicles(spark, sf), "UTC")


@query("S1", "SELECT row_id, tr_id, t, location_valid, round(lat, 6) AS lat, round(lon, 6) AS lon, speed FROM f_raw", _RAW)
def telemetry_scan(spark, sf):
    raw = files_.raw_telemetry(D.telemetry_raw(spark, sf))
    return raw.select(
        "row_id", "tr_id", "t", "location_valid", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "speed"
    )


@query("S4", "SELECT stop_id, tr_id, t_plan, lat, lon, address FROM f_lenient WHERE reject_reason IS NULL", _RAW)
def lenient_plan_scan(spark, sf):
    return files_.accepted(files_.plan_with_reasons(D.plan_raw(spark, sf), ZONE))


@query("S4 A15", "SELECT reject_reason, count(*) AS rows FROM f_lenient WHERE reject_reason IS NOT NULL GROUP BY 1", _RAW)
def plan_reject_counts(spark, sf):
    return files_.reject_counts(files_.plan_with_reasons(D.plan_raw(spark, sf), ZONE))


@query("S5", "SELECT stop_id, tr_id, t_plan, lat, lon, address FROM f_plan WHERE stop_id % 101 <> 0 AND stop_id % 89 <> 0 AND stop_id % 97 <> 0 AND stop_id % 10 <> 1 AND stop_id % 7 <> 0")
def strict_plan_scan(spark, sf):
    clean = D.plan_raw(spark, sf).where(
        "geom not like '%,%' AND time_begin rlike '^[0-9-]+ [0-9:]+$' AND tt_action_item_id rlike '^[0-9]+$'"
    )
    return files_.strict_plan(clean)


@query("S5", "SELECT stop_id % 500 AS stop_id, count(*) AS n FROM f_plan GROUP BY 1 HAVING count(*) > 1")
def repeated_stop_ids(spark, sf):
    return files_.repeated_stops(D.plan(spark, sf).withColumn("stop_id", F.col("stop_id") % 500))


@query("S6", "SELECT stop_id, CASE WHEN stop_id % 4 > 0 THEN t_fact END AS t_fact, manual_fill FROM f_facts")
def facts_scan(spark, sf):
    rows = D.facts(spark, sf).select(
        F.col("stop_id").cast("string").alias("tt_action_item_id"),
        F.expr(
            "CASE WHEN stop_id % 8 = 0 THEN ' ' WHEN stop_id % 4 = 0 THEN 'NaN'"
            " ELSE date_format(timestamp_seconds(t_fact), 'yyyy-MM-dd HH:mm:ss') END"
        ).alias("time_fact_begin"),
        F.initcap(F.col("manual_fill").cast("string")).alias("manual_fill"),
    )
    return files_.facts_of(rows)


@query("S7", "SELECT sample_id, tr_id, T, target_stop_id, t_target, cur_dev_s, CASE WHEN part <> 'validate' THEN target END AS target, part FROM f_points")
def points_scan(spark, sf):
    p = D.points(spark, sf)

    def text(part, with_target):
        rows = p.where(F.col("part") == part).select(
            "sample_id",
            F.col("tr_id").cast("string").alias("tr_id"),
            F.date_format(F.timestamp_seconds("T"), "yyyy-MM-dd HH:mm:ss").alias("T"),
            F.col("target_stop_id").cast("string").alias("target_stop_id"),
            F.date_format(F.timestamp_seconds("t_target"), "yyyy-MM-dd HH:mm:ss").alias("target_time_begin"),
            F.coalesce(F.col("cur_dev_s").cast("string"), F.lit("")).alias("cur_dev_s"),
            F.col("target").cast("string").alias("target_delay_s"),
        )
        return files_.points_of(rows if with_target else rows.drop("target_delay_s"), part)

    return text("train", True).unionByName(text("test", True)).unionByName(text("validate", False))


@query("S9", "SELECT sample_id, T, target, part FROM f_points WHERE part IN ('train', 'test')")
def part_table_round_trip(spark, sf):
    from fleetlag.session import scratch_path

    table = D.points(spark, sf).select("sample_id", "T", "target", "part")
    path = scratch_path(spark, "parts")
    files_.write_parts(table, path)
    return files_.read_parts(spark, path, table.schema, ["train", "test"])


@query(
    "S10",
    """SELECT unit_id, arg_min(tr_id, row_id) AS tr_id, count(*) - count_if(tr_id = f) AS conflicts FROM (
       SELECT *, first_value(tr_id) OVER (PARTITION BY unit_id ORDER BY row_id) AS f FROM f_raw
       WHERE unit_id IS NOT NULL AND tr_id IS NOT NULL) GROUP BY unit_id""",
    _RAW,
)
def terminal_vehicles(spark, sf):
    return files_.terminal_vehicles(D.telemetry_raw(spark, sf))


@query(
    "S15 J11",
    """SELECT sample_id, prediction_s FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY row_id) AS rn, sid AS sample_id2 FROM (
         SELECT tr_id * 1000 + i AS row_id, tr_id || '_' || (i // 2) AS sid, tr_id || '_' || (i // 2) AS sample_id, prediction_s, i FROM f_predictions))
       WHERE rn = 1 AND sample_id NOT IN (SELECT tr_id || '_' || (i // 2) FROM f_predictions WHERE i % 10 = 0)""",
)
def prediction_sink(spark, sf):
    p = D.predictions(spark, sf).select(
        (F.col("tr_id") * 1000 + F.col("i")).alias("row_id"),
        F.expr("concat_ws('_', tr_id, i div 2)").alias("sample_id"),
        "prediction_s",
        "i",
    )
    stored = p.where("i % 10 = 0")
    return sinks.new_predictions(p.drop("i"), stored).select("sample_id", "prediction_s")


_STORED = {
    "f_old": "SELECT *, CASE WHEN stop_id % 3 = 0 THEN time_fact + 20 END AS departure FROM f_stop_events WHERE stop_id % 2 = 0",
    "f_new": """SELECT tr_id, stop_id, time_plan, time_fact + CASE WHEN stop_id % 14 = 0 THEN 5 ELSE 0 END AS time_fact, delay_s, available_at,
       CASE WHEN stop_id % 5 = 0 THEN time_fact + 30 END AS departure FROM f_stop_events WHERE stop_id % 4 < 3""",
}


@query(
    "S16",
    """SELECT coalesce(o.stop_id, n.stop_id) AS stop_id, coalesce(o.time_fact, n.time_fact) AS time_fact,
       coalesce(n.departure, o.departure) AS departure, coalesce(o.time_fact <> n.time_fact, false) AS collision
       FROM f_old o FULL JOIN f_new n ON o.stop_id = n.stop_id""",
    _STORED,
)
def stop_event_upsert(spark, sf):
    e = D.stop_events(spark, sf)
    old = e.where("stop_id % 2 = 0").withColumn("departure", F.expr("CASE WHEN stop_id % 3 = 0 THEN time_fact + 20 END"))
    new = e.where("stop_id % 4 < 3").withColumn("departure", F.expr("CASE WHEN stop_id % 5 = 0 THEN time_fact + 30 END"))
    new = new.withColumn("time_fact", F.expr("time_fact + CASE WHEN stop_id % 14 = 0 THEN 5 ELSE 0 END"))
    return sinks.upsert_stop_events(old, new).select("stop_id", "time_fact", "departure", "collision")


_START, _END, _CUR = 1767680000, 1767688000, (1767682000, 5000)


@query("S20", f"SELECT row_id, t FROM f_raw WHERE t BETWEEN {_START} AND {_END} AND (t > {_CUR[0]} OR (t = {_CUR[0]} AND row_id > {_CUR[1]}))", _RAW)
def resumed_range(spark, sf):
    raw = files_.raw_telemetry(D.telemetry_raw(spark, sf))
    return files_.ordered_range(raw.select("row_id", "t"), _START, _END, _CUR)


@query(
    "S20",
    f"""SELECT count(*) AS read, count_if(t IS NULL) AS bad, count_if(t BETWEEN {_START} AND {_END}) AS selected,
    count_if(t BETWEEN {_START} AND {_END} AND (t > {_CUR[0]} OR (t = {_CUR[0]} AND row_id > {_CUR[1]}))) AS to_play FROM f_raw""",
    _RAW,
)
def range_counts(spark, sf):
    return files_.range_counts(files_.raw_telemetry(D.telemetry_raw(spark, sf)), _START, _END, _CUR)


@query("P1", "SELECT row_id, tr_id, t, ok, round(lat, 6) AS lat, round(lon, 6) AS lon, speed FROM f_clean")
def clean_telemetry(spark, sf):
    return C.clean_telemetry(_raw_fixes(spark, sf)).select(
        "row_id", "tr_id", "t", "ok", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "speed"
    )


def _raw_fixes(spark, sf):
    return D.telemetry(spark, sf).withColumn("location_valid", F.col("ok").cast("string"))


@query(
    "P2 J1",
    """SELECT row_id, unit_id, known AS tr_id, valid AS location_valid, round(CASE WHEN valid THEN lat END, 6) AS lat,
       round(CASE WHEN valid THEN lon END, 6) AS lon, CASE WHEN speed >= 0 THEN speed END AS speed_kmh,
       CASE WHEN heading BETWEEN 0 AND 360 THEN heading END AS heading_deg FROM f_rec WHERE reject_reason IS NULL""",
    _RAW,
)
def normalised_records(spark, sf):
    good = files_.accepted(_records(spark, sf))
    return good.select(
        "row_id", "unit_id", "tr_id", "location_valid", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "speed_kmh", "heading_deg"
    )


@query("P3", "SELECT row_id, reject_reason FROM f_rec", _RAW)
def record_reject_reasons(spark, sf):
    return _records(spark, sf).select("row_id", "reject_reason")


@query("A15", "SELECT reject_reason, count(*) AS rows FROM f_rec WHERE reject_reason IS NOT NULL GROUP BY 1", _RAW)
def reject_counters(spark, sf):
    return files_.reject_counts(_records(spark, sf))


_PACKETS = {
    "f_packets": """SELECT row_id, unit_id, user_run AS run_id, CAST(t AS BIGINT) AS timestamp, CAST(round(lon * 1e7) AS BIGINT) AS longitude,
       CAST(round(lat * 1e7) AS BIGINT) AS latitude, k % 2 * 32 + (k // 2) % 2 * 64 + (CASE WHEN ok THEN 128 ELSE 0 END) AS extra_dop,
       k AS speed_avg, k * 5 AS course FROM (SELECT *, unit_id % 5 AS user_run FROM f_telemetry)"""
}


def _packets(spark, sf):
    return D.telemetry(spark, sf).select(
        "row_id",
        "unit_id",
        F.expr("unit_id % 5").alias("run_id"),
        F.col("t").cast("bigint").alias("timestamp"),
        F.round(F.col("lon") * 1e7).cast("bigint").alias("longitude"),
        F.round(F.col("lat") * 1e7).cast("bigint").alias("latitude"),
        F.expr("k % 2 * 32 + (k div 2) % 2 * 64 + CASE WHEN ok THEN 128 ELSE 0 END").alias("extra_dop"),
        F.col("k").alias("speed_avg"),
        (F.col("k") * 5).alias("course"),
    )


@query(
    "P4",
    """SELECT p.row_id, v.tr_id, CAST(timestamp + 3600.5 AS DOUBLE) AS t, extra_dop & 128 > 0 AS location_valid,
       CASE WHEN extra_dop & 128 > 0 THEN (CASE WHEN extra_dop & 32 > 0 THEN 1 ELSE -1 END) * latitude / 1e7::DOUBLE END AS lat,
       CASE WHEN extra_dop & 128 > 0 THEN (CASE WHEN extra_dop & 64 > 0 THEN 1 ELSE -1 END) * longitude / 1e7::DOUBLE END AS lon,
       CAST(speed_avg AS DOUBLE) AS speed_kmh, CASE WHEN course <= 360 THEN CAST(course AS DOUBLE) END AS heading_deg
       FROM f_packets p LEFT JOIN f_vehicles v USING (unit_id)""",
    _PACKETS,
)
def packet_records(spark, sf):
    packets = _packets(spark, sf).withColumn("shift_s", F.lit(3600.5))
    out = C.records_from_packets(packets, D.vehicles(spark, sf))
    return out.select(
        "row_id", "tr_id", F.round(X.epoch_s("event_time"), 3).alias("t"), "location_valid", "lat", "lon", "speed_kmh", "heading_deg"
    )


@query(
    "P5",
    """SELECT row_id, timestamp + 1700000000 - first_value(timestamp) OVER (PARTITION BY run_id ORDER BY row_id) AS aligned_t FROM f_packets""",
    _PACKETS,
)
def aligned_clock(spark, sf):
    out = C.align_clock(_packets(spark, sf), 1700000000, t="timestamp")
    return out.select("row_id", F.col("aligned_t").cast("bigint").alias("aligned_t"))


@query(
    "W13",
    """SELECT tr_id, t, ok, round(CASE WHEN ok THEN lat END, 6) AS lat, round(CASE WHEN ok THEN lon END, 6) AS lon, speed FROM (
       SELECT *, row_number() OVER (PARTITION BY tr_id, t ORDER BY ok DESC, sp IS NOT NULL DESC, CASE WHEN ok THEN lon ELSE 0 END DESC,
         CASE WHEN ok THEN lat ELSE 0 END DESC, coalesce(sp, -1) DESC) AS rn FROM (SELECT *, speed AS sp FROM f_telemetry)) WHERE rn = 1""",
)
def one_fix_per_time(spark, sf):
    fixes = C.clean_telemetry(_raw_fixes(spark, sf))
    return C.one_fix_per_time(fixes).select(
        "tr_id", "t", "ok", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "speed"
    )


def _seal(batches):
    """Join frame heads and payloads with the checksum of the payload between them."""
    for b in batches:
        frames = []
        for row_id, head, tail, payload in zip(*[b.column(c).to_pylist() for c in ("row_id", "head", "tail", "payload")]):
            crc = checksum(payload) ^ (1 if row_id % 50 == 0 else 0)
            frames.append(head + bytes([crc >> 8, crc & 0xFF]) + tail + payload)
        yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(frames, pa.binary())], names=["row_id", "frame"])


@query(
    "S19",
    """SELECT row_id, unit_id, 'realtime' AS message, CASE WHEN r IS NULL THEN timestamp END AS timestamp, CASE WHEN r IS NULL THEN longitude END AS longitude,
       CASE WHEN r IS NULL THEN latitude END AS latitude, CASE WHEN r IS NULL THEN extra_dop END AS extra_dop, CASE WHEN r IS NULL THEN speed_avg END AS speed_avg,
       CASE WHEN r IS NULL THEN course END AS course, CASE WHEN r IS NULL AND row_id % 3 = 0 THEN 'unknown_cell' END AS stop_reason, r AS reject_reason
       FROM (SELECT *, CASE WHEN row_id % 77 = 0 THEN 'signature' WHEN row_id % 50 = 0 THEN 'crc' END AS r FROM f_packets)""",
    _PACKETS,
)
def packet_frames(spark, sf):
    """Frames built from the telemetry, some damaged, then decoded."""
    def le(c, size):
        h = F.lpad(F.hex(F.col(c) if isinstance(c, str) else F.lit(c)), 2 * size, "0")
        return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])

    signature = F.when(F.col("row_id") % 77 == 0, F.lit("0000")).otherwise(F.lit("7E7E"))
    cell = F.when(F.col("row_id") % 3 == 0, F.lit("09")).otherwise(F.lit("08"))
    nav = F.concat(
        le("timestamp", 4), le("longitude", 4), le("latitude", 4), le("extra_dop", 1), le(0, 1), le("speed_avg", 2),
        le(0, 2), le("course", 2), le(0, 2), le(0, 2), le(0, 1), le(0, 1),
    )
    payload = F.concat(le(1, 2), le(101, 2), le(1, 2), le(7, 4), le(0, 2), nav, cell, F.lit("00" * 7))
    parts = _packets(spark, sf).select(
        "row_id",
        F.unhex(F.concat(signature, le(46, 2), le(0, 2))).alias("head"),
        F.unhex(F.concat(le(2, 1), le("unit_id", 4), le(0, 2))).alias("tail"),
        F.unhex(payload).alias("payload"),
    )
    frames = parts.mapInArrow(_seal, "row_id bigint, frame binary")
    return decode_frames(frames).drop("stop_cell", "stop_offset")
