"""Telemetry cleaning and normalisation. A bad measurement is blanked, the row stays."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlag import settings as S
from fleetlag.functions import scalars as X


def clean_telemetry(raw: DataFrame) -> DataFrame:
    """``tr_id, t, ok, lat, lon, speed, row_id`` with exact repeats removed.

    ``raw`` has ``tr_id, t, location_valid, lat, lon, speed, row_id``. A fix is ``ok`` when it is
    marked valid and lies in the service area; other fixes keep their time but lose coordinates,
    because their share is a feature. Repeats collapse in a partial aggregate before the shuffle.
    """
    lat, lon, speed = (X.finite(F.col(c)) for c in ("lat", "lon", "speed"))
    ok = (
        X.flag_offline("location_valid") & lat.between(*S.LAT_RANGE) & lon.between(*S.LON_RANGE)
    )
    fixes = raw.select(
        F.col("tr_id").cast("bigint").alias("tr_id"),
        F.col("t").cast("double").alias("t"),
        F.when(ok, lat).alias("lat"),
        F.when(ok, lon).alias("lon"),
        F.when(speed.between(0, S.SPEED_CAP_KMH), speed).alias("speed"),
        "row_id",
    )
    return (
        fixes.groupBy("tr_id", "t", "lat", "lon", "speed")
        .agg(F.min("row_id").alias("row_id"))
        .select("tr_id", "t", F.col("lat").isNotNull().alias("ok"), "lat", "lon", "speed", "row_id")
    )


def blank_bad_measurements(df: DataFrame) -> DataFrame:
    """Live rules for ``lat, lon, location_valid, speed_kmh, heading_deg``: world ranges."""
    lat, lon = X.finite(F.col("lat")), X.finite(F.col("lon"))
    valid = F.coalesce(
        F.col("location_valid") & lat.between(-90, 90) & lon.between(-180, 180), F.lit(False)
    )
    speed, heading = X.finite(F.col("speed_kmh")), X.finite(F.col("heading_deg"))
    return df.withColumns(
        {
            "lat": F.when(valid, lat),
            "lon": F.when(valid, lon),
            "location_valid": valid,
            "speed_kmh": F.when(speed >= 0, speed),
            "heading_deg": F.when(heading.between(0, 360), heading),
        }
    )


def resolve_vehicle(df: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Left join of the terminal → vehicle table as ``known_tr_id``.

    No forced broadcast: the optimiser broadcasts the table only while its measured size is below
    the session threshold, and splits a skewed terminal at run time otherwise.
    """
    known = vehicles.select("unit_id", F.col("tr_id").alias("known_tr_id"))
    return df.join(known, "unit_id", "left")


def normalise_records(records: DataFrame, vehicles: DataFrame, first: Column | None = None) -> DataFrame:
    """Live records with ``tr_id`` resolved, bad measurements blanked and ``reject_reason`` set.

    ``records`` has ``unit_id, event_time, tr_id_hint, lat, lon, location_valid, speed_kmh,
    heading_deg``; ``first`` is an earlier reject reason that takes precedence.
    """
    joined = resolve_vehicle(records, vehicles)
    mismatch = F.col("tr_id_hint").isNotNull() & (F.col("tr_id_hint") != F.col("known_tr_id"))
    own = (
        F.when(F.col("unit_id").isNull() | (F.col("unit_id") < 0), "unit_id")
        .when(F.col("event_time").isNull(), "event_time")
        .when(mismatch, "tr_id_mismatch")
    )
    reason = own if first is None else F.coalesce(first, own)
    return (
        blank_bad_measurements(joined)
        .withColumn("reject_reason", reason)
        .withColumnRenamed("known_tr_id", "tr_id")
        .drop("tr_id_hint")
    )


def records_from_text(rows: DataFrame, vehicles: DataFrame, zone: str) -> DataFrame:
    """CSV text rows to live records; the first failing check names the reject reason."""
    hint = F.trim(F.coalesce("tr_id", F.lit("")))
    parsed = rows.select(
        *[c for c in rows.columns if c in ("row_id", "part")],
        X.integral_id("unit_id").alias("unit_id"),
        X.iso_time("event_time", zone).alias("event_time"),
        F.when(hint != "", X.integral_id(hint)).alias("tr_id_hint"),
        (hint != "").alias("__hinted"),
        X.finite(F.col("lat")).alias("lat"),
        X.finite(F.col("lon")).alias("lon"),
        X.flag("location_valid").alias("location_valid"),
        X.finite(F.col("speed")).alias("speed_kmh"),
        X.finite(F.col("heading")).alias("heading_deg"),
    )
    first = (
        F.when(F.col("unit_id").isNull(), "unit_id")
        .when(F.col("event_time").isNull(), "event_time")
        .when(F.col("__hinted") & F.col("tr_id_hint").isNull(), "tr_id")
    )
    return (
        normalise_records(parsed, vehicles, first)
        .drop("__hinted")
        .withColumn("source", F.lit("replay"))
    )


def records_from_packets(packets: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Decoded emulator packets to live records.

    Bits 5 and 6 of ``extra_dop`` are the signs of latitude and longitude, bit 7 marks a valid
    position; coordinates come as integers of 1e-7 degree. ``shift_s`` is added to the clock.
    """

    def bit(n):
        return F.col("extra_dop").bitwiseAND(1 << n) != 0

    return normalise_records(
        packets.select(
            *[c for c in packets.columns if c in ("row_id", "run_id")],
            F.col("unit_id").cast("bigint").alias("unit_id"),
            F.timestamp_micros(
                ((F.col("timestamp") + F.col("shift_s")) * 1_000_000).cast("bigint")
            ).alias("event_time"),
            F.lit(None).cast("bigint").alias("tr_id_hint"),
            (F.when(bit(5), 1).otherwise(-1) * F.col("latitude") / 1e7).alias("lat"),
            (F.when(bit(6), 1).otherwise(-1) * F.col("longitude") / 1e7).alias("lon"),
            bit(7).alias("location_valid"),
            F.col("speed_avg").cast("double").alias("speed_kmh"),
            F.col("course").cast("double").alias("heading_deg"),
        ),
        vehicles,
    ).withColumn("source", F.lit("emulator"))


def align_clock(packets: DataFrame, anchor_s: float, t: str = "t", order: str = "row_id") -> DataFrame:
    """Add ``shift_s`` and ``aligned_t``: a run's first packet is placed at the anchor.

    The shift is one row per run (a partial aggregate) joined back on the run id.
    """
    shifts = packets.groupBy("run_id").agg(
        (F.lit(float(anchor_s)) - F.min_by(F.col(t), F.col(order))).alias("shift_s")
    )
    return packets.join(shifts, "run_id").withColumn("aligned_t", F.col(t) + F.col("shift_s"))


def one_fix_per_time(fixes: DataFrame) -> DataFrame:
    """One fix per (vehicle, time): a usable one, then one with speed, then the larger values.

    A single aggregate: no ordering of a vehicle's rows is needed.
    """
    rank = F.struct(
        F.col("ok").alias("a"),
        F.col("speed").isNotNull().alias("b"),
        F.coalesce("lon", F.lit(0.0)).alias("c"),
        F.coalesce("lat", F.lit(0.0)).alias("d"),
        F.coalesce("speed", F.lit(-1.0)).alias("e"),
    )
    best = F.max_by(F.struct("ok", "lat", "lon", "speed"), rank).alias("__b")
    return fixes.groupBy("tr_id", "t").agg(best).select("tr_id", "t", "__b.*")


def lose_position(points_fixes: DataFrame) -> DataFrame:
    """Cut or blank the fixes of a (point, fix) table that fall into the point's outage.

    Rows carry ``at, gap_s, outage`` of the point. ``silence`` drops the fixes after ``at - gap_s``,
    ``no_position`` keeps them without coordinates; other kinds change nothing.
    """
    lost = (F.col("t") > F.col("at") - F.col("gap_s")) & F.col("outage").isin("silence", "no_position")
    lost = F.coalesce(lost, F.lit(False))
    kept = points_fixes.where(~(lost & (F.col("outage") == "silence")))
    return kept.withColumns(
        {
            "ok": F.col("ok") & ~lost,
            "lat": F.when(~lost, F.col("lat")),
            "lon": F.when(~lost, F.col("lon")),
        }
    )
