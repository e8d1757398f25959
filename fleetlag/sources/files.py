"""CSV and Parquet readers. Schemas are fixed; nothing is inferred."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlag.functions import scalars as X
from fleetlag.operators.clean import clean_telemetry
from fleetlag.session import cut_lineage

# Columns of the input files, in file order.
TRAFFIC_COLUMNS = [
    "packet_id", "tr_id", "unit_id", "event_time", "device_event_id", "location_valid", "gps_time",
    "receive_time", "lon", "lat", "alt", "speed", "heading", "is_hist_data",
]
SCHEDULE_COLUMNS = [
    "tt_action_item_id", "tr_id", "time_begin", "time_fact_begin", "order_date", "manual_fill",
    "geom", "building_address",
]
POINT_COLUMNS = [
    "sample_id", "tr_id", "T", "target_stop_id", "target_time_begin", "cur_dev_s",
    "target_delay_s", "target_class",
]
REPLAY_COLUMNS = [
    "unit_id", "tr_id", "event_time", "location_valid", "lat", "lon", "speed", "heading",
]
PART_FILES = {
    "train": ("train/traffic.csv", "train/schedule.csv", "labels/labels_train.csv"),
    "test": ("test/traffic.csv", "test/schedule.csv", "labels/labels_test.csv"),
    "validate": ("validate/traffic.csv", "validate/schedule_plan.csv", "validate/points.csv"),
}


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of a CSV file (one line is read)."""
    first = spark.read.text(path).first()
    line = first.value if first else ""
    names = [x.strip().strip('"') for x in line.lstrip("﻿").split(sep)]
    return [n for n in names if n]


def check_header(spark: SparkSession, path: str, required) -> list[str]:
    """The header, or an error that lists the missing (or repeated) columns."""
    names = header_of(spark, path)
    missing = sorted(set(required) - set(names))
    if missing:
        raise ValueError(f"{path}: missing columns {', '.join(missing)}")
    if len(names) != len(set(names)):
        raise ValueError(f"{path}: repeated columns")
    return names


def read_text_rows(spark: SparkSession, path: str, required, strict: bool = False) -> DataFrame:
    """CSV rows as text. ``strict`` fails on a row whose column count differs.

    Only requested columns are parsed: Spark prunes the others inside the CSV reader.
    """
    names = check_header(spark, path, required)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "FAILFAST" if strict else "PERMISSIVE")
        .option("enforceSchema", False)
        # a pruned reader would not notice a short row
        .option("columnPruning", not strict)
        .csv(path)
    )


def read_raw_telemetry(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """The six columns cleaning needs, with ``t`` and a row id for stable order."""
    rows = read_text_rows(
        spark, path, ["tr_id", "event_time", "location_valid", "lat", "lon", "speed"]
    )
    return raw_telemetry(rows.withColumn("row_id", F.monotonically_increasing_id()), zone)


def raw_telemetry(rows: DataFrame, zone: str = "UTC") -> DataFrame:
    return rows.select(
        X.integral_id("tr_id").alias("tr_id"),
        X.epoch_s(X.iso_time("event_time", zone)).alias("t"),
        "location_valid",
        "lat",
        "lon",
        "speed",
        "row_id",
    )


def read_telemetry(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    return clean_telemetry(read_raw_telemetry(spark, path, zone))


def plan_with_reasons(rows: DataFrame, zone: str) -> DataFrame:
    """Lenient plan rows: parsed columns plus ``reject_reason`` (id, geom, time_begin)."""
    lon, lat = X.wkt_point("geom", "plain")
    parsed = rows.select(
        X.integral_id("tt_action_item_id").alias("stop_id"),
        X.integral_id("tr_id").alias("tr_id"),
        X.epoch_s(X.plan_time("time_begin", zone)).alias("t_plan"),
        lat.alias("lat"),
        lon.alias("lon"),
        F.when(F.col("building_address") != "", F.col("building_address")).alias("address"),
    )
    reason = (
        F.when(F.col("stop_id").isNull() | F.col("tr_id").isNull(), "id")
        .when(F.col("lon").isNull() | F.col("lat").isNull(), "geom")
        .when(F.col("t_plan").isNull(), "time_begin")
    )
    return parsed.withColumn("reject_reason", reason)


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNull()).drop("reject_reason")


def reject_counts(df: DataFrame) -> DataFrame:
    """Rejected rows per reason."""
    rejected = df.where(F.col("reject_reason").isNotNull())
    return rejected.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("rows"))


def strict_plan(rows: DataFrame, zone: str = "UTC") -> DataFrame:
    """Plan rows for offline work; fact columns are not taken along."""
    lon, lat = X.wkt_point("geom", "loose")
    refuse = F.raise_error(F.concat(F.lit("cannot read the place "), F.coalesce("geom", F.lit("(none)")))).cast("double").isNotNull()
    # a row filter, so that it runs whatever columns are asked for
    return rows.where(F.when(lat.isNull() | lon.isNull(), refuse).otherwise(True)).select(
        F.col("tt_action_item_id").cast("bigint").alias("stop_id"),
        F.col("tr_id").cast("bigint").alias("tr_id"),
        X.epoch_s(X.iso_time("time_begin", zone)).alias("t_plan"),
        lat.alias("lat"),
        lon.alias("lon"),
        F.col("building_address").alias("address"),
    )


def repeated_stops(plan: DataFrame) -> DataFrame:
    return plan.groupBy("stop_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def read_plan(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """Strict plan: a repeated stop id is an error."""
    rows = read_text_rows(
        spark, path, ["tt_action_item_id", "tr_id", "time_begin", "geom", "building_address"]
    )
    plan = strict_plan(rows, zone)
    twice = repeated_stops(plan).first()
    if twice:
        raise ValueError(f"{path}: stop id {twice.stop_id} appears {twice.n} times")
    return plan


def facts_of(rows: DataFrame, zone: str = "UTC") -> DataFrame:
    """``stop_id, t_fact, manual_fill``; blank and null-like fact texts are NULL."""
    text = F.trim(F.col("time_fact_begin"))
    known = ~F.lower(text).isin("", "nan", "null", "none")
    return rows.select(
        X.integral_id("tt_action_item_id").alias("stop_id"),
        X.epoch_s(F.when(known, X.iso_time(text, zone))).alias("t_fact"),
        X.flag_offline("manual_fill").alias("manual_fill"),
    )


def points_of(rows: DataFrame, part: str, zone: str = "UTC") -> DataFrame:
    """Forecast points; a missing label column reads as NULL."""
    target = F.col("target_delay_s") if "target_delay_s" in rows.columns else F.lit(None)
    return rows.select(
        F.col("sample_id").cast("string").alias("sample_id"),
        F.col("tr_id").cast("bigint").alias("tr_id"),
        X.epoch_s(X.iso_time("T", zone)).alias("T"),
        F.col("target_stop_id").cast("bigint").alias("target_stop_id"),
        X.epoch_s(X.iso_time("target_time_begin", zone)).alias("t_target"),
        X.finite(F.col("cur_dev_s")).alias("cur_dev_s"),
        X.finite(target.cast("string")).alias("target"),
        F.lit(part).alias("part"),
    )


@dataclass
class Part:
    """The frames of one part. Facts are apart from the plan so they cannot reach features."""

    name: str
    telemetry: DataFrame
    plan: DataFrame
    points: DataFrame
    facts: DataFrame | None


def load_part(spark: SparkSession, root: str, name: str, zone: str = "UTC") -> Part:
    if name not in PART_FILES:
        raise ValueError(f"unknown part {name!r}, expected one of {', '.join(PART_FILES)}")
    traffic, schedule, points = (f"{root}/{f}" for f in PART_FILES[name])
    required = ["sample_id", "tr_id", "T", "target_stop_id", "target_time_begin", "cur_dev_s"]
    has_facts = "time_fact_begin" in header_of(spark, schedule)
    tag = F.lit(name)
    return Part(
        name,
        read_telemetry(spark, traffic, zone).withColumn("part", tag),
        read_plan(spark, schedule, zone).withColumn("part", tag),
        points_of(read_text_rows(spark, points, required), name, zone),
        facts_of(read_text_rows(spark, schedule, ["time_fact_begin", "manual_fill"]), zone)
        if has_facts
        else None,
    )


def terminal_vehicles(rows: DataFrame) -> DataFrame:
    """Terminal → vehicle pairs: the first mapping seen wins, ``conflicts`` counts the others.

    ``rows`` has text ``unit_id, tr_id`` and ``row_id``. Pairs are counted first, so the second
    step sees one row per distinct pair whatever the size of the input.
    """
    pairs = (
        rows.select(X.integral_id("unit_id").alias("unit_id"), X.integral_id("tr_id").alias("tr_id"), "row_id")
        .where(F.col("unit_id").isNotNull() & F.col("tr_id").isNotNull())
        .groupBy("unit_id", "tr_id")
        .agg(F.min("row_id").alias("first"), F.count(F.lit(1)).alias("n"))
    )
    chosen = pairs.groupBy("unit_id").agg(
        F.min_by(F.struct("tr_id", "n"), "first").alias("c"), F.sum("n").alias("all")
    )
    return chosen.select("unit_id", "c.tr_id", (F.col("all") - F.col("c.n")).alias("conflicts"))


def ordered_range(rows: DataFrame, start: float, end: float, after: tuple[float, int] | None = None) -> DataFrame:
    """Rows with ``start <= t <= end`` strictly after the cursor ``(t, row_id)``, in order.

    The kept rows are written once: a global sort reads its input twice, for its bounds and for its rows, and would read
    and parse the whole input again.
    """
    keep = F.col("t").between(float(start), float(end))
    if after is not None:
        keep &= F.struct(F.col("t"), F.col("row_id")) > F.struct(
            F.lit(float(after[0])).alias("t"), F.lit(after[1]).cast("bigint").alias("row_id")
        )
    return cut_lineage(rows.where(keep)).orderBy("t", "row_id")


def range_counts(rows: DataFrame, start: float, end: float, after: tuple[float, int]) -> DataFrame:
    """How many rows were read, unreadable, inside the range, and still to play."""
    inside = F.col("t").between(float(start), float(end))
    later = (F.col("t") > after[0]) | ((F.col("t") == after[0]) & (F.col("row_id") > after[1]))
    return rows.agg(
        F.count(F.lit(1)).alias("read"),
        F.count_if(F.col("t").isNull()).alias("bad"),
        F.count_if(inside).alias("selected"),
        F.count_if(inside & later).alias("to_play"),
    )


def write_parts(table: DataFrame, path: str) -> None:
    """Feature table, one directory per part."""
    table.write.mode("overwrite").partitionBy("part").parquet(path)


def read_parts(spark: SparkSession, path: str, schema: T.StructType, parts: list[str]) -> DataFrame:
    """Chosen parts; the others are pruned by directory."""
    return spark.read.schema(schema).parquet(path).where(F.col("part").isin(*parts))


def checked_reference(plan: DataFrame | None, vehicles: DataFrame | None) -> list[tuple[str, DataFrame]]:
    """Name and accepted rows of the given tables; one that has rows but none valid is an error."""
    good = []
    for name, df in (("plan", plan), ("vehicles", vehicles)):
        if df is None:
            continue
        ok = df if "reject_reason" not in df.columns else accepted(df)
        if ok.isEmpty() and not df.isEmpty():
            raise ValueError(f"{name}: no valid rows, the stored table is kept")
        good.append((name, ok))
    return good


def replace_reference(plan: DataFrame | None, vehicles: DataFrame | None, root: str) -> None:
    """Rewrite the plan and vehicle tables, one after the other. A missing input leaves its table alone; an input that
    has rows but none valid is an error and touches nothing. ``commits.reload_reference`` changes both at once."""
    for name, ok in checked_reference(plan, vehicles):
        ok.write.mode("overwrite").parquet(f"{root}/{name}")
