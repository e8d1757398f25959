"""JSON streams in and out."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlag.functions import scalars as X

# Record fields and sources.
TELEMETRY = (
    "tr_id bigint, unit_id bigint, event_time string, lat double, lon double, location_valid boolean,"
    " speed_kmh double, heading_deg double, source string, __bad string"
)
STOP_EVENT = "tr_id bigint, stop_id bigint, time_plan string, time_fact string, delay_s double, __bad string"
SOURCES = ("replay", "emulator", "emulator_replay")

_ZONED = r"T?.*(Z|[+-]\d{2}:?\d{2})$"


def read_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of text lines from a folder. For Kafka use ``value`` of its source the same way."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    return lines.select(F.from_json("value", schema, options).alias("r"), F.json_object_keys("value").alias("keys"))


def _unknown_keys(schema: str) -> Column:
    known = F.array(*[F.lit(p.split()[0]) for p in schema.split(", ") if not p.startswith("__")])
    return F.size(F.array_except("keys", known)) > 0


def _zoned_time(name: str) -> Column:
    """A time with an explicit offset; a naive one is refused."""
    text = F.col(name)
    return F.when(text.rlike(_ZONED), X.iso_time(text, "UTC"))


def parse_telemetry(lines: DataFrame) -> DataFrame:
    """Records with ``t`` (epoch seconds) and ``reject_reason`` = ``malformed`` where the line is
    not JSON, has unknown fields, an unknown source, or a time without offset."""
    flat = _parsed(lines, TELEMETRY).select("r.*", "keys")
    flat = flat.withColumn("event_time", _zoned_time("event_time"))
    broken = (
        F.col("__bad").isNotNull()
        | F.col("keys").isNull()
        | _unknown_keys(TELEMETRY)
        | F.col("unit_id").isNull()
        | F.col("event_time").isNull()
        | F.col("location_valid").isNull()
        | ~F.col("source").isin(*SOURCES)
        | F.col("source").isNull()
    )
    return flat.select(
        "tr_id", "unit_id", "event_time", X.epoch_s("event_time").alias("t"),
        F.col("location_valid").alias("ok"), "lat", "lon", F.col("speed_kmh").alias("speed"), "heading_deg", "source",
        F.when(F.coalesce(broken, F.lit(True)), "malformed").alias("reject_reason"),
    )


def parse_stop_events(lines: DataFrame) -> DataFrame:
    flat = _parsed(lines, STOP_EVENT).select("r.*", "keys")
    plan_t, fact_t = _zoned_time("time_plan"), _zoned_time("time_fact")
    flat = flat.withColumns({"p": plan_t, "f": fact_t})
    broken = (
        F.col("__bad").isNotNull()
        | F.col("keys").isNull()
        | _unknown_keys(STOP_EVENT)
        | F.col("tr_id").isNull()
        | F.col("stop_id").isNull()
        | F.col("p").isNull()
        | F.col("f").isNull()
        | F.col("delay_s").isNull()
    )
    return flat.select(
        "tr_id", "stop_id", X.epoch_s("p").alias("time_plan"), X.epoch_s("f").alias("time_fact"), "delay_s",
        F.col("f").alias("event_time"),
        F.when(F.coalesce(broken, F.lit(True)), "malformed").alias("reject_reason"),
    )


def json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON text, NULL fields included."""
    fields = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value"))


def write_json_stream(df: DataFrame, path: str, checkpoint: str):
    """A started append query of JSON lines to a folder."""
    return (
        json_lines(df).writeStream.format("text").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
