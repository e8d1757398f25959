"""Idempotent table writes and the submission file."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlag.session import cut_lineage


def new_predictions(batch: DataFrame, stored: DataFrame, order: str = "row_id") -> DataFrame:
    """Rows of a batch to insert: the first per ``sample_id``, none that is stored already."""
    first = F.min_by(F.struct(*batch.columns), F.col(order)).alias("__r")
    firsts = batch.groupBy("sample_id").agg(first).select("__r.*")
    return firsts.join(stored.select("sample_id"), "sample_id", "left_anti")


def new_telemetry(batch: DataFrame, stored: DataFrame, order: str | None = None) -> DataFrame:
    """Rows whose (run_id, source_key) is not stored; of a key repeated in the batch the first in delivery ``order``,
    or by the whole row where the batch carries no order."""
    keys = ["run_id", "source_key"]
    rest = F.struct(*[c for c in batch.columns if c not in keys])
    first = F.min_by(F.struct(*batch.columns), F.col(order) if order else rest).alias("__r")
    firsts = batch.groupBy(*keys).agg(first).select("__r.*")
    return firsts.join(stored.select(*keys), keys, "left_anti")


def append_once(batch: DataFrame, path: str, pick) -> DataFrame:
    """Append what ``pick(batch, stored)`` lets through. For use in ``foreachBatch``: a batch
    repeated after a failure adds nothing."""
    spark: SparkSession = batch.sparkSession
    try:
        stored = spark.read.schema(batch.schema).parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        stored = spark.createDataFrame([], batch.schema)
    fresh = cut_lineage(pick(batch, stored))  # what is returned is what was stored
    fresh.write.mode("append").parquet(path)
    return fresh


EVENT_KEY = ["tr_id", "stop_id", "time_plan"]


def upsert_stop_events(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored and new stop events as one table.

    A new key is inserted; for a stored key only a departure is filled in. ``collision`` marks a
    stored row whose arrival differs from the one in the batch. Both tables hold a key once.
    """
    rest = [c for c in stored.columns if c not in EVENT_KEY]
    old = stored.select(*EVENT_KEY, F.struct(*rest).alias("o"))
    new = batch.select(*EVENT_KEY, F.struct(*rest).alias("n"))
    both = old.join(new, EVENT_KEY, "full_outer")

    def pick(c):
        if c == "departure":
            return F.coalesce("n.departure", "o.departure").alias(c)
        return F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)

    collision = (
        F.col("o").isNotNull() & F.col("n").isNotNull() & (F.col("o.time_fact") != F.col("n.time_fact"))
    )
    return both.select(*EVENT_KEY, *[pick(c) for c in rest], F.coalesce(collision, F.lit(False)).alias("collision"))


def write_submission(predictions: DataFrame, path: str) -> None:
    """``sample_id;prediction`` with one decimal; refuses missing and infinite values."""
    p = F.col("prediction").cast("double")
    bad = predictions.where(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))).limit(1).count()
    if bad:
        raise ValueError("predictions hold missing or infinite values")
    predictions.select("sample_id", F.bround(p, 1).alias("prediction")).write.mode("overwrite").option(
        "sep", ";"
    ).option("header", True).csv(path)


def submission_problems(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """``problem, rows, example`` of a submission against the expected ids; empty when fine.

    ``rows`` has text ``sample_id, prediction``.
    """
    value = F.col("prediction").try_cast("double")
    finite = F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False))
    marks = rows.select("sample_id", F.lit(1).alias("got"), F.lit(0).alias("want"), (~finite).cast("int").alias("bad")).unionAll(
        expected.select("sample_id", F.lit(0), F.lit(1), F.lit(0))
    )
    per_id = marks.groupBy("sample_id").agg(
        F.sum("got").alias("got"), F.max("want").alias("want"), F.sum("bad").alias("bad")
    )
    checks = {
        "duplicated": (F.col("got") > 1, F.col("got") - 1),
        "missing": ((F.col("want") > 0) & (F.col("got") == 0), F.lit(1)),
        "unknown": ((F.col("want") == 0) & (F.col("got") > 0), F.lit(1)),
        "non_finite": (F.col("bad") > 0, F.col("bad")),
    }
    found = F.array(
        *[
            F.when(hit, F.struct(F.lit(k).alias("problem"), n.cast("bigint").alias("n")))
            for k, (hit, n) in checks.items()
        ]
    )
    return (
        per_id.select("sample_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("p"))
        .groupBy(F.col("p.problem").alias("problem"))
        .agg(F.sum("p.n").alias("rows"), F.min("sample_id").alias("example"))
    )
