"""Several tables that change together.

Every table is first written to a folder of its own. One small manifest file, appended last, then names the folders of the
whole set, so a reader sees all new tables or none; a run that dies between the writes leaves the old set in force. A
table that a commit does not name keeps its folder. There is one writer at a time.
"""

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlag.sources.files import checked_reference

MANIFEST = "number bigint, commit string, tables map<string,string>"


def manifest(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """Number of the last commit and the folder of each table; 0 and none before the first."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{root}/commits")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    last = rows.agg(F.max_by(F.struct("number", "tables"), F.struct("number", "commit")).alias("m")).first().m
    return (last.number, dict(last.tables)) if last else (0, {})


def commit_tables(frames: dict[str, DataFrame], root: str) -> int:
    """Write the frames side by side and put them in force together; returns the number of the commit."""
    spark = next(iter(frames.values())).sparkSession
    number, tables = manifest(spark, root)
    mark = uuid.uuid4().hex
    folders = {name: f"{root}/{name}-{mark}" for name in frames}
    with ThreadPoolExecutor(len(frames)) as pool:
        list(pool.map(lambda name: frames[name].write.parquet(folders[name]), frames))
    row = spark.createDataFrame([(number + 1, mark, {**tables, **folders})], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return number + 1


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as of the last commit."""
    tables = manifest(spark, root)[1]
    if name not in tables:
        raise ValueError(f"{name}: no such table in {root}")
    return spark.read.parquet(tables[name])


def reload_reference(plan: DataFrame | None, vehicles: DataFrame | None, root: str) -> None:
    """Plan and vehicles of :func:`replace_reference`, as one change."""
    good = dict(checked_reference(plan, vehicles))
    if good:
        commit_tables(good, root)


EVENT_FIELDS = ["tr_id", "stop_id", "time_plan", "time_fact", "available_at", "departure", "recovered", "delay_s"]


def write_matcher_report(report: DataFrame, points: DataFrame, events: DataFrame, root: str) -> int:
    """The report row, the compared points and the recovered stop events, as one change."""
    return commit_tables({"report": report, "points": points, "events": events.select(*EVENT_FIELDS)}, root)
