"""Tables that are put in force together."""

import pytest
from pyspark.sql import functions as F

from fleetlag.sources import commits as CO


def rows(spark, root, name):
    return sorted(r.v for r in CO.read_table(spark, root, name).collect())


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v bigint")


def test_a_commit_changes_all_tables_or_none(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError, match="no such table"):
        CO.read_table(spark, root, "plan")
    assert CO.commit_tables({"plan": numbers(spark, 1), "vehicles": numbers(spark, 2)}, root) == 1
    broken = numbers(spark, 5).select(F.raise_error(F.lit("lost")).cast("bigint").alias("v"))
    with pytest.raises(Exception, match="lost"):
        CO.commit_tables({"plan": numbers(spark, 3), "vehicles": broken}, root)
    assert rows(spark, root, "plan") == [1] and rows(spark, root, "vehicles") == [2]
    assert CO.commit_tables({"plan": numbers(spark, 7, 8)}, root) == 2
    assert rows(spark, root, "plan") == [7, 8] and rows(spark, root, "vehicles") == [2]


def test_a_commit_may_read_what_it_replaces(spark, tmp_path):
    root = str(tmp_path)
    CO.commit_tables({"t": numbers(spark, 1, 2)}, root)
    CO.commit_tables({"t": CO.read_table(spark, root, "t").where("v = 2")}, root)
    assert rows(spark, root, "t") == [2]


def test_reload_is_one_change(spark, tmp_path):
    root = str(tmp_path)
    good = spark.createDataFrame([(1, None), (2, "id")], "v bigint, reject_reason string")
    CO.reload_reference(good, numbers(spark, 4), root)
    with pytest.raises(ValueError, match="no valid rows"):
        CO.reload_reference(good, good.where("v = 2"), root)
    assert rows(spark, root, "plan") == [1] and rows(spark, root, "vehicles") == [4]
    CO.reload_reference(None, numbers(spark, 6), root)
    assert rows(spark, root, "plan") == [1] and rows(spark, root, "vehicles") == [6]


def test_matcher_report_has_three_tables(spark, tmp_path):
    root = str(tmp_path)
    points = spark.createDataFrame([("a", 1.0)], "sample_id string, estimate_s double")
    event = spark.createDataFrame(
        [(1, 2, 0.0, 5.0, 6.0, None, True, 5.0, "x")],
        "tr_id bigint, stop_id bigint, time_plan double, time_fact double, available_at double, departure double, recovered boolean, "
        "delay_s double, more string",
    )
    CO.write_matcher_report(numbers(spark, 1), points, event, root)
    assert CO.read_table(spark, root, "events").columns == CO.EVENT_FIELDS
    assert [CO.read_table(spark, root, n).count() for n in ("report", "points", "events")] == [1, 1, 1]
