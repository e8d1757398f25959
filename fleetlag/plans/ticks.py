"""Scoring moments on the event clock."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlag import settings as S
from fleetlag.operators.folds import segmented_fold
from fleetlag.operators.segments import bucket

TICK_SEGMENT_S = 86_400


def _tick_step(period_s):
    def step(records, last):
        ticks = []
        for r in records:
            if last is None or r["clock"] - last >= period_s:
                last = r["clock"]
                ticks.append((last,))
        return ticks, last

    return step


def tick_times(clocked: DataFrame, period_s: float = S.SCORING_PERIOD_S) -> DataFrame:
    """Moments T at which the fleet is scored: the first clock value, then each first value at
    least a period later. Missed periods are skipped.

    Only distinct clock values matter, at most one per second of the day, so a day's segment is
    small whatever the fleet's size; segments are folded in parallel and corrected.
    """
    values = clocked.select("clock").distinct().select(
        F.lit(0).alias("k"), "clock", bucket("clock", TICK_SEGMENT_S).alias("seg")
    )
    out = T.StructType([T.StructField("tick_t", T.DoubleType())])
    return segmented_fold(values, ["k"], "seg", ["clock"], _tick_step(period_s), out)
