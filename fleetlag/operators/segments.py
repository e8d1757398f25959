"""Running values over long ordered groups without putting a group into one task.

A plain ``Window.partitionBy(vehicle)`` sends a vehicle's whole history to a single task. Here the
history is cut into time segments: the window runs per (key, segment), a partial aggregate gives
one row per segment, and only those few rows are scanned in order to get what flows into each
segment. One vehicle holding a third of all rows is spread over as many tasks as it has segments.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Widths in seconds. Telemetry has a fix every few seconds, a plan has a stop every minute or two.
TRACK_SEGMENT_S = 3_600
PLAN_SEGMENT_S = 21_600
ID_SEGMENT = 262_144


def bucket(t, width) -> Column:
    """Number of the fixed-width bucket that holds ``t``."""
    return F.floor(_col(t) / F.lit(float(width))).cast("long")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def running(
    df: DataFrame,
    keys: list[str],
    order: list,
    seg: list,
    outs: dict[str, tuple[str, object]],
    inclusive: bool = True,
) -> DataFrame:
    """Add running values of every row within ``keys``, in ascending ``order``.

    ``seg`` are coarse, order-compatible prefixes of ``order`` (a time bucket); rows of a smaller
    ``seg`` come first. ``outs`` maps a new column to ``(kind, column)`` with kind one of ``count``,
    ``sum``, ``max``, ``min``, ``last`` (last non-null value) and ``total`` (sum over the whole
    key). With ``inclusive=False`` the row itself is left out. ``keys`` must not be null and
    ``order`` must be unique within a key, or the result is as arbitrary as any window's.
    """
    segs = [f"__s{i}" for i in range(len(seg))]
    ords = [f"__o{i}" for i in range(len(order))]
    work = df.select(
        "*",
        *[_col(c).alias(n) for n, c in zip(segs, seg, strict=True)],
        *[_col(c).alias(n) for n, c in zip(ords, order, strict=True)],
        *[
            (F.lit(1).cast("long") if kind == "count" else _col(c)).alias(f"__i_{n}")
            for n, (kind, c) in outs.items()
        ],
    )
    position = F.struct(*ords)

    def per_segment(name, kind):
        c = F.col(f"__i_{name}")
        if kind in ("count", "sum", "total"):
            return F.sum(c)
        if kind == "last":
            return F.max_by(c, F.when(c.isNotNull(), position))
        return F.max(c) if kind == "max" else F.min(c)

    totals = work.groupBy(*keys, *segs).agg(
        *[per_segment(n, kind).alias(f"__t_{n}") for n, (kind, _) in outs.items()]
    )
    before = Window.partitionBy(*keys).orderBy(*segs).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)

    def carried(name, kind):
        c = F.col(f"__t_{name}")
        if kind in ("count", "sum"):
            return F.sum(c).over(before)
        if kind == "total":
            return F.sum(c).over(whole)
        if kind == "last":
            return F.last(c, ignorenulls=True).over(before)
        return (F.max(c) if kind == "max" else F.min(c)).over(before)

    inflow = totals.select(
        *keys, *segs, *[carried(n, kind).alias(f"__c_{n}") for n, (kind, _) in outs.items()]
    )
    local = (
        Window.partitionBy(*keys, *segs)
        .orderBy(*ords)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )

    def own(name, kind):
        c = F.col(f"__i_{name}")
        if kind in ("count", "sum"):
            return F.sum(c).over(local)
        if kind == "last":
            return F.last(c, ignorenulls=True).over(local)
        return (F.max(c) if kind == "max" else F.min(c)).over(local)

    scanned = work.select(
        "*", *[own(n, kind).alias(f"__w_{n}") for n, (kind, _) in outs.items() if kind != "total"]
    )

    def joined(name, kind):
        c, w = F.col(f"__c_{name}"), F.col(f"__w_{name}")
        if kind == "total":
            return c
        if kind == "count":
            return (F.coalesce(w, F.lit(0)) + F.coalesce(c, F.lit(0))).cast("long")
        if kind == "sum":
            return F.when(w.isNull(), c).when(c.isNull(), w).otherwise(w + c)
        if kind == "last":
            return F.coalesce(w, c)
        return F.greatest(w, c) if kind == "max" else F.least(w, c)

    # a merge: both sides are as long as the table or its segments, but small files or exploded rows look few to Spark
    return scanned.hint("merge").join(inflow, [*keys, *segs]).select(
        *df.columns, *[joined(n, kind).alias(n) for n, (kind, _) in outs.items()]
    )


def previous(df, keys, order, seg, cols: dict[str, str]) -> DataFrame:
    """Values of the previous row within ``keys`` as ``{new column: column}`` (a split ``lag``)."""
    packed = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    out = running(df, keys, order, seg, {"__prev": ("last", packed)}, inclusive=False)
    return out.select(*df.columns, *[F.col(f"__prev.{n}").alias(n) for n in cols])


def islands(df, keys, order, seg, starts: Column, name: str) -> DataFrame:
    """0-based number of the island each row is in; ``starts`` marks the first row of an island."""
    flagged = df.withColumn("__start", starts.cast("int"))
    out = running(flagged, keys, order, seg, {name: ("sum", F.col("__start").cast("long"))})
    return out.withColumn(name, F.col(name) - 1).drop("__start")
