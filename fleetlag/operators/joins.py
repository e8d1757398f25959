"""As-of, interval and alignment joins composed from unions, windows and equi joins."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlag.operators.segments import TRACK_SEGMENT_S, bucket, running


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_t: str,
    right_t: str,
    take: dict[str, str],
    tie: list[str] = (),
    width: float = TRACK_SEGMENT_S,
    strict: bool = False,
) -> DataFrame:
    """Every left row with the last right row of the same key at or before its time.

    ``take`` maps result columns to right columns; ``tie`` orders right rows of equal time, the
    last one wins. ``strict`` asks for right rows strictly before. Left rows without a match keep
    NULLs. Nothing is multiplied: both sides meet in one union scanned in time order, cut into
    time segments.
    """
    found = {"__m": F.struct(*[F.col(c).alias(n) for n, c in take.items()])}
    out = asof_many(left, right, keys, left_t, right_t, found, tie, width, strict)
    return out.select(*left.columns, *[F.col(f"__m.{n}").alias(n) for n in take])


def asof_many(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_t: str,
    right_t: str,
    take: dict[str, Column],
    tie: list[str] = (),
    width: float = TRACK_SEGMENT_S,
    strict: bool = False,
) -> DataFrame:
    """Several as-of lookups in one scan: each ``take`` is an expression over the right table, and
    the last right row where it is not null supplies the value."""
    left_side, right_side = (0, 1) if strict else (1, 0)
    l_rows = left.select(
        *keys,
        F.col(left_t).cast("double").alias("__t"),
        F.lit(left_side).alias("__side"),
        *[F.lit(None).cast(right.schema[c].dataType).alias(f"__tie{i}") for i, c in enumerate(tie)],
        F.struct(*left.columns).alias("__l"),
    )
    r_rows = right.select(
        *keys,
        F.col(right_t).cast("double").alias("__t"),
        F.lit(right_side).alias("__side"),
        *[F.col(c).alias(f"__tie{i}") for i, c in enumerate(tie)],
        *[c.alias(f"__r_{n}") for n, c in take.items()],
    )
    both = l_rows.unionByName(r_rows, allowMissingColumns=True)
    order = ["__t", "__side", *[f"__tie{i}" for i in range(len(tie))]]
    outs = {f"__m_{n}": ("last", F.col(f"__r_{n}")) for n in take}
    out = running(both, keys, order, [bucket("__t", width)], outs)
    return out.where(F.col("__side") == left_side).select(
        *[F.col(f"__l.{c}").alias(c) for c in left.columns],
        *[F.col(f"__m_{n}").alias(n) for n in take],
    )


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    low: Column,
    high: Column,
    right_t: str,
    width: float,
    low_open: bool = False,
) -> DataFrame:
    """Pairs of equal keys with the right time inside the left row's [low, high].

    Left rows are repeated once per time bucket they touch, so the equi join on (key, bucket)
    spreads a busy key over its buckets. Choose ``width`` near the interval's length. The join is a
    merge: Spark's estimate leaves the repeats out, so a broadcast would outgrow the driver.
    """
    l_rows = left.withColumn("__lo", low.cast("double")).withColumn("__hi", high.cast("double"))
    l_rows = l_rows.withColumn(
        "__b", F.explode(F.sequence(bucket("__lo", width), bucket("__hi", width)))
    )
    r_rows = right.withColumn("__b", bucket(right_t, width))
    t = F.col(right_t)
    above = t > F.col("__lo") if low_open else t >= F.col("__lo")
    return (
        l_rows.hint("merge").join(r_rows, [*keys, "__b"])
        .where(above & (t <= F.col("__hi")))
        .drop("__b", "__lo", "__hi")
    )


def beside(df: DataFrame, single: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row table added to each row, as one scalar subquery.

    More than one row is an error at run time, so nothing can be multiplied; none gives NULLs.
    """
    row = single.select(F.struct(*single.columns).alias("__row"))
    return df.withColumn("__row", row.scalar()).select(
        *df.columns, *[F.col(f"__row.{c}").alias(c) for c in single.columns]
    )


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys present on one side only, with the side they came from."""
    l_keys = left.select(*keys).withColumn("__in_left", F.lit(True))
    r_keys = right.select(*keys).withColumn("__in_right", F.lit(True))
    return (
        l_keys.join(r_keys, keys, "full_outer")
        .where(F.col("__in_left").isNull() | F.col("__in_right").isNull())
        .select(*keys, F.when(F.col("__in_left").isNull(), "right").otherwise("left").alias("side"))
    )


def alignment(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row telling how well two keyed tables line up (counts of keys and of repeats)."""
    sides = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = sides.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return per_key.agg(
        F.count_if((F.col("l") > 0) & (F.col("r") > 0)).alias("matched"),
        F.count_if(F.col("r") == 0).alias("only_left"),
        F.count_if(F.col("l") == 0).alias("only_right"),
        F.count_if((F.col("l") > 1) | (F.col("r") > 1)).alias("repeated"),
    )


def require_aligned(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> None:
    """Raise when the two tables do not hold exactly the same keys, each once."""
    row = alignment(left, right, keys).first()
    if row.only_left or row.only_right or row.repeated:
        raise ValueError(f"{what}: rows do not line up, {row.asDict()}")
