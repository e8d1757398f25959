"""Exact percentiles whose working set is spread over the cluster.

The built-in exact ``percentile`` keeps every distinct value of a group in one task. Here equal
values are first counted (map-side), the counts are scanned in value order by value segments, and
the one or two rows holding a wanted rank are picked by a plain aggregate.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag.operators.segments import bucket, running

# Seconds. Fine enough that even a trillion distinct values leave a few million to a segment.
VALUE_SEGMENT = 1 / 64


def quantiles(
    df: DataFrame,
    groups: list[str],
    value: str,
    wanted: dict[str, tuple[str, float]],
    width: float = VALUE_SEGMENT,
    weight: str | None = None,
) -> DataFrame:
    """``groups`` plus one column per wanted quantile of ``value`` (nulls ignored).

    ``wanted`` maps a name to ``("cont", p)``, linear between neighbours, or ``("disc", p)``, the
    nearest rank from above. ``weight`` is an optional integer multiplicity column. Group columns
    must not be null.
    """
    n = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).cast("double").alias("__v"))
        .agg(n.cast("long").alias("__n"))
    )
    ranked = running(
        counts,
        groups,
        ["__v"],
        [bucket("__v", width)],
        {"__cum": ("sum", F.col("__n")), "__all": ("total", F.col("__n"))},
    )

    def holder(rank):
        hit = (F.col("__cum") - F.col("__n") <= rank) & (rank < F.col("__cum"))
        return F.max(F.when(hit, F.col("__v")))

    picks, finals = [], []
    for name, (kind, p) in wanted.items():
        if kind == "disc":
            rank = F.greatest(F.ceil(F.lit(float(p)) * F.col("__all")) - 1, F.lit(0))
            picks.append(holder(rank).alias(name))
            finals.append(F.col(name))
            continue
        spot = F.lit(float(p)) * (F.col("__all") - 1)
        picks += [
            holder(F.floor(spot)).alias(f"__lo_{name}"),
            holder(F.ceil(spot)).alias(f"__hi_{name}"),
        ]
        share = F.lit(float(p)) * (F.col("__all") - 1)
        finals.append(
            (
                F.col(f"__lo_{name}")
                + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * (share - F.floor(share))
            ).alias(name)
        )
    return (
        ranked.groupBy(*groups)
        .agg(F.max("__all").alias("__all"), *picks)
        .select(*groups, *finals)
    )
