"""Simple predictors, the L1 line fit, folds and out-of-fold predictions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag.operators.joins import beside
from fleetlag.operators.segments import bucket, running
from fleetlag.session import cut_lineage

SLOPES = 201  # -0.5 … 1.5 in steps of 0.01
COARSE = 14
RESIDUAL_SEGMENT = 1 / 8  # seconds


def fit_l1_lines(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """``groups, a, b`` minimising the mean of ``|y − (a x + b)|``.

    The slope runs over a grid; for a slope the best intercept is the median of ``y − a x``, and the
    first slope wins a tie. The error is convex in the slope, so a coarse pass brackets the minimum
    and a second pass looks at the grid between the neighbours of the best coarse slope: a fifth
    of the grid in all. Equal (x, y) pairs are counted first, so the work follows the number of
    distinct pairs.
    """
    pairs = df.groupBy(
        *groups, F.coalesce(F.col(x), F.lit(0.0)).alias("__x"), F.col(y).alias("__y")
    ).agg(F.count(F.lit(1)).alias("__n"))
    pairs = cut_lineage(pairs)
    last = SLOPES - 1
    coarse = F.array_distinct(F.concat(F.sequence(F.lit(0), F.lit(last), F.lit(COARSE)), F.array(F.lit(last))))
    first = _best_slope(pairs, groups, coarse).select(*groups, F.col("__best.__i").alias("__c"))
    first = cut_lineage(first)
    bracketed = pairs.join(first, groups) if groups else beside(pairs, first)
    low = F.greatest(F.col("__c") - COARSE + 1, F.lit(0))
    high = F.least(F.col("__c") + COARSE - 1, F.lit(last))
    best = _best_slope(bracketed, groups, F.sequence(low, high))
    return best.select(*groups, _slope(F.col("__best.__i")).alias("a"), F.col("__best.__b").alias("b"))


def _slope(i):
    return F.lit(-0.5) + i * F.lit(0.01)


def _best_slope(pairs: DataFrame, groups: list[str], slopes) -> DataFrame:
    """``groups, __best(__i, __b)``: the first of ``slopes`` with the least mean absolute error."""
    grid = pairs.withColumn("__i", F.explode(slopes))
    grid = grid.withColumn("__r", F.col("__y") - _slope(F.col("__i")) * F.col("__x"))
    by = [*groups, "__i"]
    n, r = F.col("__n"), F.col("__r")
    residuals = grid.groupBy(*by, "__r").agg(F.sum("__n").alias("__n"))
    ranked = running(
        residuals, by, ["__r"], [bucket("__r", RESIDUAL_SEGMENT)],
        {"__cn": ("sum", n), "__cs": ("sum", n * r), "__all": ("total", n), "__sum": ("total", n * r)},
    )
    # With the sums up to the median b the absolute error needs no second pass over the rows:
    # sum |r - b| = all - 2 * below + b * (2 * count below - count).
    spot = F.lit(0.5) * (F.col("__all") - 1)
    at = lambda rank, c: F.max(
        F.when((F.col("__cn") - n <= rank) & (rank < F.col("__cn")), c)
    )
    picked = ranked.groupBy(*by).agg(
        at(F.floor(spot), r).alias("__lo"),
        at(F.ceil(spot), r).alias("__hi"),
        at(F.floor(spot), F.col("__cn")).alias("__cn"),
        at(F.floor(spot), F.col("__cs")).alias("__cs"),
        F.max("__all").alias("__all"),
        F.max("__sum").alias("__sum"),
    )
    middle = F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (spot - F.floor(spot))
    scored = picked.withColumn("__b", middle).withColumn(
        "__err",
        (F.col("__sum") - 2 * F.col("__cs") + F.col("__b") * (2 * F.col("__cn") - F.col("__all")))
        / F.col("__all"),
    )
    best = F.min_by(F.struct("__i", "__b"), F.struct(F.round("__err", 9), F.col("__i"))).alias("__best")
    return scored.groupBy(*groups).agg(best)


def simple_forecasts(df: DataFrame) -> DataFrame:
    """``zero`` and ``persistence`` next to the points."""
    return df.withColumns({"zero": F.lit(0.0), "persistence": F.coalesce("cur_dev_s", F.lit(0.0))})


def predict_line(df: DataFrame, lines: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Apply fitted lines; a group without a line uses slope 1 and intercept 0."""
    fitted = lines.select(*keys, "a", "b")
    joined = df.join(fitted, keys, "left") if keys else beside(df, fitted)
    value = F.coalesce("a", F.lit(1.0)) * F.coalesce("cur_dev_s", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))
    return joined.withColumn(name, value).drop("a", "b")


def fit_two_lines(df: DataFrame, groups: list[str] = ()) -> DataFrame:
    """One line for targets behind a layover, one for the rest, in each of ``groups``. Outage copies are left out: their
    hint is minutes off and would flatten the lines."""
    rows = df.where(F.col("hint") != "outage") if "hint" in df.columns else df
    return fit_l1_lines(rows, [*groups, "layover"], "cur_dev_s", "target")


def row_weights(synthetic_weight: float = 1.0, outage_weight: float = 1.0):
    return F.when(F.col("hint") == "outage", outage_weight).when(
        F.col("synthetic"), synthetic_weight
    ).otherwise(1.0)


def group_folds(df: DataFrame, group: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """Every row with ``fold``; a group is never split and folds are close in size.

    Groups are ordered by size and then by a seeded hash, and dealt back and forth over the folds.
    The order is scanned in segments of (size, hash), never in one task.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    mix = F.pmod(
        F.pmod(F.col(group), F.lit(2147483647)) * F.lit(2654435761) + F.lit(seed * 40503), F.lit(4294967296)
    )
    sizes = sizes.withColumn("__neg", -F.col("__size")).withColumn("__mix", mix.cast("bigint"))
    ranked = running(
        sizes, [], ["__neg", "__mix", group], ["__neg", F.expr("shiftright(__mix, 22)")],
        {"__rank": ("count", None)}, inclusive=False,
    )
    lap, place = F.expr(f"__rank div {folds}"), F.col("__rank") % folds
    fold = F.when(lap % 2 == 0, place).otherwise(folds - 1 - place).cast("int")
    return df.hint("merge").join(ranked.select(group, fold.alias("fold")), group)


def check_group_count(df: DataFrame, group: str, folds: int) -> None:
    n = df.select(group).distinct().limit(folds).count()
    if n < folds:
        raise ValueError(f"{n} groups is not enough for {folds} folds")


def out_of_fold_lines(df: DataFrame, folds: int = 5) -> DataFrame:
    """Rows with ``base``, the two-line forecast fitted without the row's own fold.

    All folds are fitted in one grouped pass: a row takes part in every fold but its own.
    """
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold"))
    train = df.withColumn("held", F.explode(others))
    if "hint" in df.columns:
        train = train.where(F.col("hint") != "outage")
    lines = fit_l1_lines(train, ["held", "layover"], "cur_dev_s", "target")
    return predict_line(df, lines.withColumnRenamed("held", "fold"), ["fold", "layover"], "base")
