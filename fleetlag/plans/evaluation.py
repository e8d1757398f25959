"""Evaluation tables: cross-validation and control reports, coverage, blending, outage copies."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag import settings as S
from fleetlag.functions import scalars as X
from fleetlag.operators.joins import beside, require_aligned
from fleetlag.operators.matching import late_ticks
from fleetlag.operators.metrics import attach, error_metrics, summary
from fleetlag.operators.quantiles import quantiles


def _long_form(rows: DataFrame, forecasts: dict) -> DataFrame:
    """One row per (row, named forecast); NULL forecasts are left out."""
    items = F.array(*[F.struct(n.alias("name"), v.cast("double").alias("pred")) for n, v in forecasts.values()])
    return rows.select(
        "hint", "target", F.coalesce("cur_dev_s", F.lit(0.0)).alias("__cur"), F.explode(items).alias("f")
    ).select("hint", "target", "__cur", "f.name", "f.pred")


def cv_scores(oof: DataFrame) -> DataFrame:
    """Summaries of real vehicles per hint source: persistence, two lines, model, and the model
    with and without a layover ahead. One pass over a row's forecasts in long form."""
    lit = F.lit
    split = F.when(F.col("layover"), "model / layover").otherwise("model / no layover")
    rows = _long_form(
        oof.where("NOT synthetic"),
        {
            "a": (lit("persistence"), F.coalesce("cur_dev_s", F.lit(0.0))),
            "b": (lit("split_linear"), F.col("base")),
            "c": (lit("model"), F.col("oof")),
            "d": (split, F.col("oof")),
        },
    )
    return summary(rows, ["hint", "name"], "target", "pred", "__cur")


def control_scores(oof: DataFrame) -> DataFrame:
    """Summaries of the control model on the rows it scored."""
    rows = _long_form(
        oof.where(F.col("control").isNotNull()),
        {
            "a": (F.lit("persistence"), F.coalesce("cur_dev_s", F.lit(0.0))),
            "b": (F.lit("model"), F.col("control")),
        },
    )
    return summary(rows, ["hint", "name"], "target", "pred", "__cur")


def residual_interval(oof: DataFrame, y: str, pred: str) -> DataFrame:
    low, high = S.INTERVAL_QUANTILES
    rows = oof.select((F.col(y) - F.col(pred)).alias("__r"))
    return quantiles(rows, [], "__r", {"lo": ("cont", low), "hi": ("cont", high)})


def blend_tables(tables: list[DataFrame], weights: list[float], keys: list[str]) -> DataFrame:
    """Weighted out-of-fold forecasts of members on the same rows; probabilities in log-odds.

    Rows, hints and folds must be the same in every member.
    """
    if len(tables) < 2 or len(tables) != len(weights):
        raise ValueError("a blend needs two or more members, each with a weight")
    if min(weights) < 0 or abs(sum(weights) - 1) > 1e-8:
        raise ValueError(f"weights must be non-negative and sum to 1, got {weights}")
    for other in tables[1:]:
        require_aligned(tables[0], other, keys, "blend members")
    with_late = all("oof_late" in t.columns for t in tables)
    value = ["oof", *(["oof_late"] if with_late else [])]
    renamed = [
        t.select(*keys, *[F.col(v).alias(f"__{v}{i}") for v in value]) for i, t in enumerate(tables)
    ]
    rest = [c for c in tables[0].columns if c not in (*value, "control")]
    joined = reduce(lambda a, b: a.join(b, keys), renamed, tables[0].select(*rest))

    def mix(f, name):
        return reduce(lambda a, b: a + b, [w * f(F.col(f"__{name}{i}")) for i, w in enumerate(weights)])

    out = joined.withColumn("oof", mix(lambda c: c, "oof"))
    if with_late:
        out = out.withColumn("oof_late", X.sigmoid(mix(X.logit, "oof_late")))
    return out.select(*rest, *value)


def labeled_union(frames: dict[str, DataFrame]) -> DataFrame:
    """Frames stacked with their hint source in ``hint``."""
    tagged = [df.withColumn("hint", F.lit(h)) for h, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def outage_points(points: DataFrame, copies: int = S.OUTAGE_COPIES, seed: int = 0) -> DataFrame:
    """``copies`` of every real point, each with an outage of random length and kind.

    Randomness is a hash of (sample, copy, seed): recomputed rows draw the same outage.
    """
    real = points.where(~X.is_synthetic("tr_id"))
    out = real.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    def uniform(salt):
        return F.pmod(F.xxhash64("sample_id", "copy", F.lit(seed), F.lit(salt)), F.lit(1 << 52)) / F.lit(
            float(1 << 52)
        )

    low, high = S.OUTAGE_GAP_S
    return out.withColumn("gap_s", low + (high - low) * uniform(1)).withColumn(
        "outage", F.when(uniform(2) < 0.5, S.OUTAGE_KINDS[0]).otherwise(S.OUTAGE_KINDS[1])
    )


def coverage_report(comparisons: DataFrame) -> DataFrame:
    """One row: points, covered share, missing references and error metrics."""
    rows = comparisons.withColumn("__e", F.col("estimate_s") - F.col("reference_s"))
    base = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("estimate_s").alias("covered"),
        (F.count("estimate_s") / F.count(F.lit(1))).alias("coverage"),
        F.count_if(F.col("reference_s").isNull()).alias("missing_reference"),
    )
    return attach(base, error_metrics(rows, [], "__e"), [])


def recall_report(rows: DataFrame) -> DataFrame:
    """One row over facts in the observed span: expected, matched, recall, time error."""
    base = rows.agg(
        F.count(F.lit(1)).alias("expected"),
        F.count("t_found").alias("matched"),
        (F.count("t_found") / F.count(F.lit(1))).alias("recall"),
    )
    return attach(base, error_metrics(rows, [], "error_s"), [])


def matcher_quality(plan: DataFrame, events: DataFrame, entries: DataFrame, done: DataFrame) -> DataFrame:
    """One row of matcher figures. ``entries`` are all stream entries (``entry_id, row_id, tr_id, t,
    ok``), ``done`` those already processed."""
    ms = F.max(X.entry_ms("entry_id"))
    parts = [
        plan.agg(F.count(F.lit(1)).alias("planned_visits")),
        events.agg(F.count(F.lit(1)).alias("stop_events")),
        late_ticks(entries).agg(F.count_if("late").alias("rejected_late_ticks")),
        entries.agg(F.count_if(~F.col("ok")).alias("invalid_location"), ms.alias("__newest")),
        done.agg(ms.alias("__done")),
    ]
    out = reduce(beside, parts)
    return out.withColumn("lag_ms", F.col("__newest") - F.col("__done")).drop("__newest", "__done")
