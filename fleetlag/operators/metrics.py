"""Error metrics, rank metrics, bootstrap intervals and service figures."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlag import settings as S
from fleetlag.functions import scalars as X
from fleetlag.operators.joins import beside
from fleetlag.operators.quantiles import quantiles
from fleetlag.operators.segments import bucket, running

DRAW_BLOCK = 65_536  # draws generated by one task
DRAWS_AT_ONCE = 1 << 20  # draws packed together
GROUP_BITS = 12  # a block of numbered groups; a draw's place in it takes two bytes
SAMPLE_SHIFT = 40  # a draw as one number: its sample above the number of its group


def attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join per-group results; without groups both sides are one row."""
    return left.join(right, keys) if keys else beside(left, right)


def mae(y, p) -> Column:
    return F.avg(F.abs(X.col(y) - X.col(p)))


def score_estimate(zero_mae, model_mae) -> Column:
    """Share of the way from the zero forecast to the target error; NULL when zero is exact."""
    z = X.col(zero_mae)
    return F.when(z != 0, (z - X.col(model_mae)) / (z * (1 - S.TARGET_TO_ZERO)))


def summary(df: DataFrame, groups: list[str], y: str, pred: str, cur: str) -> DataFrame:
    """``mae, bias, p90, vs_persistence, score, rows`` per group."""
    rows = df.withColumn("__e", F.col(pred) - F.col(y)).withColumn("__abs", F.abs("__e"))
    base = rows.groupBy(*groups).agg(
        F.avg("__abs").alias("mae"),
        F.avg("__e").alias("bias"),
        F.avg(F.abs(F.col(cur) - F.col(y))).alias("__pers"),
        F.avg(F.abs(F.col(y))).alias("__zero"),
        F.count(F.lit(1)).alias("rows"),
    )
    p90 = quantiles(rows, groups, "__abs", {"p90": ("cont", 0.9)})
    return attach(base, p90, groups).select(
        *groups,
        "mae",
        "bias",
        "p90",
        F.when(F.col("__pers") != 0, F.col("mae") / F.col("__pers") - 1).alias("vs_persistence"),
        score_estimate("__zero", "mae").alias("score"),
        "rows",
    )


def error_metrics(df: DataFrame, groups: list[str], error: str) -> DataFrame:
    """``scored, mae_s, bias_s, p95_abs_error_s`` over the non-null errors."""
    rows = df.where(F.col(error).isNotNull()).withColumn("__abs", F.abs(F.col(error)))
    base = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("scored"), F.avg("__abs").alias("mae_s"), F.avg(error).alias("bias_s")
    )
    return attach(base, quantiles(rows, groups, "__abs", {"p95_abs_error_s": ("cont", 0.95)}), groups)


def roc_auc(df: DataFrame, label: str, score: str, width: float = 1 / 4096) -> DataFrame:
    """Area under the ROC curve with average ranks for ties; NULL with one class only.

    Equal scores are counted first; the running count of negatives then follows the score order in
    score segments.
    """
    counts = df.groupBy(F.col(score).cast("double").alias("__s")).agg(
        F.count_if(F.col(label)).alias("__p"), F.count_if(~F.col(label)).alias("__n")
    )
    below = running(
        counts, [], ["__s"], [bucket("__s", width)], {"__below": ("sum", "__n")}, inclusive=False
    )
    wins = F.col("__p") * (F.coalesce("__below", F.lit(0)) + F.col("__n") / 2)
    pairs = F.sum("__p") * F.sum("__n")
    return below.agg(F.when(pairs > 0, F.sum(wins) / pairs).alias("auc"))


def classifier_summary(df: DataFrame, label: str, probability: str) -> DataFrame:
    """AUC, log loss, Brier score and positive rate of a probability."""
    p = X.clip(probability, 1e-6, 1 - 1e-6)
    rows = df.select(F.col(label).alias("__y"), p.alias("__q"))
    y = F.col("__y").cast("double")
    q = F.col("__q")
    base = rows.agg(
        (-F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("logloss"),
        F.avg((q - y) * (q - y)).alias("brier"),
        F.avg(y).alias("positive_rate"),
        F.count(F.lit(1)).alias("rows"),
    )
    return attach(roc_auc(rows, "__y", "__q"), base, [])


def spread(df: DataFrame, groups: list[str], value: str, kind: str, probs: dict[str, float]) -> DataFrame:
    """Percentiles (``disc`` nearest rank or ``cont`` linear) with maximum and count, to 0.1."""
    q = quantiles(df, groups, value, {n: (kind, p) for n, p in probs.items()})
    top = df.groupBy(*groups).agg(F.max(value).alias("max"), F.count(value).alias("count"))
    return attach(q, top, groups).select(
        *groups, *[F.round(n, 1).alias(n) for n in probs], F.round("max", 1).alias("max"), "count"
    )


def service_figures(calls: DataFrame, every_s: int = 3600, window_s: int = 300) -> DataFrame:
    """Figures of the last ``window_s`` seconds at every ``every_s`` mark.

    ``calls`` has ``t, ms, ok, rows, degraded``.
    """
    mark = (F.ceil(F.col("t") / every_s) * every_s).cast("bigint")
    late = calls.withColumn("mark", mark).where(F.col("t") >= F.col("mark") - window_s)
    base = late.groupBy("mark").agg(
        F.count_if(~F.col("ok")).alias("failures"),
        F.round(F.sum("rows") * 60 / window_s, 1).alias("rows_per_min"),
        F.round(F.sum("degraded") / F.sum("rows"), 3).alias("degraded_share"),
    )
    return spread(late, ["mark"], "ms", "disc", {"p50": 0.5, "p95": 0.95}).join(base, "mark")


def tick_latency(telemetry: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per tick: rows, when it was published, and when telemetry first reached its time.

    The running clock reaches T at the first delivered record with an event time of T or later: a
    running minimum of the delivery order from the newest event time down. Records of one event time are reduced to the
    first delivered before anything is sorted, so a segment holds at most one row for each distinct time.
    """
    ticks = predictions.groupBy("t").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("published_ms").alias("published_ms"),
        F.max(F.col("model_version") == "fallback").alias("fallback"),
    )
    asks = ticks.select((-F.col("t")).alias("__t"), F.lit(1).alias("__side"), F.lit(0).cast("bigint").alias("__n"), F.struct(*ticks.columns).alias("__l"))
    first = telemetry.groupBy("t").agg(F.min(F.struct("row_id", "ms")).alias("__r"))
    recs = first.select((-F.col("t")).alias("__t"), F.lit(0).alias("__side"), F.col("__r.row_id").alias("__n"), "__r")
    out = running(
        recs.unionByName(asks, allowMissingColumns=True), [], ["__t", "__side", "__n"],
        [bucket("__t", 3600)], {"__m": ("min", F.col("__r"))},
    )
    return out.where("__side = 1").select(
        "__l.*", F.col("__m.ms").alias("clock_ms"), (F.col("__l.published_ms") - F.col("__m.ms")).alias("lag_ms")
    )


def tick_report(telemetry: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: ticks, rows, vehicles, step, lag percentiles and the fit lag ~ vehicles."""
    from fleetlag.operators.segments import previous

    per_tick = tick_latency(telemetry, predictions)
    steps = previous(per_tick.select("t"), [], ["t"], [bucket("t", 86_400)], {"before": "t"})
    step = quantiles(steps.select((F.col("t") - F.col("before")).alias("step")), [], "step", {"step_p50": ("cont", 0.5)})
    model = per_tick.where(~F.col("fallback") & F.col("lag_ms").isNotNull())
    lag = spread(model, [], "lag_ms", "cont", {"lag_p50": 0.5, "lag_p95": 0.95, "lag_p99": 0.99})
    fit = model.agg(
        F.round(F.regr_intercept("lag_ms", "n")).alias("base_ms"),
        F.round(F.regr_slope("lag_ms", "n"), 1).alias("per_vehicle_ms"),
    )
    counts = predictions.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("tr_id").alias("vehicles"))
    out = per_tick.agg(F.count(F.lit(1)).alias("ticks"), F.count_if("fallback").alias("fallback_ticks"))
    for part in (counts, step, lag.drop("count").withColumnRenamed("max", "lag_max"), fit):
        out = beside(out, part)
    return out


def paired_interval(
    df: DataFrame, difference: str, group: str, level: float = 0.9, samples: int = 2000, seed: int = 0
) -> DataFrame:
    """Bootstrap interval of the mean difference, resampling whole groups; one row."""
    tail = (1 - level) / 2
    means = _resampled_means(df, [difference], group, samples, seed)
    return quantiles(means, [], "mean", {"lo": ("cont", tail), "hi": ("cont", 1 - tail)})


def paired_intervals(
    df: DataFrame, differences: list[str], group: str, level: float = 0.9, samples: int = 2000, seed: int = 0
) -> DataFrame:
    """``difference`` (its place in the list), ``lo, hi`` of several columns over the same draws of groups.

    Each is the interval that :func:`paired_interval` gives; one without a mean has no row.
    """
    tail = (1 - level) / 2
    means = _resampled_means(df, differences, group, samples, seed)
    return quantiles(means, ["difference"], "mean", {"lo": ("cont", tail), "hi": ("cont", 1 - tail)})


def _resampled_means(df: DataFrame, differences: list[str], group: str, samples: int, seed: int) -> DataFrame:
    """``sample, difference, mean`` of every bootstrap sample.

    Groups collapse to sums and counts. A sample draws as many groups as there are, by a hash of
    (seed, sample, draw), so a lost executor draws the same again. Draws are generated in blocks
    spread over the cluster, travel packed to the block of numbered groups they fall into, two bytes
    a draw, and are added up there for all columns at once. A block of groups holds some ``samples``
    times ``2 ** GROUP_BITS`` draws at any number of groups.
    """
    spark = df.sparkSession
    width = len(differences)
    sums = df.groupBy(group).agg(
        F.array(*[F.coalesce(F.sum(c).cast("double"), F.lit(0.0)) for c in differences]).alias("s"),
        F.array(*[F.count(c).cast("double") for c in differences]).alias("c"),
    )
    numbered = running(
        sums.withColumn("__h", F.xxhash64(group)), [], ["__h", group], [F.expr("shiftright(__h, 52)")],
        {"__g": ("count", None)}, inclusive=False,
    ).select("__g", "s", "c")
    groups = numbered.agg(F.count(F.lit(1)).alias("groups"))  # one row
    blocks = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(groups - 1) div {DRAW_BLOCK}"))
    in_block = F.sequence(
        F.col("block") * DRAW_BLOCK, F.least((F.col("block") + 1) * DRAW_BLOCK, F.col("groups")) - 1
    )
    draws = (
        beside(spark.range(samples).withColumnRenamed("id", "sample"), groups)
        .where("groups > 0")
        .select("sample", "groups", F.explode(blocks).alias("block"))
        # a given number: the few rows before the draws are made would be dealt to a single task
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sample", "block")
        .select("sample", "groups", F.explode(in_block).alias("draw"))
        .select("sample", F.pmod(F.xxhash64("sample", "draw", F.lit(seed)), F.col("groups")).alias("__g"))
    )

    def add_up(drawn: pa.Table, of_groups: pa.Table) -> pa.Table:
        table = np.zeros((1 << GROUP_BITS, 2 * width))
        place = of_groups.column("__g").to_numpy() & ((1 << GROUP_BITS) - 1)
        for k, name in enumerate(("s", "c")):
            values = of_groups.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            table[place, k * width : (k + 1) * width] = values.reshape(-1, width)
        sample, at = np.unique(drawn.column("sample").to_numpy(), return_inverse=True)
        total = np.zeros((len(sample), 2 * width))
        for i, numbers in zip(at, drawn.column("drawn")):
            total[i] += table[np.frombuffer(numbers.as_buffer(), dtype=np.uint16)].sum(axis=0)
        columns = [
            np.repeat(sample, width), np.tile(np.arange(width, dtype=np.int32), len(sample)),
            total[:, :width].ravel(), total[:, width:].ravel(),
        ]
        return pa.table(dict(zip(("sample", "difference", "s", "c"), columns)))

    number = numbered.withColumn("block", F.shiftright("__g", GROUP_BITS))
    packed = draws.mapInArrow(_packed_draws, "block bigint, sample bigint, drawn binary")
    added = (
        packed.groupBy("block")
        .cogroup(number.groupBy("block"))
        .applyInArrow(add_up, "sample bigint, difference int, s double, c double")
    )
    mean = F.when(F.sum("c") > 0, F.sum("s") / F.sum("c"))
    return added.groupBy("sample", "difference").agg(mean.alias("mean"))


def _packed_draws(batches):
    """``(sample, number of a group)`` as one row for each sample and block of groups in a stretch of draws."""

    def pack(codes):
        code = np.sort(np.concatenate(codes))
        head = code >> GROUP_BITS
        starts = np.flatnonzero(np.diff(head, prepend=-1))
        places = np.split((code & ((1 << GROUP_BITS) - 1)).astype(np.uint16), starts[1:])
        sample, block = head[starts] >> (SAMPLE_SHIFT - GROUP_BITS), head[starts] & ((1 << (SAMPLE_SHIFT - GROUP_BITS)) - 1)
        arrays = [pa.array(block), pa.array(sample), pa.array([p.tobytes() for p in places], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["block", "sample", "drawn"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            sample, number = (batch.column(c).to_numpy() for c in ("sample", "__g"))
            held.append(sample << SAMPLE_SHIFT | number)
            rows += batch.num_rows
        if rows >= DRAWS_AT_ONCE:
            yield pack(held)
            held, rows = [], 0
    if held:
        yield pack(held)


def arrival_quality(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Detected against fact times per (synthetic, manual, trip start)."""
    rows = found.select("stop_id", "tr_id", "t_arr", (F.col("seq") == 0).alias("trip_start")).join(
        facts.select("stop_id", "t_fact", "manual_fill"), "stop_id"
    )
    rows = rows.withColumn("synthetic", X.is_synthetic("tr_id")).withColumn(
        "error", F.abs(F.col("t_arr") - F.col("t_fact"))
    )
    groups = ["synthetic", "manual_fill", "trip_start"]
    within = lambda s: F.avg(F.coalesce(F.col("error") <= s, F.lit(False)).cast("double"))
    base = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col("t_arr").isNotNull().cast("double")).alias("found"),
        *[within(s).alias(f"within_{s}s") for s in (15, 30, 60)],
    )
    return base.join(quantiles(rows, groups, "error", {"median_error_s": ("cont", 0.5)}), groups, "left")
