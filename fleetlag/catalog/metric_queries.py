"""Metrics, percentiles, line fits, folds and service figures."""

from pyspark.sql import functions as F

from fleetlag.catalog import fleetday as D
from fleetlag.catalog.join_queries import ticks
from fleetlag.catalog.registry import query
from fleetlag.functions import scalars as X
from fleetlag.operators import baselines as B
from fleetlag.operators import matching as M
from fleetlag.operators import metrics as ME
from fleetlag.operators import timetable as TT
from fleetlag.operators.quantiles import quantiles
from fleetlag.sources import sinks


def scored(spark, sf):
    """Points with a made-up model forecast, where the vehicle is known to be somewhere."""
    p = B.simple_forecasts(D.points(spark, sf))
    return p.withColumns(
        {
            "model": F.col("target") * 0.5 + F.col("target_stop_id") % 13 * 3.0,
            "layover": F.expr("target_stop_id % 20 < 5"),
            "run": F.expr("cast(T / 1200 as bigint) + tr_id * 1000000"),
            "synthetic": F.expr("tr_id % 9 = 0"),
            "hint": F.expr("CASE WHEN target_stop_id % 2 = 0 THEN 'given' ELSE 'gps' END"),
        }
    )


SCORED = {
    "f_scored": """SELECT *, CAST(0 AS DOUBLE) AS zero, coalesce(cur_dev_s, 0) AS persistence, target * 0.5 + target_stop_id % 13 * 3.0 AS model,
       target_stop_id % 20 < 5 AS layover, CAST(floor(T / 1200) AS BIGINT) + tr_id * 1000000 AS run, tr_id % 9 = 0 AS synthetic,
       CASE WHEN target_stop_id % 2 = 0 THEN 'given' ELSE 'gps' END AS hint FROM f_points""",
}


def summary_sql(pred, groups=""):
    g = groups + ", " if groups else ""
    return f"""SELECT {g}round(avg(abs({pred} - target)), 6) AS mae, round(avg({pred} - target), 6) AS bias,
       round(quantile_cont(abs({pred} - target), 0.9), 6) AS p90, round(avg(abs({pred} - target)) / avg(abs(persistence - target)) - 1, 6) AS vs_persistence,
       round((avg(abs(target)) - avg(abs({pred} - target))) / (avg(abs(target)) * (1 - 0.76::DOUBLE)), 6) AS score, count(*) AS rows FROM f_scored"""


def rounded(df, *keep):
    return df.select(
        *[F.round(c, 6).alias(c) if t in ("double",) and c not in keep else F.col(c) for c, t in df.dtypes]
    )


@query("A2 M1", "SELECT part, round(avg(abs(target)), 6) AS zero, round(avg(abs(coalesce(cur_dev_s, 0) - target)), 6) AS persistence FROM f_points GROUP BY part")
def baseline_mae(spark, sf):
    p = B.simple_forecasts(D.points(spark, sf))
    return rounded(p.groupBy("part").agg(ME.mae("target", "zero").alias("zero"), ME.mae("target", "persistence").alias("persistence")))


@query("A3", "SELECT part, round((avg(abs(target)) - avg(abs(model - target))) / (avg(abs(target)) * (1 - 0.76::DOUBLE)), 6) AS score FROM f_scored GROUP BY part", SCORED)
def score_estimate(spark, sf):
    s = scored(spark, sf).groupBy("part").agg(ME.mae("target", "zero").alias("z"), ME.mae("target", "model").alias("m"))
    return rounded(s.select("part", ME.score_estimate("z", "m").alias("score")))


@query("A4", summary_sql("model", "part") + " GROUP BY part", SCORED)
def error_summary(spark, sf):
    return rounded(ME.summary(scored(spark, sf), ["part"], "target", "model", "persistence"))


_LABELED = {
    "f_labeled": """SELECT target > 40 AS y, ((target_stop_id * 7) % 50) / 50.0::DOUBLE AS p FROM f_points""",
    "f_ranked": """SELECT y, p, avg(r) OVER (PARTITION BY p) AS rank FROM (SELECT y, p, row_number() OVER (ORDER BY p) AS r FROM f_labeled)""",
}


def _labeled(spark, sf):
    return D.points(spark, sf).select(
        (F.col("target") > 40).alias("y"), (F.expr("(target_stop_id * 7) % 50") / F.lit(50.0)).alias("p")
    )


_AUC = "(sum(CASE WHEN y THEN rank END) - count_if(y) * (count_if(y) + 1) / 2) / (count_if(y) * count_if(NOT y))"


@query("A5", f"SELECT round({_AUC}, 9) AS auc FROM f_ranked", _LABELED)
def rank_auc(spark, sf):
    return ME.roc_auc(_labeled(spark, sf), "y", "p").select(F.round("auc", 9).alias("auc"))


@query(
    "A6",
    f"""SELECT round({_AUC}, 6) AS auc, round(-avg(CASE WHEN y THEN ln(greatest(p, 1e-6::DOUBLE)) ELSE ln(1 - greatest(p, 1e-6::DOUBLE)) END), 6) AS logloss,
    round(avg(pow(greatest(p, 1e-6::DOUBLE) - CAST(y AS INT), 2)), 6) AS brier, round(avg(CAST(y AS INT)), 6) AS positive_rate, count(*) AS rows FROM f_ranked""",
    _LABELED,
)
def classifier_summary(spark, sf):
    return rounded(ME.classifier_summary(_labeled(spark, sf), "y", "p"))


_CV = {
    **SCORED,
    "f_long": """SELECT hint, 'persistence' AS name, target, persistence, persistence AS pred FROM f_scored WHERE NOT synthetic
       UNION ALL SELECT hint, 'split_linear', target, persistence, target * 0.8 FROM f_scored WHERE NOT synthetic
       UNION ALL SELECT hint, 'model', target, persistence, model FROM f_scored WHERE NOT synthetic
       UNION ALL SELECT hint, CASE WHEN layover THEN 'model / layover' ELSE 'model / no layover' END, target, persistence, model FROM f_scored WHERE NOT synthetic""",
}


@query("A7", summary_sql("pred", "hint, name").replace("f_scored", "f_long") + " GROUP BY hint, name", _CV)
def cv_report(spark, sf):
    from fleetlag.plans.evaluation import cv_scores

    oof = scored(spark, sf).withColumns({"oof": F.col("model"), "base": F.col("target") * 0.8})
    return rounded(cv_scores(oof))


@query("A8", summary_sql("pred", "hint, name").replace("f_scored", "(SELECT * FROM f_long2)") + " GROUP BY hint, name", {
    **SCORED,
    "f_long2": """SELECT hint, 'persistence' AS name, target, persistence, persistence AS pred FROM f_scored WHERE part = 'test'
       UNION ALL SELECT hint, 'model', target, persistence, model FROM f_scored WHERE part = 'test'""",
})
def control_report(spark, sf):
    from fleetlag.plans.evaluation import control_scores

    oof = scored(spark, sf).withColumn("control", F.when(F.col("part") == "test", F.col("model")))
    return rounded(control_scores(oof))


@query(
    "A9",
    """SELECT part, count(e) AS scored, round(avg(abs(e)), 6) AS mae_s, round(avg(e), 6) AS bias_s, round(quantile_cont(abs(e), 0.95), 6) AS p95_abs_error_s
       FROM (SELECT part, cur_dev_s - target AS e FROM f_points) WHERE e IS NOT NULL GROUP BY part""",
)
def matcher_error_metrics(spark, sf):
    p = D.points(spark, sf).withColumn("e", F.col("cur_dev_s") - F.col("target"))
    return rounded(ME.error_metrics(p, ["part"], "e"))


def calls(spark, sf):
    return D.events(spark, sf).select(
        (F.col("us") / F.lit(1e6)).alias("t"),
        F.col("value").alias("ms"),
        (F.col("event_type") != "error").alias("ok"),
        (F.col("k") % 5 + 1).cast("bigint").alias("rows"),
        F.expr("CASE WHEN event_type = 'signup' THEN k % 5 + 1 ELSE 0 END").cast("bigint").alias("degraded"),
        "event_type",
        "user_id",
    )


@query(
    "A10",
    """SELECT event_type, round(quantile_disc(value, 0.5), 1) AS p50, round(quantile_disc(value, 0.95), 1) AS p95, round(max(value), 1) AS max, count(*) AS count
       FROM f_events GROUP BY event_type""",
)
def nearest_rank_spread(spark, sf):
    return ME.spread(calls(spark, sf), ["event_type"], "ms", "disc", {"p50": 0.5, "p95": 0.95})


@query(
    "A11",
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
       FROM f_events GROUP BY event_type""",
)
def linear_percentiles(spark, sf):
    q = quantiles(calls(spark, sf), ["event_type"], "ms", {"p50": ("cont", 0.5), "p95": ("cont", 0.95), "p99": ("cont", 0.99)})
    return rounded(q)


@query(
    "A1",
    """SELECT synthetic, manual_fill, trip_start, count(*) AS rows, round(avg(CASE WHEN t_arr IS NULL THEN 0 ELSE 1 END), 6) AS found,
       round(avg(CASE WHEN e <= 15 THEN 1 ELSE 0 END), 6) AS within_15s, round(avg(CASE WHEN e <= 30 THEN 1 ELSE 0 END), 6) AS within_30s,
       round(avg(CASE WHEN e <= 60 THEN 1 ELSE 0 END), 6) AS within_60s, round(quantile_cont(e, 0.5), 6) AS median_error_s FROM (
       SELECT p.tr_id % 9 = 0 AS synthetic, manual_fill, p.seq = 0 AS trip_start, ev.time_fact + (p.stop_id * 31) % 80 AS t_arr, abs(ev.time_fact + (p.stop_id * 31) % 80 - f.t_fact) AS e
       FROM f_prepared p JOIN f_facts f ON f.stop_id = p.stop_id LEFT JOIN f_stop_events ev ON ev.stop_id = p.stop_id) GROUP BY 1, 2, 3""",
)
def arrival_quality(spark, sf):
    """Quality table of given arrivals; ``detected_arrivals`` is the detector itself."""
    e = D.stop_events(spark, sf).select("stop_id", (F.col("time_fact") + F.expr("(stop_id * 31) % 80")).alias("t_arr"))
    found = TT.prepare_plan(D.plan(spark, sf)).join(e, "stop_id", "left")
    marked = found.withColumn("tr_id", F.expr("CASE WHEN tr_id % 9 = 0 THEN tr_id + 9000000 ELSE tr_id END"))
    return rounded(ME.arrival_quality(marked, D.facts(spark, sf)))


@query(
    "A12",
    """SELECT count_if(r = 'green') AS risk_green, count_if(r = 'yellow') AS risk_yellow, count_if(r = 'red') AS risk_red, count_if(r IS NULL) AS risk_none,
       count_if(f = 'active') AS active, count_if(f = 'stale') AS stale, count_if(f = 'offline') AS offline FROM (
       SELECT v.tr_id, CASE WHEN v.tr_id % 4 > 0 THEN p.risk_level END AS r, CASE WHEN v.tr_id % 3 = 0 THEN 'active' WHEN v.tr_id % 3 = 1 THEN 'stale' ELSE 'offline' END AS f
       FROM f_ids v LEFT JOIN f_predictions p ON p.tr_id = v.tr_id AND p.i = 40)""",
)
def fleet_summary(spark, sf):
    from fleetlag.plans.live import fleet_summary as summarize

    v = D.vehicles(spark, sf).select("tr_id").distinct()
    p = D.predictions(spark, sf).where("i = 40 AND tr_id % 4 <> 0").select("tr_id", F.struct("risk_level").alias("prediction"))
    fresh = F.expr("CASE tr_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'stale' ELSE 'offline' END")
    return summarize(v.join(p, "tr_id", "left").withColumn("freshness", fresh))


@query("A14", "SELECT round(avg(abs(prediction_s - e.delay_s)), 6) AS mae_s, count(e.delay_s) AS checked FROM f_predictions p LEFT JOIN f_stop_events e ON e.stop_id = p.target_stop_id")
def live_accuracy(spark, sf):
    from fleetlag.plans import live as L

    p = D.predictions(spark, sf).withColumns({"actual_delay_s": F.lit(None).cast("double"), "abs_error_s": F.lit(None).cast("double")})
    return rounded(L.accuracy(L.check_predictions(p, D.stop_events(spark, sf))))


@query(
    "A16",
    """SELECT (SELECT count(*) FROM f_plan) AS planned_visits, (SELECT count(*) FROM f_stop_events) AS stop_events,
       (SELECT count_if(t <= m) FROM (SELECT t, max(t) OVER (PARTITION BY tr_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM f_telemetry)) AS rejected_late_ticks,
       (SELECT count(*) FROM f_telemetry WHERE NOT ok) AS invalid_location, (SELECT CAST(max(t) * 1000 - max(CASE WHEN row_id % 3 = 0 THEN t * 1000 END) AS BIGINT) FROM f_telemetry) AS lag_ms""",
)
def matcher_quality(spark, sf):
    from fleetlag.plans.evaluation import matcher_quality as quality

    t = D.telemetry(spark, sf).withColumn("entry_id", F.concat_ws("-", (F.col("t") * 1000).cast("bigint"), F.lit(0)))
    done = t.where("row_id % 3 = 0")
    return quality(D.plan(spark, sf), D.stop_events(spark, sf), t, done)


@query(
    "A17",
    """SELECT count(*) AS total, count(cur_dev_s) AS covered, round(count(cur_dev_s) / count(*), 6) AS coverage, count_if(target_stop_id % 9 = 0) AS missing_reference,
       count(CASE WHEN target_stop_id % 9 > 0 THEN cur_dev_s END) AS scored, round(avg(abs(CASE WHEN target_stop_id % 9 > 0 THEN cur_dev_s - target END)), 6) AS mae_s,
       round(avg(CASE WHEN target_stop_id % 9 > 0 THEN cur_dev_s - target END), 6) AS bias_s,
       round(quantile_cont(abs(CASE WHEN target_stop_id % 9 > 0 THEN cur_dev_s - target END), 0.95), 6) AS p95_abs_error_s FROM f_points""",
)
def coverage_report(spark, sf):
    from fleetlag.plans.evaluation import coverage_report as report

    p = D.points(spark, sf).select(
        F.col("cur_dev_s").alias("estimate_s"), F.when(F.col("target_stop_id") % 9 > 0, F.col("target")).alias("reference_s")
    )
    return rounded(report(p))


_FIT = """
    f_grid_{n} AS (SELECT g, x, y, i, y - (-0.5 + i * 0.01::DOUBLE) * x AS r FROM ({src}), range(201) AS s(i)),
    f_med_{n} AS (SELECT g, i, quantile_cont(r, 0.5) AS b FROM f_grid_{n} GROUP BY g, i),
    f_fit_{n} AS (SELECT g, arg_min(i, (e, i)) AS i, arg_min(b, (e, i)) AS b FROM (
      SELECT q.g, q.i, any_value(m.b) AS b, round(avg(abs(q.r - m.b)), 9) AS e FROM f_grid_{n} q JOIN f_med_{n} m ON m.g = q.g AND m.i = q.i GROUP BY q.g, q.i) GROUP BY g)"""


def fit_views(n, src):
    """The line fit as SQL views ``f_grid_n, f_med_n, f_fit_n`` over rows (g, x, y)."""
    import re

    text = _FIT.format(n=n, src=src)
    out = {}
    for m in re.finditer(r"(f_\w+) AS \((.*?)\)(?=,\s*f_\w+ AS \(|$)", text.strip(), re.S):
        out[m.group(1)] = m.group(2)
    return out


@query(
    "A18",
    "SELECT g AS part, round(-0.5 + i * 0.01::DOUBLE, 6) AS a, round(b, 6) AS b FROM f_fit_a",
    fit_views("a", "SELECT part AS g, coalesce(cur_dev_s, 0) AS x, target AS y FROM f_points"),
)
def l1_line(spark, sf):
    return rounded(B.fit_l1_lines(D.points(spark, sf), ["part"], "cur_dev_s", "target"))


@query(
    "M2",
    """SELECT sample_id, round(coalesce(-0.5 + i * 0.01::DOUBLE, 1) * persistence + coalesce(b, 0), 6) AS base FROM f_scored s LEFT JOIN f_fit_b ON g = s.layover""",
    {**SCORED, **fit_views("b", "SELECT layover AS g, persistence AS x, target AS y FROM f_scored")},
)
def two_line_baseline(spark, sf):
    s = scored(spark, sf)
    lines = B.fit_two_lines(s)
    return rounded(B.predict_line(s, lines, ["layover"], "base").select("sample_id", "base"))


_MIX = "((g % 2147483647) * 2654435761) % 4294967296"
_FOLDS = {
    **SCORED,
    "f_sizes": "SELECT run AS g, count(*) AS n FROM f_scored GROUP BY 1",
    "f_folds": f"""SELECT g, CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS fold FROM (
       SELECT g, row_number() OVER (ORDER BY -n, {_MIX}, g) - 1 AS r FROM f_sizes)""",
}


@query("A21", "SELECT sample_id, CAST(fold AS INTEGER) AS fold FROM f_scored JOIN f_folds ON g = run", _FOLDS)
def balanced_folds(spark, sf):
    return B.group_folds(scored(spark, sf), "run", 5).select("sample_id", "fold")


@query(
    "M3",
    """SELECT sample_id, round(coalesce(-0.5 + i * 0.01::DOUBLE, 1) * s.persistence + coalesce(b, 0), 6) AS base FROM f_scored s JOIN f_folds f ON f.g = s.run
       LEFT JOIN f_fit_c c ON c.g = f.fold * 2 + CAST(s.layover AS INT)""",
    {
        **_FOLDS,
        **fit_views("c", "SELECT h * 2 + CAST(layover AS INT) AS g, persistence AS x, target AS y FROM f_scored JOIN f_folds ff ON ff.g = run, range(5) AS t(h) WHERE h <> fold"),
    },
)
def out_of_fold_baseline(spark, sf):
    folded = B.group_folds(scored(spark, sf), "run", 5)
    return rounded(B.out_of_fold_lines(folded).select("sample_id", "base"))


@query("M4", "SELECT sample_id, CASE WHEN hint = 'gps' THEN 0.5 WHEN synthetic THEN 0.25 ELSE 1 END::DOUBLE AS weight FROM f_scored", SCORED)
def row_weights(spark, sf):
    s = scored(spark, sf).withColumn("hint", F.expr("CASE WHEN hint = 'gps' THEN 'outage' ELSE hint END"))
    return s.select("sample_id", B.row_weights(0.25, 0.5).alias("weight"))


@query(
    "M8",
    """SELECT sample_id, round(0.3 * target + 0.7 * model, 6) AS oof,
       round(1 / (1 + exp(-(0.3 * ln(p / (1 - p)) + 0.7 * ln(q / (1 - q))))), 6) AS oof_late FROM (
       SELECT *, ((target_stop_id % 9) + 0.5) / 10.0 AS p, ((target_stop_id % 7) + 0.5) / 8.0 AS q FROM f_scored)""",
    SCORED,
)
def blended_forecast(spark, sf):
    from fleetlag.plans.evaluation import blend_tables

    s = scored(spark, sf)
    late = lambda m: (F.col("target_stop_id") % (m - 1) + 0.5) / F.lit(float(m))
    one = s.select("sample_id", "hint", "run", F.col("target").alias("oof"), late(10).alias("oof_late"))
    two = s.select("sample_id", "hint", "run", F.col("model").alias("oof"), late(8).alias("oof_late"))
    return rounded(blend_tables([one, two], [0.3, 0.7], ["sample_id", "hint", "run"]).select("sample_id", "oof", "oof_late"))


@query("A20", "SELECT round(quantile_cont(target - model, 0.1), 6) AS lo, round(quantile_cont(target - model, 0.9), 6) AS hi FROM f_scored WHERE NOT synthetic", SCORED)
def residual_interval(spark, sf):
    from fleetlag.plans.evaluation import residual_interval as interval

    return rounded(interval(scored(spark, sf).where("NOT synthetic"), "target", "model"))


@query(
    "A24",
    """SELECT mark, failures, rows_per_min, degraded_share, p50, p95, max, count FROM (
       SELECT CAST(ceil(us / 1e6 / 3600) * 3600 AS BIGINT) AS mark, count_if(event_type = 'error') AS failures, round(sum(k % 5 + 1) * 60 / 300, 1) AS rows_per_min,
       round(sum(CASE WHEN event_type = 'signup' THEN k % 5 + 1 ELSE 0 END) / sum(k % 5 + 1), 3) AS degraded_share,
       round(quantile_disc(value, 0.5), 1) AS p50, round(quantile_disc(value, 0.95), 1) AS p95, round(max(value), 1) AS max, count(*) AS count
       FROM f_events WHERE us / 1e6 >= ceil(us / 1e6 / 3600) * 3600 - 300 GROUP BY 1)""",
)
def service_figures(spark, sf):
    return ME.service_figures(calls(spark, sf))


_TICKS = {
    "f_deliv": "SELECT row_id, t, CAST(t * 1000 AS BIGINT) + row_id % 7 * 50 AS ms FROM f_telemetry",
    "f_pub": """SELECT tr_id, t, CAST(t * 1000 AS BIGINT) + 5000 + (tr_id * 13) % 97 AS published_ms, CASE WHEN i % 30 = 0 THEN 'fallback' ELSE 'm1' END AS model_version FROM f_predictions""",
    "f_ticks": """SELECT p.t, count(*) AS n, max(published_ms) AS published_ms, bool_or(model_version = 'fallback') AS fallback,
       any_value((SELECT arg_min(ms, row_id) FROM f_deliv d WHERE d.t >= p.t)) AS clock_ms FROM f_pub p GROUP BY p.t""",
}


def _stream_logs(spark, sf):
    t = D.telemetry(spark, sf).select("row_id", "t", ((F.col("t") * 1000).cast("bigint") + F.expr("row_id % 7 * 50")).alias("ms"))
    p = D.predictions(spark, sf).select(
        "tr_id",
        "t",
        ((F.col("t") * 1000).cast("bigint") + 5000 + F.expr("(tr_id * 13) % 97")).alias("published_ms"),
        F.expr("CASE WHEN i % 30 = 0 THEN 'fallback' ELSE 'm1' END").alias("model_version"),
    )
    return t, p


@query("A25", "SELECT t, n, published_ms, fallback, clock_ms, published_ms - clock_ms AS lag_ms FROM f_ticks", _TICKS)
def tick_latency(spark, sf):
    return ME.tick_latency(*_stream_logs(spark, sf))


@query(
    "A25",
    """SELECT a.*, b.step_p50, c.* FROM (SELECT count(*) AS ticks, count_if(fallback) AS fallback_ticks, (SELECT count(*) FROM f_pub) AS rows,
         (SELECT count(DISTINCT tr_id) FROM f_pub) AS vehicles FROM f_ticks) a,
       (SELECT quantile_cont(s, 0.5) AS step_p50 FROM (SELECT t - lag(t) OVER (ORDER BY t) AS s FROM f_ticks)) b,
       (SELECT round(quantile_cont(CAST(l AS DOUBLE), 0.5), 1) AS lag_p50, round(quantile_cont(CAST(l AS DOUBLE), 0.95), 1) AS lag_p95, round(quantile_cont(CAST(l AS DOUBLE), 0.99), 1) AS lag_p99,
         max(l) AS lag_max, round(regr_intercept(l, n)) AS base_ms, round(regr_slope(l, n), 1) AS per_vehicle_ms FROM (SELECT published_ms - clock_ms AS l, n FROM f_ticks WHERE NOT fallback AND clock_ms IS NOT NULL)) c""",
    _TICKS,
)
def tick_report(spark, sf):
    return ME.tick_report(*_stream_logs(spark, sf))


@query("A19")
def bootstrap_interval(spark, sf):
    s = scored(spark, sf).withColumn("d", F.abs(F.col("model") - F.col("target")) - F.abs(F.col("persistence") - F.col("target")))
    return ME.paired_interval(s, "d", "run", samples=500)


@query(
    "U3",
    """SELECT problem, CAST(sum(n) AS BIGINT) AS rows, min(sample_id) AS example FROM (
       SELECT sample_id, 'duplicated' AS problem, 1 AS n FROM f_points WHERE target_stop_id % 10 = 3 AND target_stop_id % 7 > 0
       UNION ALL SELECT sample_id, 'missing', 1 FROM f_points WHERE target_stop_id % 7 = 0
       UNION ALL SELECT 'x' || sample_id, 'unknown', 1 FROM f_points WHERE target_stop_id % 11 = 0
       UNION ALL SELECT sample_id, 'non_finite', CASE WHEN target_stop_id % 10 = 3 THEN 2 ELSE 1 END FROM f_points WHERE target_stop_id % 13 = 0 AND target_stop_id % 7 > 0
       UNION ALL SELECT 'x' || sample_id, 'non_finite', 1 FROM f_points WHERE target_stop_id % 13 = 0 AND target_stop_id % 11 = 0) GROUP BY problem""",
)
def submission_check(spark, sf):
    p = D.points(spark, sf)
    text = F.expr("CASE WHEN target_stop_id % 13 = 0 THEN 'nan' ELSE cast(target as string) END").alias("prediction")
    rows = (
        p.where("target_stop_id % 7 > 0").select("sample_id", text)
        .unionByName(p.where("target_stop_id % 7 > 0 AND target_stop_id % 10 = 3").select("sample_id", text))
        .unionByName(p.where("target_stop_id % 11 = 0").select(F.concat(F.lit("x"), "sample_id").alias("sample_id"), text))
    )
    return sinks.submission_problems(rows, p)


@query(
    "U1",
    """SELECT sample_id, part, hint FROM f_points, (VALUES ('given'), ('gps')) AS h(hint) WHERE part <> 'validate'
       UNION ALL SELECT sample_id, part, 'outage' FROM f_points WHERE part = 'train'""",
)
def labeled_parts(spark, sf):
    from fleetlag.plans.evaluation import labeled_union

    p = D.points(spark, sf).select("sample_id", "part")
    labeled = p.where("part <> 'validate'")
    return labeled_union({"given": labeled, "gps": labeled, "outage": p.where("part = 'train'")})


@query("U2", "SELECT sample_id, c AS copy, true AS in_range, true AS known_kind FROM f_points, range(2) AS r(c)")
def outage_copies(spark, sf):
    from fleetlag.plans.evaluation import outage_points

    c = outage_points(D.points(spark, sf))
    return c.select(
        "sample_id", F.col("copy").cast("bigint").alias("copy"), F.col("gap_s").between(60, 900).alias("in_range"),
        F.col("outage").isin("silence", "no_position").alias("known_kind"),
    )


_CONTRIB = [("carried_delay", 37), ("layover", 41), ("slow_traffic", 43), ("long_dwell", 47), ("chronic_segment", 53), ("timetable", 59), ("signal", 61)]


def _contributions():
    return {n: (F.expr(f"(event_id * {m}) % 101") - 50).cast("double") for n, m in _CONTRIB}


_CROWS = "SELECT event_id, unnest([" + ", ".join(f"{{'i': {i}, 'k': '{n}', 's': (event_id * {m}) % 101 - 50}}" for i, (n, m) in enumerate(_CONTRIB)) + "]) AS c FROM f_events"


@query(
    "O3",
    """SELECT e.event_id, coalesce(r.reasons, '') AS reasons FROM f_events e LEFT JOIN (SELECT event_id, string_agg(c.k, '|' ORDER BY rn) AS reasons FROM (
       SELECT event_id, c, row_number() OVER (PARTITION BY event_id ORDER BY c.s DESC, c.i) AS rn FROM f_crows) WHERE rn <= 3 AND c.s >= 15 GROUP BY event_id) r USING (event_id)""",
    {"f_crows": _CROWS},
)
def top_reasons(spark, sf):
    return D.events(spark, sf).select("event_id", F.array_join(X.top_reasons(_contributions()), "|").alias("reasons"))


@query(
    "O4",
    """SELECT event_id, CASE WHEN max(c.s) > 0 THEN arg_min(c.k, (-c.s, c.i)) ELSE arg_min(c.k, (c.s, c.i)) END AS reason,
       CAST(CASE WHEN max(c.s) > 0 THEN max(c.s) ELSE min(c.s) END AS DOUBLE) AS seconds FROM f_crows GROUP BY event_id""",
    {"f_crows": _CROWS},
)
def main_reason(spark, sf):
    m = D.events(spark, sf).select("event_id", X.main_reason(_contributions()).alias("m"))
    return m.select("event_id", "m.reason", "m.seconds")


@query("T5", """SELECT row_id, coalesce(t <= max(t) OVER (PARTITION BY tr_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM f_telemetry""")
def late_ticks(spark, sf):
    return M.late_ticks(D.telemetry(spark, sf)).select("row_id", "late")


@query("A26", "SELECT tr_id, min(t) AS first_t, max(t) AS last_t FROM f_clean GROUP BY tr_id")
def observed_bounds(spark, sf):
    return M.observed_bounds(ticks(spark, sf))
