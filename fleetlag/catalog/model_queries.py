"""Training, evaluation and explanation of the delay model on the derived fleet day, with the library's settings."""

from pyspark.sql import functions as F

from fleetlag import settings as S
from fleetlag.catalog import fleetday as D
from fleetlag.catalog.join_queries import ticks
from fleetlag.catalog.metric_queries import SCORED, rounded, scored
from fleetlag.catalog.registry import query
from fleetlag.operators import boosting as BO
from fleetlag.plans import model as MO
from fleetlag.plans.features import build_features
from fleetlag.session import cut_lineage, scratch_path
from fleetlag.sources.sinks import submission_problems, write_submission

CONFIG = MO.TrainConfig()


def _inputs(spark, sf):
    return cut_lineage(D.points(spark, sf)), cut_lineage(D.plan(spark, sf)), cut_lineage(ticks(spark, sf))


def _table(spark, sf):
    points, plan, fixes = _inputs(spark, sf)
    table = MO.training_table(build_features(points, plan, fixes), plan)
    return cut_lineage(table), points, plan, fixes


@query("M5 M6 M9")
def model_forecast(spark, sf):
    table, *_ = _table(spark, sf)
    model = MO.fit_models(table, CONFIG, CONFIG.iterations, CONFIG.iterations)
    return model.predict(table).select("sample_id", "delay_s", "delay_lo_s", "delay_hi_s", "late_prob")


@query("M7 M10")
def model_report(spark, sf):
    table, *_ = _table(spark, sf)
    model, reports, _ = MO.train(table, CONFIG)
    return rounded(reports["cv"]).withColumn("trees_at_cap", F.lit(model.meta["at_cap"]))


# larger steps than the default, so that few trees reach the held-out minimum
BOOSTED = MO.TrainConfig(iterations=300, depth=4, step=0.25, solver="histogram", patience=5, classifier=False)

_TREE_FEATURES = {"cur_dev_s": [-60.0, 0.0, 30.0, 60.0, 90.0, 120.0, 180.0], "lead_s": [600.0, 660.0, 720.0, 780.0, 840.0]}
_L2 = 30.0


def _tree_views():
    """One tree of two levels in SQL: slopes at the median, the best cut of each level, the median of each leaf."""
    cuts = ", ".join(f"({f}, {c}, {e}::DOUBLE)" for f, es in enumerate(_TREE_FEATURES.values()) for c, e in enumerate(es))
    values = "CASE f " + " ".join(f"WHEN {f} THEN {name}" for f, name in enumerate(_TREE_FEATURES)) + " END"
    views = {
        **SCORED,
        "f_tree_rows": """SELECT sample_id, cur_dev_s, t_target - T AS lead_s, CAST(target AS DOUBLE) AS y FROM f_scored WHERE target IS NOT NULL""",
        "f_tree_start": "SELECT quantile_disc(CAST(y AS FLOAT), 0.5)::DOUBLE AS start FROM f_tree_rows",
        "f_tree_0": "SELECT *, sign(y - start) AS g, 0 AS node FROM f_tree_rows, f_tree_start",
        "f_tree_cuts": f"SELECT * FROM (VALUES {cuts}) c(f, cut, edge), (VALUES (0), (1)) s(side)",
    }
    for level in (1, 2):
        before = f"f_tree_{level - 1}"
        right = f"CASE WHEN {values} IS NULL THEN side ELSE CAST({values} > edge AS INT) END"
        views[f"f_tree_cut_{level}"] = f"""SELECT f, cut, edge, side FROM (
           SELECT f, cut, edge, side, go, node, sum(g) AS g, count(*) AS h FROM (
             SELECT f, cut, edge, side, node, g, {right} AS go FROM {before}, f_tree_cuts) GROUP BY ALL)
           GROUP BY ALL ORDER BY round(sum(g * g / (h + {_L2}::DOUBLE)), 6) DESC, f, cut, side LIMIT 1"""
        views[f"f_tree_{level}"] = f"SELECT b.sample_id, cur_dev_s, lead_s, y, start, g, 2 * node + {right} AS node FROM {before} b, f_tree_cut_{level}"
    return views


@query(
    "M5",
    """SELECT CAST(node AS BIGINT) AS leaf, (SELECT f FROM f_tree_cut_1) * 100 + (SELECT cut FROM f_tree_cut_1) AS first_split,
       (SELECT f FROM f_tree_cut_2) * 100 + (SELECT cut FROM f_tree_cut_2) AS second_split,
       round(quantile_disc(CAST(y - start AS FLOAT), 0.5)::DOUBLE, 4) AS value, count(*)::DOUBLE AS rows FROM f_tree_2 GROUP BY node""",
    _tree_views(),
)
def boosted_tree(spark, sf):
    """The first tree of a fit under absolute loss, leaf by leaf."""
    table = scored(spark, sf).withColumn("lead_s", F.col("t_target") - F.col("T"))
    edges = list(_TREE_FEATURES.values())
    model = BO.fit(table, list(_TREE_FEATURES), "target", BO.BoostConfig(trees=1, depth=2, l2=_L2), edges=edges).models[-1]
    rows = []
    for tree in model.trees:
        first, second = (100 * f + cut for f, cut, _ in tree.splits)
        rows += [(k, first, second, round(float(v), 4), float(n)) for k, (v, n) in enumerate(zip(tree.values, tree.rows)) if n]
    return spark.createDataFrame(rows, "leaf bigint, first_split int, second_split int, value double, rows double")


@query("M5 M7 M10 M9")
def boosted_report(spark, sf):
    table, *_ = _table(spark, sf)
    model, reports, _ = MO.train(table, BOOSTED)
    return rounded(reports["cv"]).withColumns(
        {"trees": F.lit(model.meta["iterations"]), "trees_at_cap": F.lit(model.meta["at_cap"])}
    )


def _adding_up(spark, sf, exact):
    table, *_ = _table(spark, sf)
    model = MO.fit_models(table, CONFIG, CONFIG.iterations, None)
    parts = MO.contributions(model, table, exact)
    total = sum((F.col(r) for r in S.REASONS), F.col("expected_s"))
    both = parts.hint("merge").join(model.predict(table).select("sample_id", "delay_s"), "sample_id")
    return both.withColumn("adds_up", F.abs(total - F.col("delay_s")) < 1e-6)


@query("M12 A23")
def reason_contributions(spark, sf):
    return _adding_up(spark, sf, False)


@query("M12 A23")
def exact_reason_contributions(spark, sf):
    return _adding_up(spark, sf, True)


@query("M13 M11")
def served_forecast(spark, sf):
    table, points, plan, fixes = _table(spark, sf)
    model = MO.fit_models(table, CONFIG, CONFIG.iterations, CONFIG.iterations)
    path = scratch_path(spark, "model")
    model.save(spark, path)
    return MO.forecast(points, plan, fixes, MO.DelayModel.load(spark, path))


@query("M15 S17")
def submission(spark, sf):
    table, *_ = _table(spark, sf)
    models = [MO.fit_models(table, MO.TrainConfig(seed=s), CONFIG.iterations, None) for s in (0, 1)]
    path = scratch_path(spark, "submission")
    write_submission(MO.average_submission(models, table), path)
    rows = spark.read.option("sep", ";").option("header", True).csv(path)
    problems = submission_problems(rows, table.select("sample_id"))
    return rows.select("sample_id", F.col("prediction").cast("double").alias("prediction")).withColumn(
        "problems", F.lit(problems.count())
    )


@query("O5")
def feature_importance(spark, sf):
    table, *_ = _table(spark, sf)
    model = MO.fit_models(table, CONFIG, CONFIG.iterations, None)
    return spark.createDataFrame(model.importance(10), "feature string, share double")


@query("A22")
def outage_scorecard(spark, sf):
    table, points, plan, fixes = _table(spark, sf)
    model = MO.fit_models(table, CONFIG, CONFIG.iterations, None)
    return MO.outage_scorecard(model, points, plan, fixes)
