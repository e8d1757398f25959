"""Histogram boosting against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlag.operators import boosting as BO

NAMES = ["a", "b", "c"]
SCHEMA = "n bigint, a double, b double, c double, y double, w double, late double, fold int"


def sample(n=400, seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = float(r.integers(0, 40)), float(r.normal()), float(r.integers(0, 3))
        a = None if r.random() < 0.2 else a
        y = (3.0 * a if a is not None and a > 25 else 80.0 if a is None else 0.0) + 10 * (b > 0.3) + float(r.normal())
        rows.append((i, a, b if i % 17 else None, c, y, float(r.choice([0.5, 1.0, 2.0])), float(y > 40), i % 3))
    return rows


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def matrix(rows):
    return np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows], dtype=float)


def lower_median(values, weights):
    if not len(values):
        return 0.0
    values = np.asarray(values, dtype=np.float32)
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(np.asarray(weights)[order])
    return float(values[order][np.searchsorted(2 * upto, upto[-1])])


def plain_trees(x, y, w, edges, config, start):
    """The same rule row by row: every candidate split tried on the rows themselves."""
    margin, trees = np.full(len(y), start), []
    for _ in range(config.trees):
        slope, node, splits = w * np.sign(y - margin), np.zeros(len(y), dtype=int), []
        for _ in range(config.depth):
            best = None
            for f in range(x.shape[1]):
                for cut, edge in enumerate(edges[f]):
                    for null_right in (False, True):
                        right = np.where(np.isnan(x[:, f]), null_right, ~(x[:, f] <= edge))
                        gain = 0.0
                        for k in range(node.max() + 1):
                            for side in (False, True):
                                mine = (node == k) & (right == side)
                                if mine.any():
                                    gain += slope[mine].sum() ** 2 / (w[mine].sum() + config.l2)
                        gain = round(gain, 6)
                        if best is None or gain > best[0]:
                            best = gain, (f, cut, null_right), right
            splits.append(best[1])
            node = 2 * node + best[2]
        values = np.array([lower_median((y - margin)[node == k], w[node == k]) for k in range(2**config.depth)])
        trees.append((splits, values))
        margin = margin + config.step * values[node]
    return trees, margin


def test_trees_equal_a_plain_fit(table, rows):
    config = BO.BoostConfig(trees=4, depth=3, step=0.5, l2=2.0, bins=12, flush=3)
    got = BO.fit(table, NAMES, "y", config, weight=F.col("w")).models[-1]
    x, y, w = matrix(rows), np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    assert got.start == lower_median(y, w)
    want, margin = plain_trees(x, y, w, got.edges, config, got.start)
    assert [t.splits for t in got.trees] == [s for s, _ in want]
    for t, (_, values) in zip(got.trees, want):
        assert np.array_equal(t.values, values)
    assert np.allclose(got.margin(x), margin)
    scored = {r.n: r.m for r in table.select("n", got.column().alias("m")).collect()}
    assert np.allclose([scored[r[0]] for r in rows], margin)
    assert any(s[2] for t in got.trees for s in t.splits)  # NULL took the right side somewhere


def test_trees_do_not_depend_on_partitions(table, monkeypatch):
    config = BO.BoostConfig(trees=3, depth=2, step=0.3, bins=16)
    edges = BO.bin_edges(table, NAMES, 16)
    one = BO.fit(table, NAMES, "y", config, weight=F.col("w"), edges=edges)
    monkeypatch.setattr(BO, "TASK_ROWS", 50)
    many = BO.fit(table.repartition(8, "n"), NAMES, "y", config, weight=F.col("w"), edges=edges)
    assert one.models[-1].to_json() == many.models[-1].to_json()


@pytest.mark.parametrize("loss, label", [("absolute", "y"), ("logistic", "late")])
def test_folds_in_one_pass_equal_fits_of_their_own(table, rows, loss, label):
    config = BO.BoostConfig(trees=5, depth=2, step=0.3, bins=16, loss=loss)
    edges = BO.bin_edges(table, NAMES, 16)
    both = BO.fit(table, NAMES, label, config, fold=F.col("fold"), folds=3, edges=edges)
    assert len(both.models) == 4 and len(both.curve) == 6
    for k in (0, 2):
        alone = BO.fit(table.where(F.col("fold") != k), NAMES, label, config, edges=edges).models[-1]
        assert alone.to_json() == both.models[k].to_json()
    x, y, fold = matrix(rows), np.array([r[4 if label == "y" else 6] for r in rows]), np.array([r[7] for r in rows])
    for n in (0, 5):
        margin = np.choose(fold, [m.prefix(n).margin(x) for m in both.models[:3]])
        error = np.abs(y - margin) if loss == "absolute" else np.logaddexp(0, margin) - y * margin
        assert both.curve[n] == pytest.approx(error.mean(), abs=1e-5)
    assert both.curve[5] < both.curve[0]


def test_the_fit_ends_at_the_held_out_minimum(table):
    config = BO.BoostConfig(trees=200, depth=3, step=0.8, l2=0.0, bins=16, patience=4)
    got = BO.fit(table, NAMES, "y", config, fold=F.col("fold"), folds=3)
    assert got.best < 200 and len(got.curve) < 100
    assert got.curve[got.best] == min(got.curve[1:])


def test_nodes_and_json_keep_the_margin(table, rows):
    from fleetlag.plans import model as MO

    got = BO.fit(table, NAMES, "y", BO.BoostConfig(trees=3, depth=3, bins=16)).models[-1]
    back = BO.BoostedTrees.from_json(got.to_json())
    x = matrix(rows)
    assert np.array_equal(back.margin(x), got.margin(x))
    far = np.where(np.isnan(x), MO.MISSING, x)
    assert np.allclose(sum(t["weight"] * MO._walk(t, far) for t in got.nodes()), got.margin(x))


def test_empty_null_and_constant_columns(spark, table):
    config = BO.BoostConfig(trees=2, depth=2, bins=8)
    empty = BO.fit(table.limit(0), NAMES, "y", config)
    assert empty.models[0].trees == [] and empty.models[0].start == 0.0
    nulls = table.withColumns({"a": F.lit(None).cast("double"), "b": F.lit(float("nan")), "c": F.lit(1.0)})
    got = BO.fit(nulls, NAMES, "y", config, weight=F.col("w")).models[-1]
    assert got.margin(np.full((1, 3), np.nan))[0] == pytest.approx(got.start, abs=30)
    unlabelled = table.withColumn("y", F.when(F.col("n") % 2 == 0, F.col("y")))
    half = table.where("n % 2 = 0")
    edges = BO.bin_edges(half, NAMES, 8)
    assert BO.fit(unlabelled, NAMES, "y", config, edges=edges).models[-1].to_json() == BO.fit(half, NAMES, "y", config, edges=edges).models[-1].to_json()
    with pytest.raises(ValueError, match="loss must be"):
        BO.BoostConfig(loss="moon")


def test_bits_keep_the_order():
    v = np.array([-1e9, -3.5, -1e-20, -0.0, 0.0, 1e-20, 2.0, 1e9])
    code = BO.ordered_bits(v)
    assert (np.diff(code) >= 0).all() and code[3] == code[4]
    assert [BO.from_ordered_bits(int(c)) for c in code] == [float(np.float32(x)) for x in v]


def test_right_children_are_the_rest_of_their_parent(table, monkeypatch):
    config = BO.BoostConfig(trees=1, depth=3, bins=8)
    counted, sums = [], BO._Fit._sums

    def watched(self, per_task):
        got = sums(self, per_task)
        counted.append(len(got[0]))
        return got

    monkeypatch.setattr(BO._Fit, "_sums", watched)
    work = BO.Growth(table, NAMES, "y", config, weight=F.col("w"), fold=F.col("fold"), folds=2).work
    splits = [[], [], []]
    above = work.histograms(splits, False)
    for level in range(2):
        splits = [[*s, (1, 3 + level, True)] for s in splits]
        full = work.histograms(splits, False)
        halved = work.histograms(splits, False, above[:2])
        assert counted[-1] < counted[-2]
        assert all(np.array_equal(a, b) for a, b in zip(full[:2], halved[:2]))
        above = full


def test_another_model_keeps_step(table):
    config = BO.BoostConfig(trees=12, depth=2, step=0.8, bins=16, patience=2)
    other = BO.Growth(table.where("fold < 2"), NAMES, "y", config)
    got = BO.fit(table, NAMES, "y", config, fold=F.col("fold"), folds=3, alongside=other.more)
    assert got.best <= len(other.models[-1].trees) <= len(got.curve)
    alone = BO.fit(table.where("fold < 2"), NAMES, "y", BO.BoostConfig(trees=got.best, depth=2, step=0.8, bins=16))
    assert other.models[-1].prefix(got.best).to_json() == alone.models[-1].to_json()


@pytest.mark.parametrize("loss, label", [("absolute", "y"), ("logistic", "late")])
def test_held_rows_give_the_trees_of_passes(table, monkeypatch, loss, label):
    config = BO.BoostConfig(trees=14, depth=2, step=0.8, l2=1.0, bins=16, patience=3, loss=loss, flush=3)
    edges, fits = BO.bin_edges(table, NAMES, 16), []
    for held_bytes, held_trees in ((50_000, 32), (50_000, 2), (0, 32)):  # one job, several, a job for each pass
        monkeypatch.setattr(BO, "HELD_BYTES", held_bytes)
        monkeypatch.setattr(BO, "HELD_TREES", held_trees)
        other = BO.Growth(table.where("fold < 2"), NAMES, label, config, edges=edges)
        assert other.held == (held_bytes > 0)
        got = BO.fit(table, NAMES, label, config, weight=F.col("w"), fold=F.col("fold"), folds=3, edges=edges, alongside=other.more)
        kept = len(other.models[-1].trees)
        assert got.best <= kept <= len(got.curve)
        other.more()  # goes on where it stood
        assert len(other.models[-1].trees) == min(kept + 1, 14)
        fits.append(([m.to_json() for m in got.models], got.curve, other.models[-1].prefix(got.best + 1).to_json()))
    assert fits[0] == fits[1] == fits[2]


def test_jobs_of_a_fit_do_not_grow_with_its_trees(spark, table):
    jobs = []
    for trees in (2, 9):
        spark.sparkContext.setJobGroup(f"trees {trees}", "")
        assert len(BO.fit(table, NAMES, "y", BO.BoostConfig(trees=trees, depth=2, bins=8)).models[-1].trees) == trees
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees {trees}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[0] == jobs[1]
