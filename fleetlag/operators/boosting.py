"""Boosted symmetric trees from histograms.

Columns are cut into bins once and kept as one byte a feature, NULL in a bin of its own. A level of a tree has one split
for all its nodes: every task adds up gradients by (node, feature, bin), the sums meet in one shuffle whose size depends
on depth, features and bins alone, and the best split is chosen from them. A split also learns which side NULL takes.
Under absolute loss a leaf is the weighted median of its residuals (exact for residuals in single precision, the lower
one of two), found in two passes over the halves of the residual's bits; under logistic loss it is a Newton step.

The models of all folds and the one of all rows grow in the same passes, so cross-validation costs the jobs of one
fit. Of two children only the left one is counted, the right one is the rest of its parent. Gradients are whole multiples
of ``1 / SCALE``: sums do not depend on partitions or on repeated tasks.

Where the bins of all rows are few (``HELD_BYTES``), a task for each model holds them and grows many trees in one job; the
driver adds up the held-out errors of the models after 32 trees, 64 more, 128 more, and drops the trees beyond the end. More
rows take a job for each pass over all models. Sums of a few tasks are then added up by the driver, those of more meet in a
shuffle; margins are written every ``flush`` trees, in between a task applies the few newest trees itself, so nothing is
cached. Both give the same trees.

Rows without a label, or with a weight of NULL or zero, train nothing. NaN counts as NULL. An empty table gives models
of no trees. Equal gains go to the first feature, then the lowest cut, then NULL to the left.
"""

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlag.session import cut_lineage

SCALE = 1 << 20  # parts of a unit of gradient or weight
NULL_BIN = 255
LOSSES = ("absolute", "logistic")
TASK_ROWS = 250_000  # rows of a task; histograms are small against them
FEW_TASKS = 4  # up to so many tasks hand their sums to the driver without a shuffle
HELD_BYTES = 50_000_000  # bins that one task may hold: 1.1 million rows of 43 features
HELD_TREES = 32  # trees of the first job over held rows


@dataclass(frozen=True)
class BoostConfig:
    trees: int = 3000
    depth: int = 4
    step: float = 0.03
    l2: float = 30.0
    bins: int = 128
    patience: int = 50  # trees without a lower held-out error before the fit ends
    loss: str = "absolute"
    flush: int = 16

    def __post_init__(self):
        if self.loss not in LOSSES:
            raise ValueError(f"loss must be one of {', '.join(LOSSES)}, got {self.loss!r}")
        if not (1 <= self.depth <= 8 and 2 <= self.bins <= NULL_BIN and self.trees >= 0 and self.flush >= 1):
            raise ValueError("depth must be 1 to 8, bins 2 to 255, flush at least 1, trees not negative")


@dataclass
class Tree:
    """``splits`` are ``(feature, cut, null_right)``, the first one the highest bit of a leaf's number."""

    splits: list
    values: np.ndarray
    rows: np.ndarray  # weight of the training rows of each leaf


@dataclass
class BoostedTrees:
    features: list
    edges: list  # per feature the upper bounds of its bins
    step: float
    start: float = 0.0
    trees: list = field(default_factory=list)

    def prefix(self, count: int) -> "BoostedTrees":
        return BoostedTrees(self.features, self.edges, self.step, self.start, self.trees[:count])

    def margin(self, matrix: np.ndarray) -> np.ndarray:
        """Start and trees of rows given as doubles, NaN for NULL."""
        return self.start + added(self.trees, binned(matrix, self.edges), self.step)

    def column(self) -> Column:
        """The margin of each row of a table that has the features."""
        return margin_column([self], F.lit(0))

    def importance(self) -> np.ndarray:
        """Per feature what its splits change: the spread of the values on both sides, by rows."""
        total = np.zeros(len(self.features))
        for t in self.nodes()[1:]:
            for i in np.flatnonzero(~t["leaf"]):
                a, b = t["left"][i], t["right"][i]
                if t["rows"][a] and t["rows"][b]:
                    between = (t["value"][a] - t["value"][b]) ** 2 * t["rows"][a] * t["rows"][b] / t["rows"][i]
                    total[t["feature"][i]] += between
        return total / total.sum() if total.sum() else total

    def nodes(self) -> list[dict]:
        """The trees as arrays of nodes, a parent before its children; the start is a tree of one leaf."""
        one = np.zeros(1, dtype=int)
        root = {"weight": 1.0, "value": np.array([self.start]), "feature": one, "cut": np.zeros(1), "left": one, "right": one,
                "leaf": np.array([True]), "rows": np.ones(1), "null_right": np.array([False])}
        return [root, *[self._heap(t) for t in self.trees]]

    def _heap(self, tree: Tree) -> dict:
        depth, n = len(tree.splits), 2 ** (len(tree.splits) + 1) - 1
        rows, value = np.zeros(n), np.zeros(n)
        rows[n // 2 :], value[n // 2 :] = tree.rows, tree.values
        for i in range(n // 2 - 1, -1, -1):
            a, b = 2 * i + 1, 2 * i + 2
            rows[i] = rows[a] + rows[b]
            value[i] = (rows[a] * value[a] + rows[b] * value[b]) / rows[i] if rows[i] else (value[a] + value[b]) / 2
        level = np.repeat(np.arange(depth), 2 ** np.arange(depth))
        inner = np.arange(n // 2)
        pad = np.zeros(n - n // 2)
        leaves = np.arange(n // 2, n)
        return {
            "weight": self.step, "value": value, "rows": rows, "leaf": np.arange(n) >= n // 2,
            "feature": np.concatenate([[tree.splits[k][0] for k in level], pad]).astype(int),
            "cut": np.concatenate([[self.edges[tree.splits[k][0]][tree.splits[k][1]] for k in level], pad]),
            "null_right": np.concatenate([[tree.splits[k][2] for k in level], pad]).astype(bool),
            "left": np.concatenate([2 * inner + 1, leaves]), "right": np.concatenate([2 * inner + 2, leaves]),
        }

    def to_json(self) -> str:
        trees = [[[list(map(int, s)) for s in t.splits], t.values.tolist(), t.rows.tolist()] for t in self.trees]
        edges = [e.tolist() for e in self.edges]
        return json.dumps({"features": self.features, "edges": edges, "step": self.step, "start": self.start, "trees": trees})

    @classmethod
    def from_json(cls, text: str) -> "BoostedTrees":
        d = json.loads(text)
        trees = [Tree([(f, c, bool(s)) for f, c, s in splits], np.array(v), np.array(r)) for splits, v, r in d["trees"]]
        return cls(d["features"], [np.array(e) for e in d["edges"]], d["step"], d["start"], trees)


@dataclass
class Boosting:
    models: list  # one per fold, then the one of all rows
    curve: list  # held-out error with 0, 1, 2 ... trees

    @property
    def best(self) -> int:
        """Number of trees, one at least, with the least held-out error."""
        return int(np.argmin(self.curve[1:])) + 1 if len(self.curve) > 1 else len(self.models[-1].trees)


# --- bins and leaves -------------------------------------------------------------------------


def bin_edges(table: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper bounds of the bins: approximate quantiles of all rows, one aggregate of mergeable sketches."""
    shares = F.array(*[F.lit((k + 1) / bins) for k in range(bins)])
    numbers = [F.col(c).cast("double") for c in features]
    row = table.agg(
        *[F.percentile_approx(F.when(~F.isnan(c), c), shares, 10_000).alias(f"q{i}") for i, c in enumerate(numbers)]
    ).first()
    return [np.unique(np.array(q or [], dtype=float)) for q in row]


def binned(matrix: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers; bin ``b`` holds values up to ``edges[b]``, what lies above the last edge comes after it."""
    out = np.empty(matrix.shape, dtype=np.uint8)
    for f, cuts in enumerate(edges):
        x = matrix[:, f]
        out[:, f] = np.where(np.isnan(x), NULL_BIN, np.minimum(np.searchsorted(cuts, x), NULL_BIN - 1))
    return out


def leaves(splits: list, bins: np.ndarray) -> np.ndarray:
    at = np.zeros(len(bins), dtype=np.int64)
    for f, cut, null_right in splits:
        b = bins[:, f]
        at = 2 * at + np.where(b == NULL_BIN, null_right, b > cut)
    return at


def added(trees: list[Tree], bins: np.ndarray, step: float) -> np.ndarray:
    total = np.zeros(len(bins))
    for t in trees:
        total += step * t.values[leaves(t.splits, bins)]
    return total


def _doubles(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def margin_column(models: list[BoostedTrees], which: Column) -> Column:
    """Margin of the model numbered ``which`` in each row."""
    features = models[0].features

    @F.arrow_udf("double")
    def margin(values: pa.Array, number: pa.Array) -> pa.Array:
        matrix, number = _doubles(values, len(features)), number.to_numpy(zero_copy_only=False)
        out = np.zeros(len(matrix))
        for k in np.unique(number):
            out[number == k] = models[int(k)].margin(matrix[number == k])
        return pa.array(out)

    return margin(F.array(*[F.col(c).cast("double") for c in features]), which.cast("int"))


# --- passes over the rows --------------------------------------------------------------------


@dataclass
class _Rows:
    """One batch as arrays: bins, label, weight, fold, held-out mark and margin by model."""

    bins: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    fold: np.ndarray
    held: np.ndarray
    margins: np.ndarray

    def taught(self, model: int) -> np.ndarray:
        return (self.fold != model) & (self.weight > 0)


def _rows_of(batch: pa.RecordBatch, width: int, models: int, recent: list, step: float) -> _Rows:
    one = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, width)
    margins = _doubles(batch.column("margins"), models)
    for m in range(models):
        margins[:, m] += added(recent[m], bins, step)
    return _Rows(bins, one("y"), one("w"), one("fold"), one("held"), margins)


def _slopes(rows: _Rows, m: int, loss: str):
    """Gradient and curvature of the training rows, in parts."""
    y, margin, w = rows.y, rows.margins[:, m], rows.weight
    if loss == "absolute":
        return w * np.sign(y - margin), w
    p = 1 / (1 + np.exp(-margin))
    return np.rint(w * (y - p)), np.rint(w * p * (1 - p))


def _loss(rows: _Rows, loss: str) -> tuple[int, int]:
    """Summed error of held-out rows, in parts, and their number."""
    at = np.flatnonzero(rows.held)
    y, margin = rows.y[at], rows.margins[at, rows.fold[at]]
    if loss == "absolute":
        each = np.abs(y - margin)
    else:
        each = np.logaddexp(0, margin) - y * margin
    return int(np.rint(each * SCALE).sum()), len(at)


class _Fit:
    """The table of bins and margins, and the passes over it."""

    def __init__(self, state: DataFrame, edges: list, models: int, config: BoostConfig, tasks: int):
        self.state, self.edges, self.models, self.config, self.tasks = state, edges, models, config, tasks
        self.recent = [[] for _ in range(models)]

    def _sums(self, per_task) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``key, a, b`` in the order of keys, with the sums of what ``per_task(batches of rows)`` gives as arrays."""
        width, models, recent, step = len(self.edges), self.models, self.recent, self.config.step

        def run(batches):
            key, a, b = per_task(_rows_of(x, width, models, recent, step) for x in batches)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (key, a, b)], names=["key", "a", "b"])

        few = self.tasks <= FEW_TASKS
        state = self.state.coalesce(self.tasks) if few else self.state
        sums = state.mapInArrow(run, "key bigint, a bigint, b bigint")
        if not few:
            sums = sums.groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        got = sums.toArrow()
        key, place = np.unique(got.column("key").to_numpy(), return_inverse=True)
        totals = np.zeros((2, len(key)), dtype=np.int64)
        for total, name in zip(totals, ("a", "b")):
            np.add.at(total, place, got.column(name).to_numpy())
        return key, totals[0], totals[1]

    def histograms(self, splits: list[list], with_loss: bool, parents: tuple | None = None):
        """Gradient and curvature by (model, node, feature, bin), bounded by depth, features and bins; held-out loss.

        Given those of their ``parents``, only left children are counted.
        """
        models, width, loss = self.models, len(self.edges), self.config.loss
        nodes, halved = 2 ** len(splits[0]) // (1 if parents is None else 2), parents is not None
        shape = (models, nodes, width, NULL_BIN + 1)

        def per_task(parts):
            g, h = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64)
            lost = np.zeros(2, dtype=np.int64)
            for rows in parts:
                if with_loss:
                    lost += _loss(rows, loss)
                for m in range(models):
                    at = rows.taught(m)
                    slope, bend = (v[at] for v in _slopes(rows, m, loss))
                    bins = rows.bins[at]
                    node = leaves(splits[m], bins)
                    if halved:
                        left = node % 2 == 0
                        bins, slope, bend, node = bins[left], slope[left], bend[left], node[left] // 2
                    node = node * (NULL_BIN + 1)
                    for f in range(width):
                        code, size = node + bins[:, f], nodes * (NULL_BIN + 1)
                        g[m, :, f] += np.bincount(code, slope, size).astype(np.int64).reshape(nodes, -1)
                        h[m, :, f] += np.bincount(code, bend, size).astype(np.int64).reshape(nodes, -1)
            g, h = g.ravel(), h.ravel()
            key = np.flatnonzero((g != 0) | (h != 0))
            return np.append(key, -1), np.append(g[key], lost[0]), np.append(h[key], lost[1])

        key, a, b = self._sums(per_task)
        g, h, lost = np.zeros(np.prod(shape)), np.zeros(np.prod(shape)), (0, 0)
        for i in np.flatnonzero(key < 0):
            lost = int(a[i]), int(b[i])
        at = key >= 0
        g[key[at]], h[key[at]] = a[at] / SCALE, b[at] / SCALE
        g, h = g.reshape(shape), h.reshape(shape)
        if halved:
            g, h = (np.stack([v, all_ - v], axis=2).reshape(models, 2 * nodes, width, -1) for v, all_ in zip((g, h), parents))
        return g, h, lost[0] / SCALE / lost[1] if lost[1] else float("nan")

    def medians(self, splits: list[list]) -> np.ndarray:
        """Weighted median of the residuals in each (model, leaf); zero where there is none.

        A pass answers with at most 65536 counts a leaf, some thousands for residuals of a usual range.
        """
        models, size = self.models, 2 ** len(splits[0])

        def halves(chosen):
            def per_task(parts):
                keys, weights = [], []
                for rows in parts:
                    for m in range(models):
                        at = rows.taught(m)
                        node = m * size + leaves(splits[m], rows.bins[at])
                        code = ordered_bits(rows.y[at] - rows.margins[at, m])
                        w = rows.weight[at]
                        if chosen is not None:
                            mine = (code >> 16) == chosen[node]
                            node, code, w = node[mine], code[mine] & 0xFFFF, w[mine]
                        else:
                            code = code >> 16
                        part, place = np.unique(node << 16 | code, return_inverse=True)
                        keys.append(part)
                        weights.append(np.bincount(place, w, len(part)).astype(np.int64))
                if not keys:
                    return [], [], []
                part, place = np.unique(np.concatenate(keys), return_inverse=True)
                total = np.zeros(len(part), dtype=np.int64)
                np.add.at(total, place, np.concatenate(weights))
                return part, total, np.zeros(len(part), dtype=np.int64)

            key, total, _ = self._sums(per_task)
            return key >> 16, key & 0xFFFF, total

        def passing(node, half, weight, before=None):
            """Per node the first half at which the running weight reaches half of all, and the weight below it."""
            for k in np.unique(node):
                mine = node == k
                upto = np.cumsum(weight[mine])
                total, below = (upto[-1], 0) if before is None else before[k]
                i = int(np.searchsorted(2 * (upto + below), total))
                yield int(k), int(half[mine][i]), (int(total), int(below + upto[i] - weight[mine][i]))

        chosen, need = np.full(models * size, -1, dtype=np.int64), {}
        for node, half, total_below in passing(*halves(None)):
            chosen[node], need[node] = half, total_below
        out = np.zeros(models * size)
        for node, half, _ in passing(*halves(chosen), need):
            out[node] = from_ordered_bits(chosen[node] << 16 | half)
        return out.reshape(models, size)

    def grow(self) -> tuple[list[Tree], float]:
        """The next tree of every model, and the held-out error before it."""
        c, splits, parents = self.config, [[] for _ in range(self.models)], None
        for level in range(c.depth):
            g, h, lost = self.histograms(splits, level == 0, parents)
            if level == 0:
                error = lost
            parents = g, h
            splits = [[*s, best_split(g[m], h[m], self.edges, c.l2)] for m, s in enumerate(splits)]
        ends = [_children(g[m], h[m], splits[m][-1]) for m in range(self.models)]
        if c.loss == "absolute":
            values = self.medians(splits)
        else:
            values = [np.divide(gs, hs + c.l2, out=np.zeros_like(gs), where=hs + c.l2 > 0) for gs, hs in ends]
        return [Tree(splits[m], values[m], ends[m][1]) for m in range(self.models)], error

    def keep(self, trees: list[Tree]) -> None:
        for m, t in enumerate(trees):
            self.recent[m].append(t)
        if len(self.recent[0]) >= self.config.flush:
            self.settle()

    def settle(self) -> None:
        """Write the margins with the newest trees applied."""
        width, models, recent, step = len(self.edges), self.models, self.recent, self.config.step
        names = self.state.columns

        def run(batches):
            for batch in batches:
                margins = _rows_of(batch, width, models, recent, step).margins
                yield batch.set_column(names.index("margins"), "margins", pa.array(list(margins), pa.list_(pa.float64())))

        self.state = cut_lineage(self.state.mapInArrow(run, self.state.schema))
        self.recent = [[] for _ in range(models)]


class _Held(_Fit):
    """The passes of one model, over rows that a task keeps in memory."""

    def __init__(self, rows: _Rows, edges: list, config: BoostConfig):
        self.rows, self.edges, self.models, self.config = rows, edges, 1, config
        self.written, self.newest, self.count = rows.margins.copy(), np.zeros_like(rows.margins), 0

    def _sums(self, per_task) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.asarray(v, dtype=np.int64) for v in per_task([self.rows]))

    def keep(self, trees: list[Tree]) -> None:
        # added in the order of the passes that write margins, so that both round alike
        self.newest[:, 0] += added(trees, self.rows.bins, self.config.step)
        self.rows.margins = self.written + self.newest
        self.count += 1
        if self.count % self.config.flush == 0:
            self.written, self.newest = self.rows.margins.copy(), np.zeros_like(self.newest)


def _rows_held(batches, width: int) -> _Rows:
    parts = [_rows_of(x, width, 1, [[]], 0.0) for x in batches if x.num_rows]
    if not parts:
        none = np.zeros(0)
        return _Rows(np.zeros((0, width), dtype=np.uint8), none, none, none.astype(int), none.astype(bool), np.zeros((0, 1)))
    return _Rows(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("bins", "y", "weight", "fold", "held", "margins")))


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Single-precision values as whole numbers of the same order."""
    bits = (x.astype(np.float32) + np.float32(0)).view(np.uint32).astype(np.int64)
    return np.where(bits >> 31, 0xFFFFFFFF - bits, bits | 0x80000000)


def from_ordered_bits(code: int) -> float:
    bits = code & 0x7FFFFFFF if code >> 31 else 0xFFFFFFFF - code
    return float(np.array([bits], dtype=np.uint32).view(np.float32)[0])


def _children(g: np.ndarray, h: np.ndarray, split) -> tuple[np.ndarray, np.ndarray]:
    f, cut, null_right = split
    out = []
    for sums in (g[:, f], h[:, f]):
        left = sums[:, : cut + 1].sum(1) + (0 if null_right else sums[:, NULL_BIN])
        out.append(np.column_stack([left, sums.sum(1) - left]).ravel())
    return out[0], out[1]


def best_split(g: np.ndarray, h: np.ndarray, edges: list, l2: float) -> tuple[int, int, bool]:
    """The split of a whole level with the greatest sum of ``G² / (H + l2)`` over its sides."""
    totals = [v.sum(2, keepdims=True) for v in (g, h)]
    below = [np.cumsum(v[:, :, :NULL_BIN], axis=2) for v in (g, h)]
    gone = [v[:, :, NULL_BIN :] for v in (g, h)]
    score = lambda a, b: np.divide(a * a, b + l2, out=np.zeros_like(a), where=b > 0)
    gains = []
    for null_right in (False, True):
        lg, lh = (b if null_right else b + n for b, n in zip(below, gone))
        gains.append((score(lg, lh) + score(totals[0] - lg, totals[1] - lh)).sum(0))
    gain = np.round(np.stack(gains, axis=2), 6)
    known = np.arange(NULL_BIN)[None, :] < np.array([len(e) for e in edges])[:, None]
    gain[~known] = -1.0
    f, cut, side = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return int(f), int(cut), bool(side)


# --- fitting ---------------------------------------------------------------------------------


class Growth:
    """Models that grow tree by tree; the arguments are those of :func:`fit`."""

    def __init__(
        self, table: DataFrame, features: list[str], label: str, config: BoostConfig, weight: Column | None = None,
        fold: Column | None = None, folds: int = 0, held: Column | None = None, offsets: list[Column] | None = None,
        edges: list[np.ndarray] | None = None,
    ):
        models = folds + 1
        y = F.col(label).cast("double")
        w = F.coalesce(F.lit(1.0) if weight is None else weight.cast("double"), F.lit(0.0))
        rows = table.where(y.isNotNull() & ~F.isnan(y)).select(
            *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
            y.alias("y"), F.round(w * SCALE).alias("w"),
            (F.lit(-1) if fold is None else fold.cast("int")).alias("fold"),
            (F.lit(False) if not folds else F.lit(True) if held is None else F.coalesce(held, F.lit(False))).alias("held"),
            F.array(*[o.cast("double") for o in offsets or [F.lit(0.0)] * models]).alias("margins"),
        )
        rows = cut_lineage(rows)
        names = [f"x{i}" for i in range(len(features))]
        edges = bin_edges(rows, names, config.bins) if edges is None else [np.asarray(e, dtype=float) for e in edges]

        def pack(batches):
            for batch in batches:
                matrix = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names])
                codes = binned(matrix, edges)
                arrays = [pa.array([r.tobytes() for r in codes], pa.binary()), *[batch.column(c) for c in ("y", "w", "fold", "held", "margins")]]
                yield pa.RecordBatch.from_arrays(arrays, names=["bins", "y", "w", "fold", "held", "margins"])

        count = rows.count()
        parts = max(1, -(-count // TASK_ROWS))
        state = rows.coalesce(parts).mapInArrow(pack, "bins binary, y double, w double, fold int, held boolean, margins array<double>")
        self.work = work = _Fit(cut_lineage(state), edges, models, config, parts)
        starts = _starts(work, config, offsets is not None)
        self._models = [BoostedTrees(list(features), edges, config.step, float(s)) for s in starts]
        if any(starts):
            shift = F.array(*[F.lit(float(s)) for s in starts])
            work.state = cut_lineage(work.state.withColumn("margins", F.zip_with("margins", shift, lambda a, b: a + b)))
        self.usable = any(len(e) for e in edges)
        self.held = count * len(features) <= HELD_BYTES
        self.asked = 0

    @property
    def models(self) -> list[BoostedTrees]:
        """The models with all trees that were asked for."""
        due, self.asked = self.asked, 0
        if due:
            self.hold(due)
        return self._models

    def keep(self, trees: list[Tree]) -> None:
        for m, t in zip(self._models, trees):
            m.trees.append(t)
        self.work.keep(trees)

    def more(self) -> None:
        """One tree more of every model, up to the number of the configuration; held rows wait until the models are read."""
        if self.usable and len(self._models[-1].trees) + self.asked < self.work.config.trees:
            if self.held:
                self.asked += 1
            else:
                self.keep(self.work.grow()[0])

    def hold(self, trees: int, folds: int = 0) -> list:
        """Up to ``trees`` trees more of every model over held rows; the held-out errors, where there are folds."""
        curve, best, made, due = [], 0, 0, HELD_TREES
        while made < trees or (folds and not curve):
            count = min(due, trees - made) if folds else trees
            errors = self._held_trees(count)
            # the error after the last tree is that before the next one
            for n in range(made, made + count + (made + count == trees) if folds else 0):
                lost, rows = (sum(e[n - made][i] for e in errors) for i in range(2))
                curve.append(lost / SCALE / rows if rows else float("nan"))
                if n < trees:
                    best = n if n == 0 or curve[n] < curve[best] else best
                    if n - best >= self.work.config.patience:
                        for m in self._models:
                            del m.trees[len(m.trees) - (made + count - n) :]
                        return curve
            made, due = made + count, 2 * due
        return curve

    def _held_trees(self, count: int) -> list:
        """Grow ``count`` trees of every model; by model the held-out error, in parts, and its rows before each tree and at the end."""
        edges, config, before = self.work.edges, self.work.config, [m.trees for m in self._models]

        def run(batches):
            model, rows = None, []
            for batch in batches:
                if batch.num_rows:
                    model = batch.column("model")[0].as_py()
                    rows.append(batch)
            if model is None:
                return
            held = _Held(_rows_held(rows, len(edges)), edges, config)
            for t in before[model]:
                held.keep([t])
            grown, errors = BoostedTrees([], [], config.step), []
            for _ in range(count):
                errors.append(_loss(held.rows, config.loss))
                made, _ = held.grow()
                held.keep(made)
                grown.trees += made
            errors.append(_loss(held.rows, config.loss))
            arrays = [pa.array([model], pa.int32()), pa.array([grown.to_json()]), pa.array([json.dumps(errors)])]
            yield pa.RecordBatch.from_arrays(arrays, names=["model", "trees", "errors"])

        models = len(self._models)
        mine = F.col("fold") == F.col("model")
        rows = self.work.state.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(models - 1)))).select(
            "bins", "y", "w", F.when(mine, 0).otherwise(-1).alias("fold"), (F.col("held") & F.coalesce(mine, F.lit(False))).alias("held"),
            F.array(F.element_at("margins", F.col("model") + 1)).alias("margins"), "model",
        )
        told = rows.repartitionById(models, "model").mapInArrow(run, "model int, trees string, errors string").collect()
        errors = []
        for r in sorted(told):
            self._models[r.model].trees += BoostedTrees.from_json(r.trees).trees
            errors.append(json.loads(r.errors))
        return errors


def fit(
    table: DataFrame, features: list[str], label: str, config: BoostConfig, weight: Column | None = None,
    fold: Column | None = None, folds: int = 0, held: Column | None = None, offsets: list[Column] | None = None,
    edges: list[np.ndarray] | None = None, alongside: Callable[[], None] | None = None,
) -> Boosting:
    """Trees of ``folds`` models, each without the rows of its fold, and of one with all rows.

    ``offsets`` are what each of them starts from in a row (the trees come on top), ``held`` marks the rows on which the
    held-out error is measured. It ends a fit with folds after ``patience`` trees without a lower one. ``alongside`` is
    called once for each tree, while it grows or after a fit of held rows, so that another model keeps step with this fit.
    """
    growth = Growth(table, features, label, config, weight, fold, folds, held, offsets, edges)
    work, curve, best = growth.work, [], 0
    if growth.held and growth.usable:
        curve = growth.hold(config.trees, folds)
        for _ in growth.models[-1].trees if alongside else ():
            alongside()
        return Boosting(growth.models, curve)
    with ThreadPoolExecutor(1) as pool:
        for n in range(config.trees + 1 if growth.usable else 0):
            if n == config.trees:
                if folds:
                    curve.append(work.histograms([[] for _ in range(folds + 1)], True)[2])
                break
            other = pool.submit(alongside) if alongside else None
            trees, error = work.grow()
            if other:
                other.result()
            if folds:
                curve.append(error)
                best = n if n == 0 or error < curve[best] else best
                if n - best >= config.patience:
                    break
            growth.keep(trees)
    return Boosting(growth.models, curve)


def _starts(work: _Fit, config: BoostConfig, offset: bool) -> np.ndarray:
    """First value of every model: the weighted median of its labels, or the log-odds of its share; none with offsets."""
    if offset:
        return np.zeros(work.models)
    if config.loss == "absolute":
        return work.medians([[] for _ in range(work.models)])[:, 0]
    sums = work.state.groupBy("fold").agg(F.sum(F.col("w") * F.col("y")).alias("ones"), F.sum("w").alias("n")).collect()
    out = []
    for m in range(work.models):
        ones, n = (sum(r[c] for r in sums if r.fold != m) for c in ("ones", "n"))
        p = (ones + SCALE / 2) / (n + SCALE)
        out.append(np.log(p / (1 - p)))
    return np.array(out)
