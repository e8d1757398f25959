"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives P are labelled documents of the training folds; the unlabelled text U is every document.
With g(x) = w.x over binned text statistics and the squared loss l(g, y) = (g - y)^2 / 4 the risk

    prior * E_P l(g, +1) + max(0, E_U l(g, -1) - prior * E_P l(g, -1))

depends on first and second moments only. Spark sums those over all rows (partial sums per task, then per
``SUM_GROUPS`` groups), so nothing is sampled; the driver gets a fixed number of fixed-size matrices and takes
gradient steps on the exact risk. When the second term turns negative the step goes the other way on it, which
is the non-negative correction. The score is the chance of a positive at a text's g: the prior times the density
of P over that of U, monotone in g. The class prior is the share of positives among the training folds' labels.

Rows: null and empty texts have statistics of zero and get a score like any other; rows without doc_id are left
out; repeated rows are scored each; a document labelled both ways is no trusted positive; labels without a
document or with a null are ignored. Without positives or without documents the weights stay zero and every
score is the prior. Other columns are ignored.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag.llm.texts import SPACE, ascii_lower, byte_sums, fold, keyed, span, steps, utf8, word_spans
from fleetlag.session import cut_lineage

FOLDS = 5
CHECK_FOLD = 4
BINS = 8
SUM_GROUPS = 16
#: Ridge on the weights: a constant and a share that falls with the number of positives.
RIDGE = (1e-3, 10.0)
STEPS = 400
PRIOR_RANGE = (0.05, 0.95)
THRESHOLD = 0.3
LEVELS = 60
#: Weight of g itself in the score, so that it orders texts of one level.
TIE = 0.02

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLASSES = {
    "upper": np.isin(np.arange(256), np.arange(65, 91)),
    "digit": np.isin(np.arange(256), np.arange(48, 58)),
    "letter": _LETTER,
    "space": SPACE,
    "line": np.arange(256) == 10,
    "stop": np.isin(np.arange(256), [46, 33, 63]),
    "comma": np.isin(np.arange(256), [44, 59, 58]),
    "bang": np.arange(256) == 33,
    "mark": np.isin(np.arange(256), list(b"#$%&*^~@")),
    "bracket": np.isin(np.arange(256), list(b"()[]{}<>|\\/=_+")),
}
FEATURES = [
    *[c for c in _CLASSES], "size", "words", "word_length", "long_words", "distinct_words", "distinct_pairs",
    "caps_words", "mark_ends", "distinct_lines", "short_lines", "line_length", "comma_words", "stop_words", "longest_word",
    "repeated_words",
]


def text_statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    data, offsets = utf8(column)
    out = np.zeros((len(column), len(FEATURES)), np.float32)
    for a, b in steps(np.diff(offsets).tolist()):
        part = data[offsets[a] : offsets[b]]
        out[a:b] = _statistics(part, offsets[a : b + 1] - offsets[a])
    return out


def _distinct(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct keys of each row."""
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=n)


def _statistics(data, offsets) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    safe = np.maximum(size, 1)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    columns = [sums(mask[data]) / safe for mask in _CLASSES.values()]
    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first)
    w = np.maximum(words, 1)
    row = np.repeat(np.arange(n), words)
    length = ends - starts
    total = lambda values: np.bincount(row, weights=values, minlength=n)
    fingerprints = byte_sums(ascii_lower(data))
    word = span(fingerprints, starts, ends)
    upper = np.concatenate([[0], np.cumsum(_CLASSES["upper"][data])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    caps = (upper[ends] - upper[starts] == letters[ends] - letters[starts]) & (length > 1) & (upper[ends] > upper[starts])
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    same = row[1:] == row[:-1]
    pairs = word[:-1] * np.uint64(3) + word[1:]
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    breaks = np.flatnonzero((data == 10) | cut[1:]) if len(data) else np.zeros(0, np.int64)
    line_start = np.concatenate([[0], breaks[:-1] + 1]).astype(np.int64) if len(breaks) else breaks
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    lines = np.bincount(line_row, minlength=n)
    ln = np.maximum(lines, 1)
    short = np.bincount(line_row, weights=(breaks - line_start < 20), minlength=n)
    columns += [
        np.log1p(size), np.log1p(words), total(length) / w, total(length > 14) / w, _distinct(word, row, n) / w,
        _distinct(pairs[same], row[1:][same], n) / w, total(caps) / w,
        total(_CLASSES["mark"][last] | (last == 33)) / w,
        _distinct(span(fingerprints, line_start, breaks), line_row, n) / ln, short / ln, np.log1p(size / ln),
        total(last == 44) / w, total(length <= 3) / w, np.log1p(longest),
        np.bincount(row[1:][same], weights=(word[1:] == word[:-1])[same], minlength=n) / w,
    ]
    return np.stack(columns, axis=1)


def bins_of(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One-hot bins of every statistic and a constant."""
    n, d = values.shape
    out = np.zeros((n, d * (BINS + 1) + 1))
    for j in range(d):
        at = np.searchsorted(edges[j], values[:, j], side="left")
        out[np.arange(n), j * (BINS + 1) + at] = 1
    out[:, -1] = 1
    return out


def feature_table(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of its text, written once."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], _as_lists(text_statistics(b["text"]))], ["doc_id", "x"])

    return cut_lineage(keyed(docs).mapInArrow(run, "doc_id long, x array<float>"))


def _as_lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def trusted(labels: DataFrame) -> DataFrame:
    """Training-fold label of each document: 1 only where every label says so. ``positive`` is for the weights,
    ``check`` for the calibration: fold ``CHECK_FOLD`` is kept for it, so that it sees no fitted positive."""
    whole = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(FOLDS) != 0))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    part = F.when(fold(FOLDS) == CHECK_FOLD, F.lit(1)).otherwise(F.lit(0))
    return whole.select(
        "doc_id", "quality", (F.col("quality") * (1 - part)).alias("positive"), (F.col("quality") * part).alias("check")
    )


def moments(rows: DataFrame, edges: np.ndarray) -> dict[str, np.ndarray]:
    """Counts, sums and second moments of U and P over all rows."""
    d = len(FEATURES) * (BINS + 1) + 1

    def part(batches):
        totals = np.zeros((2, d, d))
        for b in batches:
            x = bins_of(_matrix(b["x"]), edges)
            totals[0] += x.T @ x
            p = x[b["positive"].fill_null(0).to_numpy(zero_copy_only=False) == 1]
            totals[1] += p.T @ p
        yield pa.RecordBatch.from_arrays([pa.array([totals.tobytes()], pa.binary())], ["m"])

    def add(batches):
        totals = np.zeros(2 * d * d)
        for b in batches:
            for m in b["m"].to_pylist():
                totals += np.frombuffer(m)
        yield pa.RecordBatch.from_arrays([pa.array([totals.tobytes()], pa.binary())], ["m"])

    partial = rows.select("x", "positive").mapInArrow(part, "m binary")
    spread = partial.repartition(SUM_GROUPS, F.spark_partition_id()).mapInArrow(add, "m binary")
    total = sum((np.frombuffer(bytes(r["m"])) for r in spread.collect()), np.zeros(2 * d * d)).reshape(2, d, d)
    return {"U": total[0], "P": total[1]}


def inverse(m: np.ndarray) -> np.ndarray:
    """Inverse of a positive definite matrix by elimination; no threaded library call in the driver."""
    n = len(m)
    a = np.hstack([m, np.eye(n)])
    for i in range(n):
        a[i] /= a[i, i]
        factor = a[:, i].copy()
        factor[i] = 0
        a -= factor[:, None] * a[i]
    return a[:, n:]


def fit(total: dict[str, np.ndarray], prior: float) -> np.ndarray:
    """Weights of least non-negative risk; the last entry of a moment is its row count."""
    u, p = total["U"], total["P"]
    d = len(u)
    if not u[-1, -1] or not p[-1, -1]:
        w = np.zeros(d)
        w[-1] = 2 * prior - 1
        return w
    ridge = RIDGE[0] + RIDGE[1] / p[-1, -1]
    u, p = u / u[-1, -1], p / p[-1, -1]
    times = lambda m, w: np.einsum("ij,j->i", m, w)
    scale = inverse(u + ridge * np.eye(d))
    w = np.zeros(d)
    for _ in range(STEPS):
        uw, pw = times(u, w), times(p, w)
        risk_u = (np.sum(w * uw) + 2 * np.sum(u[-1] * w) + 1) / 4  # of calling U negative
        risk_p = (np.sum(w * pw) + 2 * np.sum(p[-1] * w) + 1) / 4  # of calling P negative
        back = (uw + u[-1] - prior * (pw + p[-1])) / 2
        if risk_u - prior * risk_p < 0:
            step = -back
        else:
            step = prior * (pw - p[-1]) / 2 + back + ridge * w / 2
        w = w - 0.5 * times(scale, step)
    return w


def _raw(column: pa.Array, edges, weights) -> np.ndarray:
    return np.einsum("ij,j->i", bins_of(_matrix(column), edges), weights)


def calibration(rows: DataFrame, edges, weights, prior: float) -> np.ndarray:
    """Chance of a positive for each step of g: prior * density of P / density of U, made monotone.

    Both histograms run over all rows; they have ``LEVELS`` entries at any size."""

    def run(batches):
        counts = np.zeros((2, LEVELS), np.int64)
        for b in batches:
            level = _level(_raw(b["x"], edges, weights))
            counts[0] += np.bincount(level, minlength=LEVELS)
            counts[1] += np.bincount(level[b["check"].fill_null(0).to_numpy(zero_copy_only=False) == 1], minlength=LEVELS)
        columns = [pa.array(np.arange(LEVELS)), pa.array(counts[0]), pa.array(counts[1])]
        yield pa.RecordBatch.from_arrays(columns, ["level", "u", "p"])

    found = rows.select("x", "check").mapInArrow(run, "level long, u long, p long")
    u, p = np.zeros(LEVELS), np.zeros(LEVELS)
    for r in found.groupBy("level").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).collect():
        u[r["level"]], p[r["level"]] = r["u"], r["p"]
    if not u.sum() or not p.sum():
        return np.full(LEVELS, prior)
    blocks: list[list[float]] = []  # pool neighbours that fall: positives, rows, levels
    for a, b in zip(p / p.sum() * prior, u / u.sum()):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    out = np.concatenate([np.full(int(n), a / b if b else 0.0) for a, b, n in blocks])
    return np.clip(out, 0.0, 1.0)


def _level(g: np.ndarray) -> np.ndarray:
    return np.clip(((g + 1.5) / 3 * LEVELS).astype(np.int64), 0, LEVELS - 1)


@dataclass
class Model:
    """What scoring needs; its size does not depend on the corpus."""

    edges: np.ndarray
    weights: np.ndarray
    chance: np.ndarray

    def of_statistics(self, column: pa.Array) -> np.ndarray:
        g = _raw(column, self.edges, self.weights)
        return (1 - TIE) * self.chance[_level(g)] + TIE * np.clip((g + 1.5) / 3, 0.0, 1.0)

    def of_texts(self, column: pa.Array) -> np.ndarray:
        return self.of_statistics(_as_lists(text_statistics(column)))


def train(table: DataFrame, labels: DataFrame) -> Model:
    """Fit to a ``feature_table`` and the labels of the training folds."""
    quantiles = [F.percentile_approx(F.col("x")[j], [i / BINS for i in range(1, BINS)], 2000) for j in range(len(FEATURES))]
    found = table.agg(*[q.alias(f"q{j}") for j, q in enumerate(quantiles)]).first()
    edges = np.array([[*sorted(q), np.inf] if q else [0.0] * (BINS - 1) + [np.inf] for q in found], float)
    known = trusted(labels)
    share = known.agg(F.avg("quality")).first()[0]
    prior = float(np.clip(0.5 if share is None else share, *PRIOR_RANGE))
    rows = table.join(known, "doc_id", "left")
    weights = fit(moments(rows, edges), prior)
    return Model(edges, weights, calibration(rows, edges, weights, prior))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    table = feature_table(docs)
    model = train(table, labels)

    def run(batches):
        for b in batches:
            value = pa.array(model.of_statistics(b["x"]), pa.float64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], value], ["doc_id", "score"])

    return table.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        (fold(FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all columns, that the classifier accepts; no row is moved."""
    model = train(feature_table(docs), labels)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.of_texts(b["text"]) >= threshold))

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, docs.schema)
