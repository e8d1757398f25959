"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes that may be repeated are found and dealt by anchors (``repeats``). Inside a shard the suffixes that start
windows are split by prefixes of growing length (1, 2, 4 ... words) until a group has at most ``GROUP`` suffixes;
a shard is read whole first, so ``GROUP`` bounds the sort and not the memory.
Each group stands for one subtree, which is not built, by sorting its suffixes along the remaining prefix steps. Neighbours that
agree on all steps hang below an internal node of ``WINDOW`` words or deeper, that is, they start a repeat. A group
of one suffix is a leaf and is dropped at any length; a group still large at full depth is such a node as a whole.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Rows: null and empty texts have no words; copies (of any length from
one window on) are repeats of each other and keep nothing but words outside windows; rows without doc_id are left
out; repeated rows are copies. Other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag.llm.repeats import KEY, Shard, Unit, covered, marked, segments, spans_by_document
from fleetlag.llm.texts import byte_sums, prefix_sums, row_key, rows_bytes, span, word_spans

WINDOW = 35
UNIT = Unit(words=True, length=WINDOW, gram=8, earlier=False)
GROUP = 1 << 18


def prefix_steps(length: int) -> list[tuple[int, int]]:
    """Prefix lengths 1, 2, 4 ... up to ``length``, as word ranges that each step adds."""
    ends = [1]
    while ends[-1] < length:
        ends.append(min(2 * ends[-1], length))
    return list(zip([0, *ends[:-1]], ends))


def _split(keys: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return np.split(order, np.flatnonzero(k[1:] != k[:-1]) + 1)


def deep_suffixes(sums: np.ndarray, at: np.ndarray, length: int, group: int = GROUP) -> np.ndarray:
    """Which suffixes (starts ``at``) share their first ``length`` words with another."""
    ladder = prefix_steps(length)
    out = np.zeros(len(at), bool)
    waiting = [(np.arange(len(at)), 0)]
    while waiting:
        suffixes, step = waiting.pop()
        if len(suffixes) < 2:
            continue
        if step == len(ladder):
            out[suffixes] = True
        elif len(suffixes) > group:
            a, b = ladder[step]
            parts = _split(span(sums, at[suffixes] + a, at[suffixes] + b))
            waiting += [(suffixes[p], step + 1) for p in parts]
        else:
            out[suffixes[_subtree(sums, at[suffixes], ladder[step:])]] = True
    return out


def _subtree(sums, at, ladder) -> np.ndarray:
    """Leaves below an internal node at the depth where the ladder ends."""
    keys = [span(sums, at + a, at + b) for a, b in ladder]
    order = np.lexsort(keys[::-1])
    agree = np.ones(len(at) - 1, bool)
    for k in keys:
        agree &= k[order[1:]] == k[order[:-1]]
    below = np.zeros(len(at), bool)
    below[1:] |= agree
    below[:-1] |= agree
    return order[below]


def judge(shard: Shard) -> np.ndarray:
    content = np.asarray(shard.content)
    starts, ends, first = word_spans(content, np.concatenate([[0], np.cumsum(shard.size)]))
    sums = prefix_sums(span(byte_sums(content), starts, ends))
    before = np.cumsum(shard.units) - shard.units
    at = np.repeat(first[:-1] - before, shard.units) + np.arange(shard.units.sum())
    return deep_suffixes(sums, at, WINDOW)


def copies(docs: DataFrame) -> DataFrame:
    """One row of each distinct text, with the number of rows that have it."""
    kept = docs.groupBy(F.sha2("text", 256).alias("digest")).agg(
        F.min(F.struct(*KEY)).alias("k"), F.count(F.lit(1)).alias("n_copies")
    )
    return kept.select("k.doc_id", "k.text_hash", "n_copies")


def dedup(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row, and ``kept`` on request."""
    rows = row_key(docs)
    firsts = copies(rows)
    spans = spans_by_document(marked(segments(rows.join(firsts.select(*KEY), KEY).dropDuplicates(KEY), UNIT), UNIT, judge))
    met = rows.join(firsts, KEY, "left").join(spans, KEY, "left")

    def run(batches):
        for b in batches:
            out = []
            for text, n_copies, found in zip(rows_bytes(b["text"]), b["n_copies"].to_pylist(), b["spans"].to_pylist()):
                words = text.split()
                if n_copies == 1:
                    gone = covered(len(words), found)
                else:  # copies: every word is in a repeated window, if there is one
                    gone = np.full(len(words), len(words) >= WINDOW)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if gone.any() else b" ".join(words)
                out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None))
            columns = list(zip(*out)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    out = met.select("doc_id", "text", "n_copies", "spans").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    )
    return out if keep_text else out.drop("kept")
