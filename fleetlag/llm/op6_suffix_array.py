"""Suffix-array dedup by induced sorting over bytes, one shard in memory at a time.

Stretches that may be repeated are found and dealt by anchors (``repeats``). A shard is the text of its segments with
a separator after each. Its suffixes are sorted by induction: the suffixes that start where the text falls and then
rises (leftmost-S) are sorted by repeated sorts of 8-byte names, down to ``DEPTH`` bytes; scanning buckets upwards then
induces the order of all L suffixes, scanning downwards that of all S suffixes. The buckets are the priority queue:
256 first-in-first-out lists of suffix tuples, popped in byte order, whose chunks go to a file of the task's own
temporary folder beyond ``QUEUE`` tuples; this holds only tuples that wait, the order itself stays in memory, some 39
bytes a byte of shard. With the order comes whether neighbours have ``WINDOW`` bytes in common;
in each group of equal windows those of other documents than the smallest are marked. Common prefixes beyond the
window are never needed, so names stop at ``DEPTH`` bytes and the common-prefix value is kept as that truth value.

Rows: null and empty texts have no bytes; a copy of an earlier document loses all bytes if it has a window; rows with
one doc_id never remove from each other; rows without doc_id are left out. Other columns are ignored.
"""

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag.llm.repeats import KEY, Shard, Unit, covered, marked, segments, spans_by_document
from fleetlag.llm.texts import first_copies, row_key, rows_bytes

WINDOW = 50
UNIT = Unit(words=False, length=WINDOW, gram=20, earlier=True)
DEPTH = 64
QUEUE = 16 << 20
SEPARATOR = 0xFF  # no byte of UTF-8 text


class BucketQueue:
    """A priority queue by byte: suffixes of one byte come out in the order they went in."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.held = limit, 0
        self.chunks: list[list] = [[] for _ in range(256)]
        self.file = None

    def push(self, byte: int, suffixes: np.ndarray) -> None:
        self.chunks[byte].append(suffixes)
        self.held += len(suffixes)
        if self.held > self.limit:
            self._spill()

    def push_all(self, bytes_: np.ndarray, suffixes: np.ndarray) -> None:
        if not len(suffixes):
            return
        order = np.argsort(bytes_, kind="stable")
        b, s = bytes_[order], suffixes[order]
        cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            self.push(int(b[i]), s[i:j])

    def pop(self, byte: int) -> np.ndarray:
        """All suffixes of a byte that wait now."""
        chunks, self.chunks[byte] = self.chunks[byte], []
        out = [self._load(c) if isinstance(c, tuple) else c for c in chunks]
        self.held -= sum(len(c) for c in chunks if not isinstance(c, tuple))
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="queue-")
        self.file.seek(0, 2)
        for chunks in self.chunks:
            for i, c in enumerate(chunks):
                if not isinstance(c, tuple):
                    at = self.file.tell()
                    self.file.write(c.tobytes())
                    chunks[i] = (at, c.nbytes, c.dtype)
        self.held = 0

    def _load(self, where: tuple) -> np.ndarray:
        self.file.seek(where[0])
        return np.frombuffer(self.file.read(where[1]), where[2])


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, without a copy; ``text`` is padded by DEPTH bytes."""
    return np.ndarray((len(text) - 7,), ">u8", buffer=text, strides=(1,))


def s_type(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor (S); the last one is L."""
    n = len(text)
    out = np.zeros(n, bool)
    change = np.flatnonzero(text[1:] != text[:-1])
    if len(change):
        rising = text[change] < text[change + 1]
        out[: change[-1] + 1] = np.repeat(rising, np.diff(change, prepend=-1))
    return out


def by_group(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The order by group, then value: two plain sorts of numbers, as the places of the values fit beside the groups."""
    order = np.argsort(values)
    ranked = values[order]
    rank = np.empty(len(values), np.uint64)
    rank[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]]))
    return np.argsort((group.astype(np.uint64) << np.uint64(32)) | rank)


def sorted_by_names(view: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``places`` by the DEPTH bytes from each: equal names are sorted again by the names behind them."""
    name = view[places].astype(np.uint64)  # in the machine's byte order, which sorts faster
    order = np.argsort(name)
    places, name = places[order], name[order]
    same = name[1:] == name[:-1]
    for depth in range(8, DEPTH, 8):
        if not same.any():
            break
        tied = np.zeros(len(places), bool)
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        start = np.ones(len(at), bool)
        start[1:] = ~same[at[1:] - 1] | (at[1:] != at[:-1] + 1)
        group = np.cumsum(start)
        behind = view[places[at] + depth].astype(np.uint64)
        mixed = np.zeros(group[-1] + 1, bool)  # the other groups are in order as they are
        mixed[group[1:][(group[1:] == group[:-1]) & (behind[1:] != behind[:-1])]] = True
        moved = np.flatnonzero(mixed[group])
        inner = moved[by_group(group[moved], behind[moved])]
        places[at[moved]] = places[at[inner]]
        behind[moved] = behind[inner]
        still = np.zeros(len(places) - 1, bool)
        pair = (group[1:] == group[:-1]) & (behind[1:] == behind[:-1])
        still[at[1:][pair] - 1] = True
        same = still
    return places


def suffix_order(text: np.ndarray, queue: type = BucketQueue) -> np.ndarray:
    """All suffixes of ``text`` by their first DEPTH bytes at least."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    padded = np.concatenate([text, np.zeros(DEPTH + 8, np.uint8)])
    small = s_type(text)
    place = np.int32 if n < 2**31 - DEPTH else np.int64
    left = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(place)
    left = sorted_by_names(eights(padded), left)
    seeds, upward, downward = queue(), queue(), queue()
    seeds.push_all(text[left], left)
    large = [[] for _ in range(256)]

    def induce(found, into, wanted):
        before = found[found > 0] - 1
        before = before[small[before] == wanted]
        into.push_all(text[before], before)

    upward.push(int(text[n - 1]), np.array([n - 1], place))
    for byte in range(256):
        while len(found := upward.pop(byte)):
            large[byte].append(found)
            induce(found, upward, False)
        induce(seeds.pop(byte), upward, False)
    out = [[] for _ in range(256)]
    for byte in range(255, -1, -1):
        tail = []
        while len(found := downward.pop(byte)):
            tail.append(found)
            induce(found, downward, True)
        falling = np.concatenate(large[byte])[::-1] if large[byte] else np.zeros(0, place)
        large[byte] = []
        induce(falling, downward, True)
        rising = np.concatenate(tail)[::-1] if tail else np.zeros(0, place)
        out[byte] = [falling[::-1], rising]
    return np.concatenate([x for part in out for x in part])


def same_window(text: np.ndarray, order: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """Whether neighbours of the order have ``length`` bytes in common."""
    view = eights(text)
    out = np.ones(max(0, len(order) - 1), bool)
    for at in [*range(0, length - 7, 8), length - 8]:
        live = np.flatnonzero(out)
        out[live] = view[order[live] + at] == view[order[live + 1] + at]
    return out


def judge(shard: Shard) -> np.ndarray:
    count = len(shard.size)
    begin = np.cumsum(shard.size + 1) - (shard.size + 1)
    text = np.full(int((shard.size + 1).sum()) + DEPTH, SEPARATOR, np.uint8)
    mask = np.ones(len(text), bool)
    mask[begin + shard.size] = False
    mask[len(text) - DEPTH :] = False
    text[mask] = shard.content
    owner = np.full(len(text) - DEPTH, -1, np.int32)
    before = np.cumsum(shard.units) - shard.units
    window = np.repeat(begin - before, shard.units) + np.arange(shard.units.sum())
    owner[window] = np.repeat(np.arange(count), shard.units)
    order = suffix_order(text[: len(text) - DEPTH])
    order = order[owner[order] >= 0]  # suffixes that start a window
    same = same_window(text, order)
    start = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, np.int64)
    rank = np.unique(shard.doc, return_inverse=True)[1].astype(np.int32)  # documents by id
    doc = rank[owner[order]]
    least = np.minimum.reduceat(doc, start) if len(order) else doc
    size = np.diff(np.append(start, len(order)))
    good = np.zeros(len(text) - DEPTH, bool)
    good[order] = doc > np.repeat(least, size)
    return good[window]


def dedup(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row, and the bytes ``kept`` on request."""
    rows = row_key(docs)
    firsts = first_copies(rows)
    spans = spans_by_document(marked(segments(rows.join(firsts, KEY).dropDuplicates(KEY), UNIT), UNIT, judge))
    met = rows.join(firsts.withColumn("first", F.lit(True)), KEY, "left").join(spans, KEY, "left")

    def run(batches):
        for b in batches:
            out = []
            for text, first, found in zip(rows_bytes(b["text"]), b["first"].to_pylist(), b["spans"].to_pylist()):
                n = len(text)
                gone = covered(n, found) if first else np.full(n, n >= WINDOW)
                kept, runs = text, 0
                if gone.any():
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                out.append((n, n - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    out = met.select("doc_id", "text", "first", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    return out if keep_text else out.drop("kept")
