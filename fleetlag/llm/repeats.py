"""Finding and collecting the stretches of documents that occur more than once, without moving the corpus.

Every window of ``length`` units (bytes or words) has an anchor: the gram of ``gram`` units with the smallest
fingerprint in it, the leftmost among equals. Equal windows have equal anchors, so a window can only be repeated if
its anchor is. One packed exchange (five bytes an anchor) finds the repeated anchors; the runs of windows around
them become segments, which go to the shard of their anchor. Equal segments of one step are sent once: the others
are settled where they are, so a passage that very many documents hold costs a shard one segment per step.
"""

import os
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag.llm.exchange import PACKED, answers, by_document, group_sizes, packed, part_of, unpacked
from fleetlag.llm.texts import byte_sums, part_count, partitions, prefix_sums, span, steps, utf8, word_spans

SEGMENTS = "part int, docs binary, hashes binary, row binary, start binary, units binary, size binary, content binary"
SPANS = "doc_id long, text_hash long, spans binary"
KEY = ["doc_id", "text_hash"]


@dataclass(frozen=True)
class Unit:
    """What a window is made of."""

    words: bool
    length: int
    gram: int
    earlier: bool  # only windows that a smaller doc_id holds count, else any second place


@dataclass
class Runs:
    """Runs of windows with one anchor, of all rows of a step."""

    row: np.ndarray
    first: np.ndarray  # first and last window of the run, as unit positions of the step
    last: np.ndarray
    key: np.ndarray
    whole: np.ndarray  # fingerprint of the segment
    begin: np.ndarray  # bytes of the segment in the step
    end: np.ndarray
    base: np.ndarray  # first unit of each row


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return values if have == width else np.minimum(values[: len(values) - (width - have)], values[width - have :])


def runs_of(data: np.ndarray, offsets: np.ndarray, unit: Unit) -> Runs:
    if unit.words:
        starts, ends, base = word_spans(data, offsets)
        sums = prefix_sums(span(byte_sums(data), starts, ends))
    else:
        starts = ends = None
        base, sums = offsets, byte_sums(data)
    total = len(sums) - 1
    none = np.zeros(0, np.int64)
    if total < unit.length:
        return Runs(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none, none, base)
    at = np.arange(total - unit.gram + 1)
    gram = span(sums, at, at + unit.gram)
    bits = np.uint64(max(1, int(total).bit_length()))
    least = sliding_least((gram >> bits << bits) | at.astype(np.uint64), unit.length - unit.gram + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    windows = np.maximum(np.diff(base) - unit.length + 1, 0)
    row = np.repeat(np.arange(len(windows)), windows)
    window = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + base[row]
    anchor = anchor[window]
    new = np.flatnonzero(np.diff(anchor, prepend=-1))
    first = window[new]
    last = window[np.append(new[1:], len(window)) - 1] if len(new) else first
    stop = last + unit.length
    return Runs(
        row[new], first, last, gram[anchor[new]], span(sums, first, stop),
        starts[first] if unit.words else first, ends[stop - 1] if unit.words else stop, base,
    )


def _steps(batch):
    data, offsets = utf8(batch["text"])
    ids = batch["doc_id"].to_numpy(zero_copy_only=False)
    hashes = batch["text_hash"].to_numpy(zero_copy_only=False)
    for a, b in steps(np.diff(offsets).tolist()):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ids[a:b], hashes[a:b]


def repeated(unit: Unit) -> Callable:
    def answer(keys, doc_ids, rows):
        order, group, starts = group_sizes(keys)
        if unit.earlier:
            d = doc_ids[order]
            several = np.minimum.reduceat(d, starts) < np.maximum.reduceat(d, starts) if len(d) else starts
        else:
            several = np.diff(np.append(starts, len(keys))) > 1
        out = np.zeros(len(keys), np.uint8)
        out[order] = several[group]
        return out

    return answer


def gathered(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Concatenated slices."""
    size = end - begin
    return data[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def segment_batch(r: Runs, keep, settled, data, ids, hashes, parts: int) -> pa.RecordBatch:
    """Rows of ``SEGMENTS``: kept runs by the part of their anchor; settled ones carry no content."""
    part = np.concatenate([part_of(r.key[keep], parts), part_of(hashes[r.row[settled]].view(np.uint64), parts)])
    run = np.concatenate([keep, settled])
    empty = np.arange(len(run)) >= len(keep)
    order = np.argsort(part, kind="stable")
    part, run, empty = part[order], run[order], empty[order]
    cuts = np.searchsorted(part, np.arange(parts + 1))
    columns = [[] for _ in range(8)]
    for p in np.flatnonzero(np.diff(cuts)):
        at, void = run[cuts[p] : cuts[p + 1]], empty[cuts[p] : cuts[p + 1]]
        rows, local = np.unique(r.row[at], return_inverse=True)
        begin, end = r.begin[at], np.where(void, r.begin[at], r.end[at])
        values = (
            int(p), ids[rows].tobytes(), hashes[rows].tobytes(), local.astype(np.uint32).tobytes(),
            (r.first[at] - r.base[r.row[at]]).astype(np.int64).tobytes(), (r.last[at] - r.first[at] + 1).astype(np.uint32).tobytes(),
            (end - begin).astype(np.uint32).tobytes(), gathered(data, begin, end).tobytes(),
        )
        for column, value in zip(columns, values):
            column.append(value)
    kinds = [pa.int32()] + [pa.binary()] * 7
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)],
        ["part", "docs", "hashes", "row", "start", "units", "size", "content"],
    )


def segments(texts: DataFrame, unit: Unit) -> DataFrame:
    """``SEGMENTS`` of all runs whose anchor is repeated. ``texts`` has distinct rows of KEY and text."""
    parts = part_count(texts.sparkSession)

    def ask(batches):
        for batch in batches:
            for a, b, data, offsets, ids, hashes in _steps(batch):
                r = runs_of(data, offsets, unit)
                yield packed(ids, hashes, np.bincount(r.row, minlength=b - a), r.key, parts)

    def collect(batches):
        for batch in batches:
            flags = batch["flags"].to_pylist()
            for a, b, data, offsets, ids, hashes in _steps(batch):
                r = runs_of(data, offsets, unit)
                cuts = np.searchsorted(r.row, np.arange(b - a + 1)).tolist()
                flag = np.concatenate([unpacked(r.key[s:e], parts, flags[a + i]) for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:]))])
                live = np.flatnonzero(flag)
                if not len(live):
                    continue
                # equal segments: the first (smallest id) stands for all
                order = np.lexsort((ids[r.row[live]], r.whole[live], r.key[live]))
                whole, key = r.whole[live][order], r.key[live][order]
                new = np.ones(len(live), bool)
                new[1:] = (whole[1:] != whole[:-1]) | (key[1:] != key[:-1])
                head = live[order][np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
                if unit.earlier:
                    settled = ids[r.row[live[order]]] > ids[r.row[head]]
                    keep = live[order][~settled & new]
                    again = ~settled & ~new  # the same document once more
                    keep = np.concatenate([keep, live[order][again]])
                else:
                    group = np.cumsum(new) - 1
                    settled = np.bincount(group)[group] > 1
                    keep = live[order][new]
                yield segment_batch(r, np.sort(keep), np.sort(live[order][settled]), data, ids, hashes, parts)

    flags = by_document(answers(texts.mapInArrow(ask, PACKED), repeated(unit)))
    return texts.join(flags, KEY).select(*KEY, "text", "flags").mapInArrow(collect, SEGMENTS)


@dataclass
class Shard:
    """Segments that meet: content bytes behind one another, and where each comes from."""

    content: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    units: np.ndarray  # windows of each segment


def marked(found: DataFrame, unit: Unit, judge: Callable[[Shard], np.ndarray]) -> DataFrame:
    """``SPANS``: for each document the unit ranges of windows that count.

    ``judge`` gives one truth value for every window of a shard's segments. A task spools its shards to files of its
    own temporary folder and takes one after another, so it never holds more than one."""

    def run(batches):
        with Spool() as spool:
            for b in batches:
                for row in b.to_pylist():
                    spool.add(row)
            for read in spool.shards():
                docs, hashes, row, start, units, size, content = read
                filled = np.flatnonzero(size > 0)
                hit = [(row[size == 0], start[size == 0], start[size == 0] + units[size == 0] - 1)]
                if len(filled):
                    shard = Shard(content, size[filled].astype(np.int64), docs[row[filled]], units[filled].astype(np.int64))
                    good = judge(shard)
                    segment = np.repeat(np.arange(len(filled)), shard.units)
                    window = np.arange(len(good)) - np.repeat(np.cumsum(shard.units) - shard.units, shard.units)
                    before = np.zeros(len(good), bool)
                    before[1:] = good[:-1] & (segment[1:] == segment[:-1])
                    after = np.zeros(len(good), bool)
                    after[:-1] = good[1:] & (segment[1:] == segment[:-1])
                    head, tail = np.flatnonzero(good & ~before), np.flatnonzero(good & ~after)
                    at = filled[segment[head]]
                    hit.append((row[at], start[at] + window[head], start[at] + window[tail]))
                yield span_batch(docs, hashes, *[np.concatenate(x) for x in zip(*hit)], unit.length)

    return found.repartition(partitions(found.sparkSession), "part").mapInArrow(run, SPANS)


def span_batch(docs, hashes, row, first, last, length) -> pa.RecordBatch:
    """One row per document with its spans ``[start, end)`` as pairs."""
    order = np.lexsort((row, hashes[row], docs[row]))
    row, pairs = row[order], np.stack([first[order], last[order] + length], axis=1).astype(np.int64)
    d, h = docs[row], hashes[row]
    new = np.ones(len(row), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    cuts = np.append(np.flatnonzero(new), len(row)).tolist()
    spans = [pairs[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(d[new]), pa.array(h[new]), pa.array(spans, pa.binary())], [*KEY, "spans"])


class Spool:
    """Rows of ``SEGMENTS`` on the task's disk, one file per shard and column."""

    FIELDS = [("docs", np.int64), ("hashes", np.int64), ("row", np.uint32), ("start", np.int64), ("units", np.uint32), ("size", np.uint32), ("content", np.uint8)]

    def __enter__(self):
        self.folder = tempfile.TemporaryDirectory(prefix="spool-")
        self.count: dict[int, int] = {}
        self.pending: dict[int, list] = {}
        self.held = 0
        return self

    def __exit__(self, *_):
        self.folder.cleanup()

    def add(self, row: dict) -> None:
        part = row["part"]
        base = self.count.get(part, 0)
        self.count[part] = base + len(row["docs"]) // 8
        row["row"] = (np.frombuffer(row["row"], np.uint32) + np.uint32(base)).tobytes()
        self.pending.setdefault(part, []).append(row)
        self.held += sum(len(row[name]) for name, _ in self.FIELDS)
        if self.held > 64 << 20:
            self.flush()

    def flush(self) -> None:
        for part, rows in self.pending.items():
            for name, _ in self.FIELDS:
                with open(f"{self.folder.name}/{part}-{name}", "ab") as f:
                    f.writelines(r[name] for r in rows)
        self.pending, self.held = {}, 0

    def shards(self):
        self.flush()
        for part in list(self.count):
            yield [self._read(part, name, kind) for name, kind in self.FIELDS]

    def _read(self, part, name, kind):
        path = f"{self.folder.name}/{part}-{name}"
        if not os.path.getsize(path):
            return np.zeros(0, kind)
        return np.memmap(path, kind, "r")


def spans_by_document(spans: DataFrame) -> DataFrame:
    return spans.groupBy(*KEY).agg(F.collect_list("spans").alias("spans"))


def covered(n: int, spans: list[bytes] | None) -> np.ndarray:
    """Mask of the units that lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or []:
        pairs = np.frombuffer(s, np.int64).reshape(-1, 2)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 1], -1)
    return np.cumsum(edge)[:n] > 0
