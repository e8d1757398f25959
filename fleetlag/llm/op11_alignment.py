"""Alignment of two tokenizers over a corpus, with external spill counting of their token pairs.

Tokenizer A sees a space and the text, B sees the text and adds the space itself, so both cut the same bytes. Byte
offsets where a token of A and a token of B both end cut the tokens into groups; an A and a B token whose bytes overlap
are a link. A pair of ids counts the documents that hold it linked.

1. A task aligns a batch of documents and writes, for each radix part of the A id, one run: its pair-document records in
   the order A id, B id, document, as zstd columns. Runs hold a pair once with its number of documents in the batch.
2. The runs of a part are merged by a heap over the last keys of their current chunks, first those of one task, then
   those of all tasks, so a part reads one summed run of each task. A id first, B id second is the order of the merged
   keys, so an A id's pairs lie together and its highest count is known as soon as its last pair has passed.
3. The records of step 1 stream past the counts of their part again and give each document of a batch its sum of counts
   and its number of links to a best pair. The runs of a part are dealt over tasks of at most ``RUNS``, so the documents
   of a frequent A id are never in one task; a task holds one part's counts and one run.
4. The contributions of a batch meet its documents.

All sizes that a task holds are bounded by the batch or by the distinct pairs of a part, never by documents of an id.

Rows: texts that are null, empty, or not given back byte for byte by both tokenizers have no tokens: zeros, and an empty
``groups_sha256``; repeated rows count as documents each; rows without doc_id are left out; other columns are ignored; an
empty table gives no rows; a text of any length is aligned whole. Strings of special tokens are ordinary text.
"""

import hashlib
import heapq

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag.llm.encoders import byte_bpe, pieces
from fleetlag.llm.op13_phrases import from_planes, planes
from fleetlag.llm.texts import keyed, partitions, steps
from fleetlag.session import cut_lineage

RADIX = 256
RUNS = 512
CHUNK = 1 << 14
BATCH_BYTES = 4 << 20
WIDE = 1 << 32  # a pair of ids as one number: A id * WIDE + B id

RECORDS = "kind int, part int, batch long, keys binary, docs_of binary, docs binary, times binary"
DOCUMENTS, RUN = 0, 1
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def press(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(planes(values))


def unpress(data: bytes, kind) -> np.ndarray:
    return from_planes(zstandard.ZstdDecompressor().decompress(data), kind)


class Speller:
    """Writes the groups of a document: every token with the sign that follows it."""

    def __init__(self, a: int, b: int):
        self.a, self.wide = a, a + b
        ids = [str(i) for i in range(max(a, b))]
        self.text = [s + "," for s in ids[:a]] + [s + "," for s in ids[:b]] + [s + "|" for s in ids[:a]] + [s + ";" for s in ids[:b]]

    def codes(self, ids_a, ids_b, last_a, last_b) -> np.ndarray:
        """Tokens of both sides in the order of the groups, A before B; ``last`` marks the last token of a group."""
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        groups = int(last_a.sum())
        upto_a = np.cumsum(np.bincount(group_a, minlength=groups))
        before_b = np.cumsum(np.bincount(group_b, minlength=groups)) - np.bincount(group_b, minlength=groups)
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        out[np.arange(len(ids_a)) + before_b[group_a]] = ids_a + last_a * self.wide
        out[np.arange(len(ids_b)) + upto_a[group_b]] = self.a + ids_b + last_b * self.wide
        return out

    def digest(self, codes: np.ndarray) -> str:
        text = "".join(map(self.text.__getitem__, codes.tolist()))
        return hashlib.sha256(text[:-1].encode()).hexdigest()


class Aligner:
    """Both tokenizers with the byte lengths of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_bpe(path_a), pieces(path_b)
        self.len_a, self.len_b = (
            np.array([len(t.bytes.get(i, b"")) for i in range(t.size)], np.int64) for t in (self.a, self.b)
        )
        self.speller = Speller(self.a.size, self.b.size)

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both sides, or none if one of them does not give back the bytes."""
        if not text:
            return [], []
        whole = (" " + text).encode()
        a, b = self.a.plain(" " + text), self.b.encode(text)
        if b"".join(map(self.a.bytes.__getitem__, a)) != whole or b"".join(map(self.b.bytes.__getitem__, b)) != whole:
            return [], []
        return a, b

    def align(self, texts: list[str | None]):
        """Figures of every document, and its links as (A id, B id, document) occurrences."""
        both = [self.tokens(t) for t in texts]
        n_a, n_b = (np.array([len(x[k]) for x in both], np.int64) for k in (0, 1))
        ids_a, ids_b = (np.fromiter((i for x in both for i in x[k]), np.int64, int(n.sum())) for k, n in ((0, n_a), (1, n_b)))
        end_a, end_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        ends = np.union1d(end_a, end_b)  # every stretch between two of them lies in one token of each side
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        row_a = np.repeat(np.arange(len(texts)), n_a)
        row = row_a[at_a]
        groups = np.bincount(row_a[last_a], minlength=len(texts))
        links = np.bincount(row, minlength=len(texts))
        codes = self.speller.codes(ids_a, ids_b, last_a, last_b)
        cuts = np.concatenate([[0], np.cumsum(n_a + n_b)])
        digests = [self.speller.digest(codes[x:y]) if y > x else "" for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return (n_a, n_b, groups, links, digests), (ids_a[at_a], ids_b[at_b], row)


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(*paths: str) -> Aligner:
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def radix(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % RADIX


def runs_of(a: np.ndarray, b: np.ndarray, row: np.ndarray, rows: int):
    """``part, keys, documents of each key, documents, occurrences`` of the records of a batch, part by part."""
    pairs, slot = np.unique(a * WIDE + b, return_inverse=True)
    records, times = np.unique(slot * rows + row, return_counts=True)
    slot, doc = records // rows, records % rows
    part = radix(pairs // WIDE)
    order = np.argsort(part[slot], kind="stable")
    slot, doc, times = slot[order], doc[order].astype(np.uint32), times[order].astype(np.uint32)
    cuts = np.searchsorted(part[slot], np.arange(RADIX + 1))
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        x, y = cuts[p], cuts[p + 1]
        first = np.flatnonzero(np.diff(slot[x:y], prepend=-1))
        docs_of = np.diff(np.append(first, y - x))
        yield p, pairs[slot[x:y][first]], docs_of, doc[x:y], times[x:y]


def records(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of ``RECORDS``: the runs of every batch, and its documents as one packed row."""

    def run(batches):
        tool = aligner(path_a, path_b)
        batch = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, texts = b["doc_id"].to_pylist(), b["text"].to_pylist()
            for x, y in steps([len(t) for t in texts], BATCH_BYTES):
                (n_a, n_b, groups, links, digests), (a, bb, row) = tool.align(texts[x:y])
                packed = pa.RecordBatch.from_arrays(
                    [pa.array(ids[x:y], pa.int64()), *map(pa.array, (n_a, n_b, groups, links)), pa.array(digests, pa.string())],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"],
                )
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, packed.schema) as writer:
                    writer.write_batch(packed)
                rows = [(DOCUMENTS, -1, batch, sink.getvalue().to_pybytes(), b"", b"", b"")]
                for part, keys, docs_of, doc, times in runs_of(a, bb, row, y - x):
                    rows.append((RUN, part, batch, press(keys), press(docs_of), press(doc), press(times)))
                kinds = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 4
                names = [f.split()[0] for f in RECORDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                batch += 1

    return keyed(docs).mapInArrow(run, RECORDS)


def chunks(keys: np.ndarray, counts: np.ndarray):
    return ((keys[i : i + CHUNK], counts[i : i + CHUNK]) for i in range(0, len(keys), CHUNK))


def merged(runs: list[tuple[bytes, bytes]]):
    """K-way merge of sorted runs of keys and counts, chunk by chunk: ascending keys with their sums.

    A heap holds the last key of each run's current chunk. Up to the smallest of them every run's keys are at hand, so
    that stretch is summed and passed on, and the run that ended it takes its next chunk."""
    readers = [chunks(unpress(keys, np.int64), unpress(counts, np.int64)) for keys, counts in runs]
    current = {i: next(r) for i, r in enumerate(readers)}
    heap = [(int(k[-1]), i) for i, (k, _) in current.items()]
    heapq.heapify(heap)
    while heap:
        limit = heap[0][0]
        keys, counts = [], []
        for i, (k, c) in current.items():
            cut = int(np.searchsorted(k, limit, "right"))
            if cut:
                keys.append(k[:cut])
                counts.append(c[:cut])
                current[i] = (k[cut:], c[cut:])
        while heap and heap[0][0] == limit:
            i = heapq.heappop(heap)[1]
            after = next(readers[i], None)
            if after is None:
                del current[i]
            else:
                current[i] = after
                heapq.heappush(heap, (int(after[0][-1]), i))
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, back, np.concatenate(counts))
        yield key, total


def best_of(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each pair has the highest count of its A id; keys ascend, so an A id's pairs lie together."""
    first = np.flatnonzero(np.diff(keys // WIDE, prepend=-1))
    highest = np.maximum.reduceat(counts, first)
    return counts == np.repeat(highest, np.diff(np.append(first, len(keys))))


def by_part(batches, emit):
    """Rows that lie part by part, handed on as ``emit(part, rows)``."""
    part, held = None, []
    for b in batches:
        for p, keys, counts in zip(*[b[c].to_pylist() for c in ("part", "keys", "counts")]):
            if p != part and held:
                yield emit(part, held)
                held = []
            part = p
            held.append((keys, counts))
    if held:
        yield emit(part, held)


def counted(runs: DataFrame) -> DataFrame:
    """``part, keys, counts, best``: one row for each part, its pairs with their documents in the whole corpus."""

    def summed(rows):
        found = list(merged(rows))
        return np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found])

    def one_task(batches):
        def emit(part, rows):
            keys, counts = summed(rows)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "keys": [press(keys)], "counts": [press(counts)]})

        return by_part(batches, emit)

    def all_tasks(batches):
        def emit(part, rows):
            keys, counts = summed(rows)
            best = best_of(keys, counts).astype(np.uint8)
            columns = {"part": pa.array([part], pa.int32()), "keys": [press(keys)], "counts": [press(counts)], "best": [press(best)]}
            return pa.RecordBatch.from_pydict(columns)

        return by_part(batches, emit)

    schema = "part int, keys binary, counts binary"
    each = runs.select("part", "keys", F.col("docs_of").alias("counts")).sortWithinPartitions("part").mapInArrow(one_task, schema)
    whole = each.repartition(partitions(runs.sparkSession), "part").sortWithinPartitions("part")
    return whole.mapInArrow(all_tasks, schema + ", best binary")


def contributions(runs: DataFrame, totals: DataFrame, salts: int) -> DataFrame:
    """``batch, sums, best``: what the pairs of one run add to the documents of its batch."""

    def run(batches):
        held = None
        for b in batches:
            out = ([], [], [])
            names = ("kind", "batch", "keys", "docs_of", "docs", "times")
            for kind, batch, keys, docs_of, docs, times in zip(*[b[c].to_pylist() for c in names]):
                if kind == 0:
                    held = unpress(keys, np.int64), unpress(docs_of, np.int64), unpress(docs, np.uint8)
                    continue
                at = np.repeat(np.searchsorted(held[0], unpress(keys, np.int64)), unpress(docs_of, np.int64))
                doc, times = unpress(docs, np.uint32), unpress(times, np.uint32).astype(np.int64)
                sums = np.zeros((2, int(doc.max()) + 1), np.int64)
                np.add.at(sums[0], doc, held[1][at] * times)
                np.add.at(sums[1], doc, held[2][at] * times)
                for column, value in zip(out, (batch, press(sums[0]), press(sums[1]))):
                    column.append(value)
            kinds = [pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["batch", "sums", "best"])

    names = ["kind", "part", "salt", "batch", "keys", "docs_of", "docs", "times"]
    known = totals.select(
        F.lit(0).alias("kind"), "part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(-1).cast("long").alias("batch"),
        "keys", F.col("counts").alias("docs_of"), F.col("best").alias("docs"), F.lit(b"").alias("times"),
    )
    asked = runs.withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int")).select(names)
    dealt = known.union(asked).repartition(partitions(runs.sparkSession), "part", "salt")
    return dealt.sortWithinPartitions("part", "salt", "kind").mapInArrow(run, "batch long, sums binary, best binary")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    found = cut_lineage(records(docs, path_a, path_b))
    runs = found.where(F.col("kind") == RUN)
    totals = cut_lineage(counted(runs))
    batches = found.where(F.col("kind") == DOCUMENTS)
    salts = max(1, -(-batches.count() // RUNS))
    added = contributions(runs, totals, salts).select(F.lit(1).alias("kind"), "batch", "sums", "best")
    whole = batches.select("kind", "batch", F.col("keys").alias("sums"), F.lit(b"").alias("best")).union(added)

    def run(rows):
        now, sums = None, None

        def result():
            columns = [*now.columns[:5], pa.array(sums[1]), pa.array(sums[0]), now.columns[5]]
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in RESULT.split(", ")])

        for b in rows:
            for kind, s, best in zip(*[b[c].to_pylist() for c in ("kind", "sums", "best")]):
                if kind == DOCUMENTS:
                    if now is not None:
                        yield result()
                    now = pa.ipc.open_stream(s).read_next_batch()
                    sums = np.zeros((2, len(now)), np.int64)
                else:
                    for line, value in zip(sums, (s, best)):
                        value = unpress(value, np.int64)
                        line[: len(value)] += value
        if now is not None:
            yield result()

    placed = whole.repartition(partitions(docs.sparkSession), "batch").sortWithinPartitions("batch", "kind")
    return placed.mapInArrow(run, RESULT)


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``a, b, documents, best``: every linked pair of ids, as a mapping from one vocabulary to the other."""
    totals = counted(cut_lineage(records(docs, path_a, path_b)).where(F.col("kind") == RUN))

    def run(batches):
        for b in batches:
            for keys, counts, best in zip(*[b[c].to_pylist() for c in ("keys", "counts", "best")]):
                keys = unpress(keys, np.int64)
                columns = [keys // WIDE, keys % WIDE, unpress(counts, np.int64), unpress(best, np.uint8).astype(bool)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "documents", "best"])

    return totals.mapInArrow(run, "a long, b long, documents long, best boolean")
