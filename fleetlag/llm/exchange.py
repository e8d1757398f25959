"""Asking, for every key of every document, how widely the corpus holds it.

A document's keys (64-bit fingerprints of shingles, grams ...) are dealt by value over ``parts`` parts. A map step
packs the keys of its documents for one part into one row, five bytes a key; within a part that leaves one chance in
10^12 that two keys are mixed up, at any corpus size, as parts grow in number and not in size. The part counts its
keys and answers with one byte a key, so keys themselves never travel back: the document repeats its key list.
Answers travel packed too, a row for every part and block of documents, and a block hands them to its documents: the
rows between parts and documents follow neither the documents times the parts nor the keys.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetlag.llm.texts import mixed, part_count

PACKED = "part int, docs binary, hashes binary, counts binary, keys binary"
ANSWERED = "block int, part int, docs binary, hashes binary, counts binary, flags binary"
FLAGS = "doc_id long, text_hash long, held long, flags array<struct<part: int, flags: binary>>"


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def part_order(part: np.ndarray, parts: int) -> np.ndarray:
    """The stable order by part; two bytes a part are sorted by digits, several times as fast."""
    return np.argsort(part.astype(np.uint16) if parts <= 2**16 else part, kind="stable")


def packed(doc_ids, hashes, counts, keys, parts: int) -> pa.RecordBatch:
    """Rows of ``PACKED`` from documents whose keys lie behind one another (``counts`` keys each)."""
    row = np.repeat(np.arange(len(counts)), counts)
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")  # documents stay in order within a part
    part, row = part[order], row[order]
    low = np.ascontiguousarray(keys[order]).view(np.uint8).reshape(-1, 8)[:, :5]
    cuts = np.searchsorted(part, np.arange(parts + 1))
    out = ([], [], [], [], [])
    for p in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[p], cuts[p + 1]
        new = np.flatnonzero(np.diff(row[a:b], prepend=-1))
        rows = row[a:b][new]
        held = np.diff(np.append(new, b - a)).astype(np.uint32)
        for column, value in zip(out, (int(p), doc_ids[rows].tobytes(), hashes[rows].tobytes(), held.tobytes(), low[a:b].tobytes())):
            column.append(value)
    kinds = [pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["part", "docs", "hashes", "counts", "keys"])


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def answers(asked: DataFrame, answer: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``ANSWERED`` rows. ``answer(keys, doc_ids, rows)`` gives one byte for each key; all-zero rows are left out."""
    blocks = part_count(asked.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        docs, hashes = _joined(table, "docs", np.int64), _joined(table, "hashes", np.int64)
        counts = _joined(table, "counts", np.uint32).astype(np.int64)
        low = _joined(table, "keys", np.uint8).reshape(-1, 5)
        keys = np.zeros((len(low), 8), np.uint8)
        keys[:, :5] = low
        keys = keys.view(np.uint64).ravel()
        rows = np.repeat(np.arange(len(counts)), counts)
        flags = answer(keys, docs[rows], rows).astype(np.uint8)
        starts = np.cumsum(counts) - counts
        held = np.add.reduceat((flags > 0).astype(np.int64), starts) if len(starts) else starts
        live = np.flatnonzero(held)
        block = part_of(mixed(docs[live].view(np.uint64) ^ hashes[live].view(np.uint64)), blocks)
        order = np.argsort(block, kind="stable")
        live, cuts = live[order], np.searchsorted(block[order], np.arange(blocks + 1))
        met = np.flatnonzero(np.diff(cuts)).tolist()
        many = counts[live]
        ends = np.concatenate([[0], np.cumsum(many)])
        told = flags[np.arange(ends[-1]) + np.repeat(starts[live] - ends[:-1], many)]
        cut = lambda x: pa.array([x[live[cuts[b] : cuts[b + 1]]].tobytes() for b in met], pa.binary())
        part = table["part"][0].as_py()
        return pa.table(
            {
                "block": pa.array(met, pa.int32()),
                "part": pa.array([part] * len(met), pa.int32()),
                "docs": cut(docs),
                "hashes": cut(hashes),
                "counts": cut(counts.astype(np.uint32)),
                "flags": pa.array([told[ends[cuts[b]] : ends[cuts[b + 1]]].tobytes() for b in met], pa.binary()),
            }
        )

    return asked.groupBy("part").applyInArrow(run, ANSWERED)


def by_document(answered: DataFrame) -> DataFrame:
    """``FLAGS``: the answered parts of each document in one row; ``held`` keys have a flag."""

    def run(table: pa.Table) -> pa.Table:
        docs, hashes = _joined(table, "docs", np.int64), _joined(table, "hashes", np.int64)
        counts = _joined(table, "counts", np.uint32).astype(np.int64)
        flags = _joined(table, "flags", np.uint8)
        part = np.repeat(table["part"].to_numpy(), [len(d) // 8 for d in table["docs"].to_pylist()]).astype(np.int32)
        order = np.lexsort((part, hashes, docs))
        doc, hash_ = docs[order], hashes[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (hash_[1:] != hash_[:-1])
        first = np.flatnonzero(new)
        ends = np.concatenate([[0], np.cumsum(counts)])
        held = np.add.reduceat((flags > 0).astype(np.int64), ends[:-1])
        told = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flags)])
        parts = pa.StructArray.from_arrays([pa.array(part[order]), told.take(pa.array(order))], ["part", "flags"])
        return pa.table(
            {
                "doc_id": pa.array(doc[first]),
                "text_hash": pa.array(hash_[first]),
                "held": pa.array(np.add.reduceat(held[order], first)),
                "flags": pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), parts),
            }
        )

    return answered.groupBy("block").applyInArrow(run, FLAGS)


def unpacked(keys: np.ndarray, parts: int, flags: list[dict] | None) -> np.ndarray:
    """The flag of every key of one document, in the order of ``keys``."""
    out = np.zeros(len(keys), np.uint8)
    if flags:
        part = part_of(keys, parts)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        for f in flags:
            out[order[cuts[f["part"]] : cuts[f["part"] + 1]]] = np.frombuffer(f["flags"], np.uint8)
    return out


def group_sizes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, group number of each position in that order, and group starts."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return order, np.cumsum(new) - 1, np.flatnonzero(new)
