"""Byte-level BPE encoding and decoding through a pair occurrence index.

The pieces of a partition that were not met before lie behind one another in one symbol list. An index
maps every mergeable pair to all its positions; ranks that have positions wait in a heap and are applied
in ascending order, each to its whole position list, and every merge adds its two new pairs to their lists.

Rows: a null text is empty and gives no ids; an empty text likewise; rows without doc_id are left out;
repeated rows are encoded each. Other columns are ignored. Tables of the vocabulary are read on the workers
from ``path`` and kept per process; the piece table is emptied when it reaches ``PIECES`` entries, which
changes no result.
"""

import hashlib
import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fleetlag.llm.texts import keyed

PIECES = 400_000
#: Fixed value: the published pattern that cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_VOCABULARY: dict[str, "Vocabulary"] = {}


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """Ids, merges and special tokens of a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in letters.items()}
        self.byte_id = np.array([ids[letters[b]] for b in range(256)], np.int64)
        self.bytes = {i: bytes(of_letter[c] for c in token) for token, i in ids.items()}
        self.size = max(max(ids.values()), *(t["id"] for t in spec["added_tokens"]), 0) + 1
        self.spread = self.size + 1
        merge = {}  # (left, right) as one number -> rank
        self.made, self.parts = [], []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            merge.setdefault(ids[left] * self.spread + ids[right], rank)
            self.made.append(ids[left + right])
            self.parts.append((ids[left], ids[right]))
        keys = np.array(list(merge), np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(list(merge.values()), np.int64)[order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: content.encode() for content, i in self.special.items()}
        self.cut_special = (
            regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
            if self.special
            else None
        )
        self.pieces: dict[str | int, tuple] = {i: (i,) for i in self.special.values()}
        self.cut = regex.compile(PATTERN)

    def _rank(self, pair: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where it has none."""
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], -1)

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces together and keep their ids."""
        raw = np.frombuffer("\0".join(pieces).encode() + b"\0", np.uint8)
        lengths = np.array([len(p.encode()) for p in pieces])
        fence = np.cumsum(lengths + 1) - 1  # a symbol without pairs ends every piece
        symbol = self.byte_id[raw]
        symbol[fence] = self.size
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list] = {}  # rank -> arrays of the positions of its pair
        active: list[int] = []

        def add(pair, where):
            rank = self._rank(pair)
            hit = np.flatnonzero(rank >= 0)
            if not len(hit):
                return
            rank, where = rank[hit], where[hit]
            if len(hit) > 1:
                order = np.argsort(rank, kind="stable")
                rank, where = rank[order], where[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                r = int(rank[a])
                if r in index:
                    index[r].append(where[a:b])
                else:
                    index[r] = [where[a:b]]
                    heapq.heappush(active, r)

        if len(self.keys):
            add(symbol[:-1] * self.spread + symbol[1:], np.arange(n - 1))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            left, right = self.parts[rank]
            following = after[at]
            ok = (symbol[at] == left) & (symbol[following] == right)  # else a part was merged meanwhile
            if not ok.all():
                at, following = at[ok], following[ok]
            if left == right and len(at) > 1 and (following[:-1] == at[1:]).any():
                keep, taken = np.ones(len(at), bool), -1
                for i, (p, q) in enumerate(zip(at.tolist(), following.tolist())):
                    keep[i] = p != taken
                    taken = q if keep[i] else -1
                at, following = at[keep], following[keep]
            if not len(at):
                continue
            symbol[at] = self.made[rank]
            symbol[following] = -1
            beyond = after[following]
            after[at] = beyond
            before[beyond] = at
            back = before[at]
            add(
                np.concatenate([symbol[at] * self.spread + symbol[beyond], symbol[back] * self.spread + symbol[at]]),
                np.concatenate([at, back]),
            )
        live = np.flatnonzero(symbol >= 0)
        values = symbol[live].tolist()
        ends = np.searchsorted(live, fence).tolist()
        start = 0
        for piece, end in zip(pieces, ends):
            self.pieces[piece] = tuple(values[start:end])
            start = end + 1

    def cut_text(self, text: str) -> list:
        """Pieces of a text; special tokens come as their ids."""
        if self.cut_special is None or not any(s in text for s in self.special):
            return self.cut.findall(text)
        out = []
        for part in self.cut_special.split(text):
            out += [self.special[part]] if part in self.special else self.cut.findall(part)
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        cut = [self.cut_text(text) for text in texts]
        if len(self.pieces) > PIECES:
            self.pieces.clear()
            self.pieces.update((i, (i,)) for i in self.special.values())
        known = self.pieces
        new = set().union(*cut).difference(known)
        if new:
            self.learn(list(new))
        return [list(chain.from_iterable(map(known.__getitem__, pieces))) for pieces in cut]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARY:
        _VOCABULARY[path] = Vocabulary(path)
    return _VOCABULARY[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row."""

    def run(batches):
        voc = vocabulary(path)
        for b in batches:
            ids = voc.encode_all(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return keyed(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` from ``doc_id`` and ``ids``; null ids give an empty text."""

    def run(batches):
        voc = vocabulary(path)
        for b in batches:
            text = [voc.decode(i or []) for i in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass over the texts; counts and digests leave the task, and ``ids`` on request."""

    def run(batches):
        voc = vocabulary(path)
        shown = list(map(str, range(voc.size)))
        for b in batches:
            ids = voc.encode_all(b["text"].to_pylist())
            sha = [hashlib.sha256(",".join(map(shown.__getitem__, x)).encode()).hexdigest() for x in ids]
            back = [hashlib.sha256(voc.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([len(x) for x in ids], pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                + [pa.array(ids, pa.list_(pa.int32()))] * with_ids,
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids,
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return keyed(docs).mapInArrow(run, schema)
