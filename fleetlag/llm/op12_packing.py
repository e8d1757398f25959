"""Packing documents into token windows by the sum-of-squares rule.

``level[h]`` counts the open windows that hold ``h`` tokens. A document goes where the sum of ``level[h] ** 2`` over the
partially filled windows becomes smallest: into a window of some level, or into a new one. The rule keeps the open
windows spread over many levels, so that a later document finds one that it fills.

* A document of more than ``size`` tokens first fills windows of its own; its rest is placed by the rule.
* Beyond ``OPEN`` open windows in a task, and for what is still open at its end, windows are drained: their pieces are
  laid behind one another and cut every ``size`` tokens. A rest at the end of a task is cut at powers of two, which are
  not padded, so that no window needs padding. Windows that stand at a power of two at the end are closed as they are.
* Each task packs the documents it reads: no shuffle, one pass, and at most ``OPEN`` windows in memory. A task is
  repeated as a whole, so its sequences are those of one attempt. ``sequence_id`` has the task in its upper bits.

Rows: a null or empty text is its end id alone; repeated rows are packed each; rows without doc_id are left out; other
columns are ignored; an empty table gives no rows; a text of any length is encoded whole.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag.llm.encoders import byte_bpe
from fleetlag.llm.texts import keyed

SIZE = 2048
END = 1
OPEN = 4096

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: A piece in memory: document, place of its first id there, ids, ids of the whole document.
Piece = tuple[int, int, np.ndarray, int]


class Packer:
    """Open windows of one task; every method returns the windows that it closes, as lists of pieces."""

    def __init__(self, size: int = SIZE, bound: int = OPEN):
        self.size, self.bound = size, bound
        self.level = np.zeros(size + 1, np.int64)
        self.windows: dict[int, list[list[Piece]]] = {}
        self.open = 0

    def choose(self, n: int) -> int:
        """The level to which ``n`` tokens go; 0 is a new window. Ties go to the fuller one."""
        room = self.size - n
        # moving a window from h to h + n changes the sum by (2 level[h+n] + 1) - (2 level[h] - 1)
        change = 2 * (self.level[n:] - self.level[: room + 1]) + 2
        change[0] -= 1  # a new window leaves no level
        change[room] -= 1  # a full window enters none
        change[1:][self.level[1 : room + 1] == 0] = np.iinfo(np.int64).max
        return room - int(np.argmin(change[::-1]))

    def _push(self, h: int, window: list[Piece]) -> None:
        self.windows.setdefault(h, []).append(window)
        self.level[h] += 1
        self.open += 1

    def _pop(self, h: int) -> list[Piece]:
        self.level[h] -= 1
        self.open -= 1
        return self.windows[h].pop()

    def add(self, doc_id: int, ids: np.ndarray) -> Iterator[list[Piece]]:
        total, start = len(ids), 0
        while total - start >= self.size:
            yield [(doc_id, start, ids[start : start + self.size], total)]
            start += self.size
        n = total - start
        if not n:
            return
        h = self.choose(n)
        window = self._pop(h) if h else []
        window.append((doc_id, start, ids[start:].copy(), total))
        if h + n == self.size:
            yield window
            return
        self._push(h + n, window)
        if self.open > self.bound:
            order = np.argsort(-self.level, kind="stable")  # the most windows of equal level first, an eighth together
            many = int(np.searchsorted(np.cumsum(self.level[order]), max(2, self.bound // 8))) + 1
            yield from self._drain(order[:many].tolist(), False)

    def _drain(self, levels: list[int], last: bool) -> Iterator[list[Piece]]:
        window, held = [], 0
        for h in levels:
            for _ in range(int(self.level[h])):
                for doc_id, start, ids, total in self._pop(h):
                    while len(ids):
                        cut = min(len(ids), self.size - held)
                        window.append((doc_id, start, ids[:cut], total))
                        held, start, ids = held + cut, start + cut, ids[cut:]
                        if held == self.size:
                            yield window
                            window, held = [], 0
        if held and last:
            yield from self._at_powers(window, held)
        elif held:
            self._push(held, window)

    def _at_powers(self, window: list[Piece], held: int) -> Iterator[list[Piece]]:
        parts = [1 << b for b in reversed(range(held.bit_length())) if held >> b & 1]
        part, left = [], parts.pop(0)
        for doc_id, start, ids, total in window:
            while len(ids):
                cut = min(len(ids), left)
                part.append((doc_id, start, ids[:cut], total))
                left, start, ids = left - cut, start + cut, ids[cut:]
                if not left:
                    yield part
                    part, left = [], parts.pop(0) if parts else 0

    def close(self) -> Iterator[list[Piece]]:
        """Everything that is still open, without padding."""
        rest = []
        for h in np.flatnonzero(self.level).tolist():
            if h & (h - 1):
                rest.append(h)
            else:
                while self.level[h]:
                    yield self._pop(h)
        yield from self._drain(rest, True)


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and ``ids`` on request."""

    def run(batches):
        encoder, packer = byte_bpe(path), Packer(size, OPEN)
        number = TaskContext.get().partitionId() << 33

        def rows(windows):
            nonlocal number
            out, kept = [], []
            for window in windows:
                offset = 0
                for doc_id, start, ids, total in window:
                    raw = np.ascontiguousarray(ids, "<u4")
                    out.append((doc_id, start, len(raw), zlib.crc32(raw), total, number, offset))
                    if with_ids:
                        kept.append(raw.astype(np.int32))
                    offset += len(raw)
                number += 1
            columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            closed = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                closed += packer.add(doc_id, np.array([*encoder.encode(text), end], "<u4"))
            yield rows(closed)
        yield rows(packer.close())

    return keyed(docs).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def padding(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """One row: sequences, tokens and padded tokens."""
    held = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    padded = F.when(F.expr("n & (n - 1)") == 0, 0).otherwise(size - F.col("n"))
    return held.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(padded).alias("padded"))
