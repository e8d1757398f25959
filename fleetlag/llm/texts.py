"""Shared helpers: whole texts as Arrow bytes, words, rolling fingerprints, fold numbers."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlag.session import cut_lineage

#: Rows of one Arrow batch and bytes of one numpy step; they bound a task's memory.
BATCH_ROWS = 1000
STEP_BYTES = 2 << 20

ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_RNG = np.random.default_rng(20240607)
#: Symbol values and base of the rolling fingerprint.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def bounded_batches(spark: SparkSession) -> None:
    """Session settings of the operators: small Arrow batches, and shuffle files that go when their job has ended.

    Else shuffle files stay until the driver collects its garbage, and those of all steps lie on disk together."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf}/documents.parquet").select(*(columns or ("doc_id", "text")))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of the rows that have a doc_id; a null text is empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).where("doc_id IS NOT NULL")


def fold(modulus: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null rows are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def rows_bytes(column: pa.Array) -> list[bytes]:
    data, offsets = utf8(column)
    view = memoryview(data)
    return [bytes(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def steps(lengths, limit: int = STEP_BYTES):
    """Ranges of rows of at most ``limit`` together; a longer row stands alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_TABLES = {"n": 0}


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Rolling sums of symbol values: ``span`` turns them into fingerprints of any span."""
    n = len(values) + 1
    if _TABLES["n"] < n:
        size = max(n, 1 << 16)
        _TABLES.update(n=size, up=_powers(size, BASE), down=_powers(size, BASE_INVERSE))
    out = np.zeros(n, np.uint64)
    np.cumsum(values * _TABLES["up"][: n - 1], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the spans ``[start, end)``: equal for equal content anywhere."""
    return mixed((sums[end] - sums[start]) * _TABLES["down"][start] + (end - start).astype(np.uint64) * BASE)


def byte_sums(data: np.ndarray) -> np.ndarray:
    return prefix_sums(BYTE_VALUE[data])


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every white-space word, and the first word of each row (rows + 1)."""
    word = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def row_key(docs: DataFrame) -> DataFrame:
    """``keyed`` with ``text_hash``: 0 for an id of one row, else the text's hash, which tells rows of one id apart.

    Ids are unique as a rule, and a constant costs nothing where keys travel; the repeated ids are broadcast only if
    they are few."""
    rows = keyed(docs)
    again = cut_lineage(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    many = again.count()
    if not many:
        return rows.withColumn("text_hash", F.lit(0).cast("long"))
    again = again.withColumn("again", F.lit(True))
    met = rows.join(F.broadcast(again) if many < 500_000 else again, "doc_id", "left")
    return met.withColumn("text_hash", F.when(F.col("again"), F.xxhash64("text")).otherwise(0)).drop("again")


def first_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash`` of one row of every distinct text: that of the smallest id."""
    kept = docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    return kept.select("k.doc_id", "k.text_hash")


def part_count(spark: SparkSession) -> int:
    """Parts of a packed exchange: they follow the cluster's shuffle partitions."""
    return 2 * partitions(spark)
