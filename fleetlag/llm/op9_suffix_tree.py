"""Language-model scoring with a probabilistic suffix tree over words.

Contexts are word sequences of length 0 to ``DEPTH``. Every sequence with ``LEAST`` occurrences in the training rows
enters the tree, at any corpus size. A context stays only if the divergence of its next words from those of its
longest shorter context, times its count, reaches ``TEST`` nats. Its distribution takes ``DISCOUNT`` from every kept
count and gives the rest to the shorter context; the root is ``(c + 1) / (N + V + 1)``. A token is scored in the
longest context kept for the words before it.

Counting: words and sequences are fingerprinted, counted per block and summed per part,
longer sequences over those that pass the shorter ones' ``sieve_of``. The tree is a table with a row
for every sequence; all parts of a sequence are at least as frequent as it, so its context and its suffix are rows too
and are met by joins, the sums of a context by aggregates that combine before the shuffle.

Scoring: the log probability of a token is a sum over the sequences that end at it, the shorter ones also as contexts
(``values``), so a document's score is the sum of its sequences' values. The frequent part, sequences that make up
``SHARE`` of all training tokens and so at most ``1 / SHARE`` of a length, is broadcast and settled where it stands.
All others, none of them hot, are looked up in their part of the tree and the vocabulary: a batch asks with the
fingerprints and gets one sum per document and part.

Rows: null and empty texts have the end token only; rows without doc_id are left out; repeated rows are counted and
scored each; with no training rows N is 0 and every token has the root's probability. Other columns are ignored.
"""

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag.llm.exchange import part_of, part_order
from fleetlag.llm.texts import BASE, ascii_lower, byte_sums, fold, keyed, mixed, part_count, span, steps, utf8, word_spans
from fleetlag.session import cut_lineage, discard

FOLDS, HELD_OUT = 7, 2
DEPTH = 2
LEAST = 2
SHARE = 2e-6
TEST = 10.0
DISCOUNT = 0.5
END = np.uint64(1)
COUNTS = "part int, keys binary, counts binary"
SEQUENCES = "part int, contexts binary, suffixes binary, counts binary"
SEQUENCE_COLUMNS = ["part", "contexts", "suffixes", "counts"]
BLOCK = 1 << 20  # sequences that are counted together
SIEVE = 28
LOW = np.uint64(2**40 - 1)
ASKED = np.uint64(2**48 - 1)  # six bytes of a fingerprint go to its part


def token_keys(column: pa.Array):
    """Steps of rows: ``(first row, last row, keys, row of each token)``; every row ends with END."""
    data, offsets = utf8(column)
    for a, b in steps(np.diff(offsets).tolist()):
        part = ascii_lower(data[offsets[a] : offsets[b]])
        starts, ends, first = word_spans(part, offsets[a : b + 1] - offsets[a])
        words = np.diff(first)
        row = np.repeat(np.arange(b - a), words + 1)
        keys = np.full(len(row), END, np.uint64)
        last = np.zeros(len(row), bool)
        last[np.cumsum(words + 1) - 1] = True
        word = span(byte_sums(part), starts, ends)
        keys[~last] = np.where(word == END, END + np.uint64(1), word)
        yield a, b, keys, row


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    if not len(k):
        return k, c
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[start], np.add.reduceat(c, start)


def count_batch(keys, counts, parts: int) -> pa.RecordBatch:
    k, c = merged(keys, counts)
    part = part_of(k, parts)
    order = part_order(part, parts)
    part, k, c = part[order], k[order], c[order]
    cuts = np.searchsorted(part, np.arange(parts + 1))
    live = np.flatnonzero(np.diff(cuts)).tolist()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(live, pa.int32()),
            pa.array([k[cuts[p] : cuts[p + 1]].tobytes() for p in live], pa.binary()),
            pa.array([c[cuts[p] : cuts[p + 1]].astype(np.int64).tobytes() for p in live], pa.binary()),
        ],
        ["part", "keys", "counts"],
    )


def _arrays(table, key_kind=np.uint64):
    return (
        [np.frombuffer(x, key_kind) for x in table["keys"].to_pylist()],
        [np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()],
    )


def _valued(table) -> tuple[np.ndarray, np.ndarray]:
    """Of a part that ``dealt`` packed: what is asked of the keys, ascending, and their values."""
    keys = np.concatenate([np.zeros(0, np.uint64), *[_wide(x) for x in table["keys"].to_pylist()]])
    return keys, np.concatenate([np.zeros(0), *[np.frombuffer(x) for x in table["counts"].to_pylist()]])


def summed(counts: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        k, c = merged(*_arrays(table))
        return pa.table(
            {"part": pa.array([table["part"][0].as_py()], pa.int32()), "keys": pa.array([k.tobytes()], pa.binary()), "counts": pa.array([c.tobytes()], pa.binary())}
        )

    return counts.groupBy("part").applyInArrow(run, COUNTS)


def frequent(table: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of ``COUNTS`` rows with at least ``least`` occurrences, ascending. ``least`` is a share of all tokens,
    which bounds their number."""

    def run(batches):
        for b in batches:
            for keys, counts in zip(*_arrays(b)):
                live = counts >= least
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[live].tobytes()], pa.binary()), pa.array([counts[live].tobytes()], pa.binary())], ["keys", "counts"]
                )

    found = table.select("keys", "counts").mapInArrow(run, "keys binary, counts binary").collect()
    return merged([np.frombuffer(bytes(r["keys"]), np.uint64) for r in found], [np.frombuffer(bytes(r["counts"]), np.int64) for r in found])


def totals(table: DataFrame) -> tuple[int, int]:
    """Tokens and distinct tokens."""

    def run(batches):
        for b in batches:
            keys, counts = _arrays(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(sum(c.sum() for c in counts))]), pa.array([sum(len(k) for k in keys)])], ["n", "v"]
            )

    n, v = table.select("keys", "counts").mapInArrow(run, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return int(n or 0), int(v or 0)


@dataclass
class Tree:
    """The tree's table and its frequent part."""

    words: np.ndarray  # frequent words, ascending
    counts: np.ndarray
    total: int
    distinct: int
    keys: np.ndarray  # frequent sequences and contexts, ascending
    values: np.ndarray
    context: list[np.ndarray]  # per level: frequent contexts that are kept
    table: DataFrame | None  # ``COUNTS`` with the values of all other sequences that have one
    sieve: np.ndarray  # of the table

    def __post_init__(self):
        self.word_index, self.key_index = _index(self.words), _index(self.keys)
        self.logs, self.root = np.log10(self.counts + 1), np.log10((self.counts + 1) / (self.total + self.distinct + 1))


def _index(codes: np.ndarray) -> tuple[np.uint64, np.ndarray]:
    """Where the codes with each value of their leading bits begin; fingerprints share them with few others."""
    bits = min(24, len(codes).bit_length())
    edges = np.searchsorted(codes, np.arange(2**bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1)
    return np.uint64(64 - bits), np.append(edges, len(codes)).astype(np.int32)


def _find(codes: np.ndarray, wanted: np.ndarray, index: tuple[np.uint64, np.ndarray] | None = None) -> np.ndarray:
    """Place of each wanted code, else -1; with an ``index`` of the codes only a few are compared."""
    if not len(codes):
        return np.full(len(wanted), -1, np.int64)
    if index is not None:
        shift, edges = index
        lead = (wanted >> shift).astype(np.int64)
        at, end = edges[lead], edges[lead + 1]
        out, left = np.full(len(wanted), -1, np.int64), np.flatnonzero(at < end)
        at, end, code = at[left], end[left], wanted[left]
        while len(left):
            same = codes[at] == code
            out[left[same]] = at[same]
            on = ~same & (at + 1 < end)
            left, at, end, code = left[on], at[on] + 1, end[on], code[on]
        return out
    at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
    return np.where(codes[at] == wanted, at, -1)


def joined(contexts: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Fingerprints of sequences, from those without the last and without the first word."""
    return mixed(contexts * BASE + suffixes)


def sequences(keys: np.ndarray, row: np.ndarray, sieves: list):
    """``(last token, fingerprint, fingerprint without the last, without the first word)`` of the sequences of each
    length from 2 words on; with a sieve in ``sieves`` longer ones only over what it lets through."""
    before, held = keys, np.ones(len(keys), bool)
    for d, sieve in enumerate(sieves, 1):
        last = np.flatnonzero(held[1:] & held[:-1]) + 1
        last = last[last >= d]
        last = last[row[last - d] == row[last]]
        key = joined(before[last - 1], before[last])
        yield last, key, before[last - 1], before[last]
        ahead, held = np.zeros(len(keys), np.uint64), np.zeros(len(keys), bool)
        ahead[last] = key
        held[last] = True if sieve is None else passed(sieve, key)
        before = ahead


def sieve_of(packed: DataFrame, keys_of, parts: int) -> np.ndarray:
    """A bitmap of ``2**SIEVE`` bits at any size, a slice for every part: what it lets through may be in the table,
    the rest is not. It only saves asking; with a full bitmap everything is asked. ``packed`` has one row a part."""
    width = 2**SIEVE // parts // 8

    def run(batches):
        for b in batches:
            for at, row in zip(b["part"].to_pylist(), b.to_pylist()):
                bits = np.zeros(width * 8, bool)
                bits[(keys_of(row) & LOW) % np.uint64(width * 8)] = True
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["part", "bits"])

    out = np.zeros((parts, width), np.uint8)
    for r in packed.mapInArrow(run, "part int, bits binary").collect():
        out[r["part"]] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def passed(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    parts, width = sieve.shape
    at = (keys & LOW) % np.uint64(width * 8)
    byte = sieve[part_of(keys, parts), (at >> np.uint64(3)).astype(np.int64)]
    return (byte >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0


def _distinct(contexts, suffixes, counts):
    keys = joined(contexts, suffixes)
    order = np.argsort(keys)
    k = keys[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    many = np.add.reduceat(counts[order], start) if len(k) else counts
    return k[start], contexts[order][start], suffixes[order][start], many


def sequence_counts(train: DataFrame, sieves: list) -> DataFrame:
    """Packed ``SEQUENCES`` of one more word than ``sieves`` are for, that have ``LEAST`` occurrences: one row a part."""
    parts = part_count(train.sparkSession)
    shared = train.sparkSession.sparkContext.broadcast(sieves)

    def block(held):
        k, c, s, many = _distinct(*[np.concatenate(x) for x in zip(*held)])
        part = part_of(k, parts)
        order = part_order(part, parts)
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        live = np.flatnonzero(np.diff(cuts)).tolist()
        cut = lambda x: pa.array([x[order[cuts[p] : cuts[p + 1]]].tobytes() for p in live], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), cut(c), cut(s), cut(many.astype(np.int32))], SEQUENCE_COLUMNS)

    def run(batches):
        held, size = [], 0
        for b in batches:
            for _, _, keys, row in token_keys(b["text"]):
                *_, (_, key, contexts, suffixes) = sequences(keys, row, [*shared.value, None])
                held.append((contexts, suffixes, np.ones(len(key), np.int32)))
                size += len(key)
                if size >= BLOCK:
                    yield block(held)
                    held, size = [], 0
        if size:
            yield block(held)

    def total(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])
        _, c, s, many = _distinct(read("contexts", np.uint64), read("suffixes", np.uint64), read("counts", np.int32).astype(np.int64))
        live = many >= LEAST
        return pa.table([pa.array([table["part"][0].as_py()], pa.int32()), *[pa.array([x[live].tobytes()], pa.binary()) for x in (c, s, many)]], SEQUENCE_COLUMNS)

    return train.select("text").mapInArrow(run, SEQUENCES).groupBy("part").applyInArrow(total, SEQUENCES)


def _sequence_keys(row: dict) -> np.ndarray:
    return joined(np.frombuffer(row["contexts"], np.uint64), np.frombuffer(row["suffixes"], np.uint64))


def sequence_rows(packed: DataFrame) -> DataFrame:
    """``key, ctx, suf, c`` of packed sequences."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                columns = [_sequence_keys(row).view(np.int64), *[np.frombuffer(row[n], np.int64) for n in SEQUENCE_COLUMNS[1:]]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "ctx", "suf", "c"])

    return packed.mapInArrow(run, "key long, ctx long, suf long, c long")


def vocabulary_rows(vocabulary: DataFrame, total: int, distinct: int) -> DataFrame:
    """``key, c, gain`` of the words with ``LEAST`` occurrences; gain is the root's log10 probability."""

    def run(batches):
        for b in batches:
            for keys, counts in zip(*_arrays(b, np.int64)):
                live = counts >= LEAST
                gain = np.log10((counts[live] + 1) / (total + distinct + 1))
                yield pa.RecordBatch.from_arrays([pa.array(keys[live]), pa.array(counts[live]), pa.array(gain)], ["key", "c", "gain"])

    return vocabulary.select("keys", "counts").mapInArrow(run, "key long, c long, gain double")


def smoothed(rows: DataFrame, lower: DataFrame, spent: list[str], kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """Divergence tests and probabilities of the sequences of one length; ``lower`` has the next shorter ones.

    Gives ``key, c, gain, delta`` of the sequences: gain is the log10 probability of the last word after the words
    before it, delta what it has beyond the shorter context's; and ``ctx, held, spare`` of the contexts that are kept:
    spare is the log10 of what a context leaves to the shorter one. The tables in ``spent``, which nothing else reads,
    go once the sequences are written; then it lists those, and ``kept`` lists the contexts."""
    sums = rows.groupBy("ctx").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("sc"))
    sums = sums.join(lower.select(F.col("key").alias("ctx"), F.col("c").alias("held")), "ctx")
    rest = F.least(F.greatest(1 - (F.col("sc") - DISCOUNT * F.col("n")) / F.col("held"), F.lit(1e-12)), F.lit(1.0))
    sums = sums.select("ctx", "held", "sc", rest.alias("rest"))
    met = rows.join(lower.select(F.col("key").alias("suf"), F.col("gain").alias("shorter")), "suf").join(sums, "ctx")
    chance = (F.col("c") - DISCOUNT) / F.col("held") + F.col("rest") * F.pow(F.lit(10.0), "shorter")
    met = cut_lineage(met.select("key", "ctx", "c", "shorter", "held", "sc", "rest", F.log10(chance).alias("chance")), written := [])
    discard(rows.sparkSession, spent)
    spent += written
    seen = F.sum(F.col("c") * (F.col("chance") - F.col("shorter"))) * float(np.log(10))
    tested = met.groupBy("ctx").agg(seen.alias("seen"), *[F.max(x).alias(x) for x in ("held", "sc", "rest")])
    tested = tested.where(F.col("seen") + (F.col("held") - F.col("sc")) * F.log("rest") >= TEST)
    contexts = cut_lineage(tested.select("ctx", "held", F.log10("rest").alias("spare")), kept)
    gain = F.when(F.col("spare").isNull(), F.col("shorter")).otherwise(F.col("chance"))
    out = met.join(contexts.select("ctx", "spare"), "ctx", "left").select("key", "c", gain.alias("gain"), "shorter", "spare")
    delta = F.when(F.col("spare").isNull(), F.lit(0.0)).otherwise(F.col("gain") - F.col("shorter") - F.col("spare"))
    return out.select("key", "c", "gain", delta.alias("delta")), contexts


def gathered(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``key, value`` rows on the driver, ascending; for frequent ones only, whose number is bounded."""

    def run(batches):
        for b in batches:
            cut = lambda name: b[name].to_numpy(zero_copy_only=False).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([cut(n)], pa.binary()) for n in ("key", "value")], ["k", "v"])

    found = rows.select("key", "value").mapInArrow(run, "k binary, v binary").collect()
    keys = np.concatenate([np.frombuffer(bytes(r["k"]), np.uint64) for r in found] or [np.zeros(0, np.uint64)])
    values = np.concatenate([np.frombuffer(bytes(r["v"])) for r in found] or [np.zeros(0)])
    order = np.argsort(keys)
    return keys[order], values[order]


def grow(train: DataFrame, vocabulary: DataFrame, depth: int = DEPTH, share: float | None = None) -> Tree:
    total, distinct = totals(vocabulary)
    least = max(2.0, (SHARE if share is None else share) * total)
    words, counts = frequent(vocabulary, least)
    spark = train.sparkSession
    parts, sieves = part_count(spark), []
    spent, kept = [], []  # tables that the next step, and that the whole tree reads last
    lower = cut_lineage(vocabulary_rows(vocabulary, total, distinct), spent)
    levels = []  # sequences that have a value of their own, without what they leave as contexts
    context, values = [], None
    for d in range(depth):
        counted = cut_lineage(sequence_counts(train, sieves), spent)
        sieves = [*sieves, sieve_of(counted, _sequence_keys, parts)] if d < depth - 1 else []
        rows, contexts = smoothed(sequence_rows(counted), lower, spent, kept)
        if d < depth - 1:
            rows = cut_lineage(rows, kept)
            discard(spark, spent)
        held = contexts.select(F.col("ctx").alias("key"), F.col("held").alias("c"), F.col("spare"))
        context.append(gathered(held.where(F.col("c") >= least).withColumn("value", F.col("spare")))[0])
        if d:
            left = values.join(held.select("key", "spare"), "key", "left")
            values = left.select("key", "c", (F.col("delta") + F.coalesce("spare", F.lit(0.0))).alias("value"))
        else:
            values = held.select("key", "c", F.col("spare").alias("value"))  # words as contexts
        levels.append(values)
        values = lower = rows
    levels.append(values.select("key", "c", F.col("delta").alias("value")))
    table = levels[0]
    for more in levels[1:]:
        table = table.unionByName(more)
    table = cut_lineage(table.where((F.col("value") != 0) | (F.col("c") >= least)), last := [])
    discard(spark, spent + kept)
    keys, known = gathered(table.where(F.col("c") >= least))
    rest = cut_lineage(dealt(table.where(F.col("c") < least).select("key", "value"), parts))
    discard(spark, last)
    sieve = sieve_of(rest, lambda row: _wide(row["keys"]), parts)
    return Tree(words, counts, total, distinct, keys, known, context, rest, sieve)


def dealt(table: DataFrame, parts: int) -> DataFrame:
    """``key, value`` rows packed by part, one row a part, by the six bytes of a key that are asked."""

    def together(rows: pa.Table) -> pa.Table:
        keys, values = rows["key"].to_numpy().view(np.uint64), rows["value"].to_numpy()
        keys, values = _low(keys, values)
        low = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6]
        return pa.table([pa.array([rows["part"][0].as_py()], pa.int32()), pa.array([low.tobytes()]), pa.array([values.tobytes()])], ["part", "keys", "counts"])

    part = (F.shiftrightunsigned("key", 40) % parts).cast("int").alias("part")  # as part_of
    return table.select(part, "key", "value").groupBy("part").applyInArrow(together, COUNTS)


def _wide(low: bytes) -> np.ndarray:
    out = np.zeros((len(low) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(low, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _low(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By the bytes that are asked."""
    order = np.argsort(keys & ASKED, kind="stable")
    return (keys & ASKED)[order], values[order]


def local_scores(tree: Tree, keys, row) -> tuple[np.ndarray, np.ndarray]:
    """What the frequent part gives of each token's log10 probability, and whether the word is outside it."""
    score, number, *_ = _local(tree, keys, row)
    return score, number < 0


def _local(tree: Tree, keys, row):
    """Scores as ``local_scores``, each word's place in the frequent part or -1, and the fingerprints and rows of the
    sequences outside it."""
    number = _find(tree.words, keys, tree.word_index)
    outside = number < 0
    score = np.zeros(len(keys))
    score[~outside] = tree.root[number[~outside]]
    as_context = np.zeros(len(keys))
    found = _find(tree.keys, keys, tree.key_index)
    as_context[(found >= 0) & ~outside] = tree.values[found[(found >= 0) & ~outside]]
    # a word's value belongs to the token behind it
    score[1:] += np.where(row[1:] == row[:-1], as_context[:-1], 0.0)
    asked, asked_row = [], []
    for last, key, _, _ in sequences(keys, row, [None] * DEPTH):
        found = _find(tree.keys, key, tree.key_index)
        score[last[found >= 0]] += tree.values[found[found >= 0]]
        ask = np.flatnonzero(found < 0)
        ask = ask[passed(tree.sieve, key[ask])]
        asked.append(key[ask])
        asked_row.append(row[last[ask]])
    return score, number, np.concatenate(asked), np.concatenate(asked_row)


def scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = docs.sparkSession
    rows = keyed(docs)
    train = rows.where(fold(FOLDS) != HELD_OUT)
    parts = part_count(spark)

    def count(batches):
        for b in batches:
            found = [np.unique(k, return_counts=True) for _, _, k, _ in token_keys(b["text"])]
            yield count_batch([k for k, _ in found], [c for _, c in found], parts)

    vocabulary = cut_lineage(summed(train.select("text").mapInArrow(count, COUNTS)))
    tree = grow(train, vocabulary)
    shared = spark.sparkContext.broadcast(replace(tree, table=None))
    below = np.log10(tree.total + tree.distinct + 1)

    def ask(batches):
        """One row per part and step: kind 0 has the documents and what is known of them, kind 1 fingerprints of words,
        kind 2 those of sequences."""
        known = shared.value
        for number, b in enumerate(batches):
            ids = b["doc_id"].to_numpy(zero_copy_only=False)
            out = []
            for first, last, keys, row in token_keys(b["text"]):
                n = last - first
                score, number, longer, longer_row = _local(known, keys, row)
                outside = number < 0
                log = np.zeros(len(keys))
                log[~outside] = known.logs[number[~outside]]
                total = lambda x: np.bincount(row, weights=x, minlength=n)
                tokens = np.bincount(row, minlength=n)
                facts = np.stack([tokens, total(~outside), total(log), total(score), total(outside)], axis=1)
                name = f"{TaskContext.get().partitionId()}-{number}-{first}"  # the same when a task is run again
                out.append((int(part_of(keys[:1], parts)[0]), name, 0, ids[first:last].tobytes(), facts.astype(np.float64).tobytes()))
                for kind, asked, asked_row in ((1, keys[outside], row[outside]), (2, longer, longer_row)):
                    part = part_of(asked, parts)
                    order = part_order(part, parts)
                    cuts = np.searchsorted(part[order], np.arange(parts + 1))
                    for p in np.flatnonzero(np.diff(cuts)).tolist():
                        at = order[cuts[p] : cuts[p + 1]]
                        at = at[np.argsort(asked_row[at], kind="stable")]
                        low = np.ascontiguousarray(asked[at]).view(np.uint8).reshape(-1, 8)[:, :6]
                        out.append((p, name, kind, np.diff(asked_row[at], prepend=0).astype(np.uint32).tobytes(), low.tobytes()))
            yield _record(out)

    def look_up(asked: pa.Table, held: pa.Table) -> pa.Table:
        keys, counts = merged(*_arrays(held.filter(pc.invert(held["tree"]))))
        keys, counts = _low(keys, counts)
        sequence, value = _valued(held.filter(held["tree"]))
        out = []
        for name, kind, rows_, values in zip(*[asked[c].to_pylist() for c in ("name", "kind", "rows", "value")]):
            if kind:
                row, wanted = np.cumsum(np.frombuffer(rows_, np.uint32)), _wide(values)
                found = _find(keys if kind == 1 else keys[:0], wanted)
                log = np.where(found >= 0, np.log10(counts[np.maximum(found, 0)] + 1) if len(counts) else 0.0, 0.0)
                valued = _find(sequence, wanted)
                more = np.where(valued >= 0, value[np.maximum(valued, 0)] if len(value) else 0.0, 0.0)
                live = (found >= 0) | (valued >= 0)
                if not live.any():
                    continue
                docs_, at = np.unique(row[live], return_inverse=True)
                facts = (more[live], log[live], found[live] >= 0)[: 3 if kind == 1 else 1]
                got = np.stack([np.bincount(at, weights=x) for x in facts], axis=1)
                rows_, values = docs_.astype(np.uint32).tobytes(), got.tobytes()
            out.append((0, name, kind, rows_, values))
        return pa.Table.from_batches([_record(out)])

    def settle(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        rows_, values = table["rows"].to_pylist(), table["value"].to_pylist()
        base = kinds.index(0)
        ids = np.frombuffer(rows_[base], np.int64)
        facts = np.frombuffer(values[base]).reshape(-1, 5).copy()
        tokens, known, log, score, outside = facts.T.copy()
        for kind, r, v in zip(kinds, rows_, values):
            if kind:
                at, got = np.frombuffer(r, np.uint32), np.frombuffer(v)
                if kind == 2:  # sequences
                    score[at] += got
                    continue
                more, found, seen = got.reshape(-1, 3).T
                known[at] += seen
                log[at] += found
                score[at] += found + more
        return pa.table(
            {
                "doc_id": pa.array(ids), "n_tokens": pa.array(tokens.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)),
                "base_score": pa.array(log - tokens * below), "score": pa.array(score - outside * below),
            }
        )

    schema = "part int, name string, kind int, rows binary, value binary"
    asked = rows.mapInArrow(ask, schema)
    held = vocabulary.withColumn("tree", F.lit(False)).unionByName(tree.table.withColumn("tree", F.lit(True)))
    answered = asked.groupBy("part").cogroup(held.groupBy("part")).applyInArrow(look_up, schema)
    result = answered.groupBy("name").applyInArrow(settle, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return result.select(
        "doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


def _record(out) -> pa.RecordBatch:
    columns = list(zip(*out)) or [[]] * 5
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "name", "kind", "rows", "value"])
