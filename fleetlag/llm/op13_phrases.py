"""Phrase collocations by dynamic itemset counting.

Words are counted per language; phrases of two and three words become candidates at ``minimum`` occurrences. The corpus
is cut into shards that are scanned in a cycle: step ``t`` scans shard ``t mod shards``.

* Words are counted in the first cycle. A word is active for pairs from the step after the one in which its count
  reached the minimum; a pair is counted from the step at which both its words are active, for one full cycle, which
  meets every shard once and gives its exact count. Triples follow pairs in the same way, so lengths are interleaved:
  a scan counts words, pairs and triples side by side, each in its own part of the cycle.
* A frequent phrase has frequent parts, so every phrase of the minimum gets active; all are complete after three cycles.

In Spark: texts are packed once into blocks of one language (distinct words and codes), written bucketed by block. A
scan asks, for the distinct keys of each block, since which step they are active: asks are dealt by key over parts and
carry their counts; a part adds the counts to its state, a table bucketed by part that is read without a shuffle, and
answers with one byte a key. Counts are summed per block before they travel, so a frequent phrase is one entry of a
block. Pairs whose count is complete and too small are not asked again. Nothing is broadcast.

Words and pairs are told apart by 64-bit fingerprints of language and words; counts of other phrases are never mixed
unless two fingerprints are equal. Scores use integers of 38 digits.

Rows: a null or empty text has no words; repeated rows count each; a null language is ``und``; rows need no doc_id;
other columns are ignored; an empty table, or one without candidates, gives no rows; a text of any length is read whole.
"""

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlag.llm.texts import ascii_lower, byte_sums, mixed, part_count, partitions, rows_bytes, span, steps
from fleetlag.session import cut_lineage, scratch_path

MINIMUM = 10
ABSORB = 50
TOP = 2000
SHARDS = 3
BLOCK_BYTES = 8 << 20

PIECE_END = np.zeros(256, bool)
PIECE_END[list(b".,;:!?\n\x0b\x0c\r")] = True
WORD_END = PIECE_END.copy()
WORD_END[[9, 32]] = True
NEW_PIECE = np.uint32(1 << 31)
EMIT = 128
BLOCKS = "block long, shard int, lang string, n long, words binary, codes binary"
ASKS = "part int, block long, keys binary, counts binary"
STATE = "kind int, part int, block long, keys binary, counts binary, t int"
ANSWER, DELTA = 0, 1


def planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, which compresses well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def ascending(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def from_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def seed_of(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key: ascending with the key, so that sorted keys lie part by part."""
    return (((keys >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(mixed(left) * np.uint64(0xD6E8FEB86659FD93) + right)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Key, start and end of every word, whether it starts a piece, and the lower-case bytes; each text ends a piece."""
    data = ascii_lower(np.frombuffer(b"\n".join(texts), np.uint8))
    edge = np.diff((~WORD_END[data]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.searchsorted(np.flatnonzero(PIECE_END[data]), starts)
    return span(byte_sums(data), starts, ends), starts, ends, np.diff(piece, prepend=-1) != 0, data.tobytes()


def block_of(texts: list[bytes], seed: np.uint64) -> tuple[int, bytes, bytes]:
    """Number of words, distinct words by ascending key, and the codes of all words."""
    held = [words_of(texts[a:b]) for a, b in steps([len(t) for t in texts])]
    keys, first, codes = np.unique(mixed(np.concatenate([h[0] for h in held]) ^ seed), return_index=True, return_inverse=True)
    codes = codes.astype(np.uint32)
    codes[np.concatenate([h[3] for h in held])] |= NEW_PIECE
    upto = np.cumsum([0, *[len(h[0]) for h in held]])
    step = np.searchsorted(upto, first, "right") - 1
    words = [b""] * len(keys)
    for i, (_, starts, ends, _, raw) in enumerate(held):
        mine = np.flatnonzero(step == i)
        at = first[mine] - upto[i]
        for k, a, b in zip(mine.tolist(), starts[at].tolist(), ends[at].tolist()):
            words[k] = raw[a:b]
    press = zstandard.ZstdCompressor(level=1).compress
    return len(codes), press(b" ".join(words)), press(planes(codes))


def blocks(docs: DataFrame, shards: int) -> DataFrame:
    def run(batches):
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        task, number = TaskContext.get().partitionId(), 0

        def row(lang):
            nonlocal number
            n, words, codes = block_of(held.pop(lang), seed_of(lang))
            size.pop(lang)
            columns = [[(task << 32) + number], [(task + number) % shards], [lang], [n], [words], [codes]]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "shard", "lang", "n", "words", "codes"]
            )

        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), rows_bytes(b["text"])):
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= BLOCK_BYTES:
                    yield row(lang)
        for lang in list(held):
            yield row(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, BLOCKS).where("n > 0")


class Block:
    """The words of a block: keys ascending, codes of all words, and whether a word goes on the piece before it."""

    def __init__(self, row: dict):
        unpack = zstandard.ZstdDecompressor().decompress
        self.words = unpack(row["words"]).split(b" ")
        data = np.frombuffer(b" ".join(self.words), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in self.words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        self.keys = mixed(span(byte_sums(data), starts, ends) ^ seed_of(row["lang"]))
        codes = from_planes(unpack(row["codes"]), np.uint32)
        self.joined = (codes & NEW_PIECE) == 0
        self.codes = (codes & ~NEW_PIECE).astype(np.int64)

    def pairs(self, since: np.ndarray) -> "Pairs":
        """Pairs of active words, ``since`` holding the step of each distinct word, or 0."""
        return Pairs(self, since)


class Pairs:
    """Distinct pairs of active words by ascending key, with their first step, and the places where they stand."""

    def __init__(self, block: Block, since: np.ndarray):
        step = since[block.codes]
        self.at = np.flatnonzero(block.joined[1:] & (step[:-1] > 0) & (step[1:] > 0))
        wide = len(block.keys)
        ids, back, counts = np.unique(
            block.codes[self.at] * wide + block.codes[self.at + 1], return_inverse=True, return_counts=True
        )
        self.left, self.right = ids // wide, ids % wide
        keys = pair_keys(block.keys[self.left], block.keys[self.right])
        order = np.argsort(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.slot = place[back]
        self.keys, self.counts = keys[order], counts[order].astype(np.uint32)
        self.left, self.right = self.left[order], self.right[order]
        self.act = np.maximum(since[self.left], since[self.right]).astype(np.int64)

    def triples(self, since: np.ndarray):
        """First and second pair (slots) of each place where two active pairs overlap."""
        step = since[self.slot]
        near = np.flatnonzero((np.diff(self.at) == 1) & (step[:-1] > 0) & (step[1:] > 0))
        return self.slot[near], self.slot[near + 1]


def asks_of(row_block: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    part = parts_of(keys, parts)
    cuts = np.searchsorted(part, np.arange(parts + 1))
    live = np.flatnonzero(np.diff(cuts))
    spans = list(zip(cuts[live].tolist(), cuts[live + 1].tolist()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(live.astype(np.int32)),
            pa.array(np.full(len(live), row_block, np.int64)),
            pa.array([ascending(keys[a:b]) for a, b in spans], pa.binary()),
            pa.array([planes(counts[a:b]) for a, b in spans], pa.binary()),
        ],
        ["part", "block", "keys", "counts"],
    )


def answered(keys: np.ndarray, given: list[dict], parts: int) -> np.ndarray:
    """One byte for each of the ascending keys, from the answers of the parts; none is 0."""
    out = np.zeros(len(keys), np.uint8)
    cuts = np.searchsorted(parts_of(keys, parts), np.arange(parts + 1))
    for g in given:
        out[cuts[g["part"]] : cuts[g["part"] + 1]] = np.frombuffer(g["keys"], np.uint8)
    return out


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, value = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    start = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
    return key[start], np.add.reduceat(value, start)


def history(state: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts and steps of a part's state, sorted by key and step."""
    rows = [(from_ascending(k), from_planes(c, np.int64), t) for k, c, t in zip(*[state[x].to_pylist() for x in ("keys", "counts", "t")])]
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, count = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    step = np.repeat([r[2] for r in rows], [len(r[0]) for r in rows])
    order = np.lexsort((step, key))
    return key[order], count[order], step[order]


def active_since(key: np.ndarray, count: np.ndarray, step: np.ndarray, minimum: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys that reach the minimum, the step after the one in which they do, and their counts."""
    if not len(key):
        return key, step, count
    start = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    run = np.cumsum(count)
    run -= (run[start] - count[start])[group]
    reached = np.flatnonzero(run >= minimum)
    first = reached[np.diff(group[reached], prepend=-1) != 0]
    return key[first], step[first] + 1, np.add.reduceat(count, start)[group[first]]


def answering(t: int, shards: int, minimum: int):
    """What a part does with its state and the asks of one scan: answers for the blocks, and the counts of this step."""

    def run(state: pa.Table, asks: pa.Table) -> pa.Table:
        key, count, step = history(state)
        hot, since, _ = active_since(key, count, step, minimum)
        shard = t % shards
        met = np.unique(key[step % shards < shard])  # held by an earlier shard
        rows = sorted(zip(*[asks[x].to_pylist() for x in ("block", "keys", "counts")]))
        part = asks["part"][0].as_py() if rows else 0
        seen = [(b, from_ascending(k), from_planes(c, np.uint32)) for b, k, c in rows]
        every = np.concatenate([k for _, k, _ in seen]) if seen else key[:0]
        flags = np.zeros(len(every), np.uint8)
        if len(hot) and len(every):
            at = np.minimum(np.searchsorted(hot, every), len(hot) - 1)
            flags = np.where(hot[at] == every, since[at], 0).astype(np.uint8)
            live = np.flatnonzero(flags)
            _, first = np.unique(every[live], return_index=True)  # blocks ascend: the first block of a key in the shard
            first = live[first]
            flags[first[~np.isin(every[first], met, assume_unique=True)]] |= EMIT
        out = {name: [] for name in ("kind", "part", "block", "keys", "counts", "t")}

        def add(kind, block, keys, counts):
            for name, value in zip(out, (kind, part, block, keys, counts, t)):
                out[name].append(value)

        start = 0
        for block, k, _ in seen:
            mine = flags[start : start + len(k)]
            start += len(k)
            if mine.any():
                add(ANSWER, block, mine.tobytes(), b"")
        counted = [(k[c > 0], c[c > 0]) for _, k, c in seen]
        if sum(len(k) for k, _ in counted):
            k, c = summed(*zip(*counted))
            add(DELTA, 0, ascending(k), planes(c))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32()]
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return run


class Counting:
    """Tables of one run: blocks bucketed by block, and the states of words and pairs bucketed by part."""

    def __init__(self, docs: DataFrame, shards: int, minimum: int):
        self.spark: SparkSession = docs.sparkSession
        self.shards, self.minimum = shards, minimum
        self.parts, self.buckets = part_count(self.spark), partitions(self.spark)
        run = uuid.uuid4().hex
        self.names = {n: f"phrases_{n}_{run}" for n in ("blocks", "words", "pairs")}
        spread = blocks(docs, shards).repartition(self.buckets, "block")
        self._append(spread, "blocks", ["shard"], "block")
        self.triples: list[DataFrame] = []
        self.named: list[DataFrame] = []

    def _append(self, rows: DataFrame, name: str, split: list[str], by: str) -> None:
        table = self.names[name]
        writer = rows.write.mode("append").partitionBy(*split).bucketBy(self.buckets, by)
        if not self.spark.catalog.tableExists(table):
            writer = writer.option("path", scratch_path(self.spark, f"phrases-{name}"))
        writer.saveAsTable(table)

    def forget(self) -> None:
        for table in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.names[name])

    def shard(self, t: int) -> DataFrame:
        return self.table("blocks").where(F.col("shard") == t % self.shards).select("block", "lang", "words", "codes")

    def answers(self, name: str, *steps: int) -> DataFrame:
        rows = self.table(name).where((F.col("kind") == ANSWER) & F.col("t").isin(*steps))
        return rows.select("block", F.struct(F.lit(name).alias("of"), "t", "part", "keys").alias("given"))

    def met(self, blocks: DataFrame, *answers: DataFrame) -> DataFrame:
        """Blocks with the answers that they got."""
        return blocks.join(united(answers).groupBy("block").agg(F.collect_list("given").alias("given")), "block")

    def ask(self, name: str, t: int, asks: DataFrame) -> None:
        """Deal the asks of step ``t`` to the parts, and keep answers and counts."""
        first = not self.spark.catalog.tableExists(self.names[name])
        state = self.spark.createDataFrame([], STATE) if first else self.table(name).where((F.col("kind") == DELTA) & (F.col("t") < t))
        done = state.groupBy("part").cogroup(asks.groupBy("part")).applyInArrow(answering(t, self.shards, self.minimum), STATE)
        self._append(done, name, ["t", "kind"], "part")

    def ask_words(self, t: int) -> None:
        counting, parts = t < self.shards, self.parts

        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    block = Block(row)
                    counts = np.bincount(block.codes, minlength=len(block.keys)).astype(np.uint32)
                    yield asks_of(row["block"], block.keys, counts if counting else counts * np.uint32(0), parts)

        self.ask("words", t, self.shard(t).mapInArrow(run, ASKS))

    def reader(self, t: int):
        """How a task gets a block's pairs at step ``t``, and since when they are active as far as it was answered: pairs
        answered in the second cycle are asked again in the third only if they were still counted and not yet frequent."""
        shards, parts = self.shards, self.parts
        shard, cycle = t % shards, t // shards
        word_step = t if cycle < 2 else t - shards

        def read(row):
            block = Block(row)
            given: dict = {}
            for g in row["given"]:
                given.setdefault((g["of"], g["t"]), []).append(g)
            pairs = block.pairs(answered(block.keys, given.get(("words", word_step), []), parts) & ~np.uint8(EMIT))
            flags = np.zeros(len(pairs.keys), np.uint8)
            asked = np.arange(len(pairs.keys))
            if cycle == 2:
                flags = answered(pairs.keys, given.get(("pairs", t - shards), []), parts)
                asked = np.flatnonzero((flags == 0) & (pairs.act > shard))
            if ("pairs", t) in given:
                flags[asked] = answered(pairs.keys[asked], given["pairs", t], parts)
            return block, pairs, flags, asked

        return read

    def ask_pairs(self, t: int) -> None:
        shards, parts, read = self.shards, self.parts, self.reader(t)
        word_step = t if t < 2 * shards else t - shards

        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    _, pairs, _, asked = read(row)
                    counted = t - pairs.act[asked] < shards
                    yield asks_of(row["block"], pairs.keys[asked], np.where(counted, pairs.counts[asked], 0).astype(np.uint32), parts)

        answers = [self.answers("words", word_step)]
        if t >= 2 * shards:
            answers.append(self.answers("pairs", t - shards))
        self.ask("pairs", t, self.met(self.shard(t), *answers).mapInArrow(run, ASKS))

    def answered_blocks(self, t: int) -> DataFrame:
        shards = self.shards
        steps = [t] if t < 2 * shards else [t, t - shards]
        return self.met(self.shard(t), self.answers("words", t if t < 2 * shards else t - shards), self.answers("pairs", *steps))

    def count_triples(self, t: int) -> None:
        """Count the triples of step ``t``; in the last cycle also name each frequent pair, by the one block told to."""
        shards, read = self.shards, self.reader(t)
        naming = t >= 2 * shards
        kinds = pa.schema(
            [(n, pa.int64()) for n in ("k12", "k23", "c")] + [(n, pa.string()) for n in "lang x y".split()] + [(n, pa.int64()) for n in ("kx", "ky", "k")]
        )

        def filled(columns):
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in kinds], schema=kinds)

        def key(keys):
            return pa.array(keys.view(np.int64))

        def run(batches):
            for b in batches:
                for row in b.to_pylist():
                    block, pairs, flags, _ = read(row)
                    since = (flags & ~np.uint8(EMIT)).astype(np.int64)
                    left, right = pairs.triples(since)
                    live = t - np.maximum(since[left], since[right]) < shards
                    ids, counts = np.unique(left[live] * len(since) + right[live], return_counts=True)
                    first, second = pairs.keys[ids // max(1, len(since))], pairs.keys[ids % max(1, len(since))]
                    yield filled({"k12": key(first), "k23": key(second), "c": pa.array(counts.astype(np.int64))})
                    if naming:
                        mine = np.flatnonzero(flags & EMIT)
                        columns = {"lang": pa.array([row["lang"]] * len(mine), pa.string()), "k": key(pairs.keys[mine])}
                        for side, codes in (("x", pairs.left[mine]), ("y", pairs.right[mine])):
                            columns[side] = pa.array([block.words[i].decode() for i in codes.tolist()], pa.string())
                            columns["k" + side] = key(block.keys[codes])
                        yield filled(columns)

        schema = "k12 long, k23 long, c long, lang string, x string, y string, kx long, ky long, k long"
        found = cut_lineage(self.answered_blocks(t).mapInArrow(run, schema))
        self.triples.append(found.where("c IS NOT NULL").select("k12", "k23", "c"))
        if naming:
            self.named.append(found.where("k IS NOT NULL").select("lang", "x", "y", "kx", "ky", "k"))

    def run(self) -> None:
        for t in range(3 * self.shards):
            if t < 2 * self.shards:
                self.ask_words(t)
            if t >= 1:
                self.ask_pairs(t)
            if t >= 2:
                self.count_triples(t)

    def frequent(self, name: str) -> DataFrame:
        """``key, f`` of everything that reached the minimum."""
        minimum = self.minimum

        def run(table: pa.Table) -> pa.Table:
            key, _, total = active_since(*history(table), minimum)
            return pa.table({"key": pa.array(key.view(np.int64)), "f": pa.array(total)})

        return self.table(name).where(F.col("kind") == DELTA).groupBy("part").applyInArrow(run, "key long, f long")


def united(frames) -> DataFrame:
    whole = frames[0]
    for more in frames[1:]:
        whole = whole.union(more)
    return whole


def collocations(
    docs: DataFrame, minimum: int = MINIMUM, absorb: int = ABSORB, top: int = TOP, shards: int = SHARDS
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language."""
    counting = Counting(docs, shards, minimum)
    counting.run()
    words = counting.frequent("words")
    named = united(counting.named).join(counting.frequent("pairs").select(F.col("key").alias("k"), F.col("f").alias("a")), "k")
    for side in "xy":
        named = named.join(words.select(F.col("key").alias("k" + side), F.col("f").alias("f" + side)), "k" + side)
    pairs = cut_lineage(named.select("lang", "x", "y", "k", "a", "fx", "fy"))
    triples = cut_lineage(united(counting.triples).groupBy("k12", "k23").agg(F.sum("c").alias("a")).where(F.col("a") >= minimum))
    totals = cut_lineage(counting.table("blocks").groupBy("lang").agg(F.sum("n").alias("n")))
    counting.forget()

    head = pairs.select("lang", F.col("k").alias("k12"), "x", "y", F.col("a").alias("f12"), "fx")
    tail = pairs.select(F.col("k").alias("k23"), F.col("y").alias("z"), F.col("a").alias("f23"), F.col("fy").alias("fz"))
    longer = triples.join(head, "k12").join(tail, "k23")
    three = longer.select(
        "lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), "a",
        F.array(_cut("a", "fx", "f23", 1), _cut("a", "f12", "fz", 2)).alias("cuts"),
    )
    inside = triples.select(F.col("k12").alias("k"), F.col("a").alias("more"))
    inside = inside.union(triples.select("k23", "a")).groupBy("k").agg(F.max("more").alias("more"))
    left = pairs.join(inside, "k", "left").where(f"more IS NULL OR 100 * more < {int(absorb)} * a")
    two = left.select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), "a", F.array(_cut("a", "fx", "fy", 1)).alias("cuts"))
    scored = two.union(three).withColumn("cut", F.array_min("cuts"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _cut(a: str, left: str, right: str, k: int):
    """Score of a cut after ``k`` words, lowest first and then the smallest ``k``; products are exact to 38 digits."""
    exact = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    score = F.expr(f"CAST(1000000 AS DECIMAL(7,0)) * {exact(a)} * {exact(a)} div ({exact(left)} * {exact(right)})")
    return F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
