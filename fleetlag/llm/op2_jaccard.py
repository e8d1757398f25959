"""N-gram Jaccard join with several global token orders.

A document's set holds the fingerprints of its distinct five-word shingles. Documents link when
``100 * |A & B| >= 75 * |A | B|``.

1. Documents with equal sets form one class; only class representatives go on.
2. One packed exchange gives every shingle its frequency class (log2 of the number of representatives that hold
   it). A link needs ``ceil(3n/4)`` shared shingles, so a set with fewer shingles of frequency two or more has no
   partner and leaves.
3. Groups by the smallest shingle under a hash are streamed, sets of the most frequent shingles first: a set is
   compared with the group's first leaders, of which the text that all near copies come from is one. Links found so
   merge most of a group without forming its pairs; large groups are split by a salt. These are true links; nothing is concluded from links not found.
4. Candidates between different components so far: pairs that share a prefix token under every one of ``ORDERS``
   global orders. Each order sorts by frequency class, rarest first, then by its own hash; a prefix has
   ``n - ceil(3n/4) + 1`` tokens. The first order is joined by token, without the tokens that one component holds
   alone, a pair needs enough tokens after the places of its common one, and distinct pairs must pass the other orders
   before their whole sets are compared.
5. Components of all links.

Rows: null and empty texts have empty sets and stand alone; fewer than five words make one shingle; repeated rows
are in one class; rows of one doc_id with different texts are different sets; rows without doc_id are left out. Other columns are
ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag.llm.components import components
from fleetlag.llm.exchange import PACKED, answers, by_document, group_sizes, packed, unpacked
from fleetlag.llm.texts import (
    ascii_lower, byte_sums, mixed, part_count, partitions, prefix_sums, row_key, span, steps, utf8, word_spans,
)
from fleetlag.session import cut_lineage

NGRAM = 5
ORDERS = 3
ROUNDS = 3
LEADERS = 8
GROUP = 2000
SEEDS = np.random.default_rng(77).integers(1, 2**63, 16, dtype=np.uint64)


def needed(n):
    """Shingles that a set of ``n`` must share with any partner."""
    return (3 * n + 3) // 4


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct shingles, ascending in each row, and their counts."""
    data, offsets = utf8(column)
    values, counts = [], []
    for a, b in steps(np.diff(offsets).tolist()):
        v, c = _sets(ascii_lower(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a])
        values.append(v)
        counts.append(c)
    if not values:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(values), np.concatenate(counts)


def _sets(data, offsets):
    starts, ends, first = word_spans(data, offsets)
    rows = len(offsets) - 1
    words = np.diff(first)
    sums = prefix_sums(span(byte_sums(data), starts, ends))
    grams = np.where(words > 0, np.maximum(words - NGRAM + 1, 1), 0)
    row = np.repeat(np.arange(rows), grams)
    at = np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams) + first[row]
    gram = span(sums, at, np.minimum(at + NGRAM, first[row + 1]))
    order = np.lexsort((gram, row))
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    return gram[new], np.bincount(row[new], minlength=rows)


def ids_of(batch) -> tuple[np.ndarray, np.ndarray]:
    return batch["doc_id"].to_numpy(zero_copy_only=False), batch["text_hash"].to_numpy(zero_copy_only=False)


def profiles(docs: DataFrame) -> DataFrame:
    """Set size and two fingerprints of the whole set of every row."""

    def run(batches):
        for b in batches:
            values, counts = shingle_sets(b["text"])
            ends = np.cumsum(counts)
            total = lambda v: np.diff(np.concatenate([[np.uint64(0)], np.cumsum(v, dtype=np.uint64)])[np.concatenate([[0], ends])])
            first, second = total(mixed(values ^ SEEDS[0])), total(mixed(values ^ SEEDS[1]))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["text_hash"], pa.array(counts), pa.array(first.view(np.int64)), pa.array(second.view(np.int64))],
                ["doc_id", "text_hash", "n", "s1", "s2"],
            )

    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, s1 long, s2 long")


def frequency_classes(keys, doc_ids, rows) -> np.ndarray:
    """0 for a shingle of one set, else 1 + log2 of its frequency. A set holds a shingle once."""
    order, group, starts = group_sizes(keys)
    size = np.diff(np.append(starts, len(keys)))
    classes = np.where(size > 1, 1 + np.log2(np.maximum(size, 1)).astype(np.int64), 0)
    out = np.zeros(len(keys), np.int64)
    out[order] = classes[group]
    return out


def node_of(doc_id: str, text_hash: str):
    return F.xxhash64(doc_id, text_hash).alias("node")


def surviving_sets(docs: DataFrame, first: DataFrame) -> DataFrame:
    """Sets that may have a partner: ``node, n, held, purity, tokens, classes``, without their unique shingles.

    ``node`` numbers a class by its first row; ``held`` counts its shingles of frequency two or more; ``purity`` is
    their mean frequency class over the whole set, highest for the text that a group of near copies comes from."""
    spark = docs.sparkSession
    parts = part_count(spark)
    kept = docs.join(first, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])

    def ask(batches):
        for b in batches:
            values, counts = shingle_sets(b["text"])
            yield packed(*ids_of(b), counts, values, parts)

    flags = by_document(answers(kept.select("doc_id", "text_hash", "text").mapInArrow(ask, PACKED), frequency_classes))

    def collect(batches):
        for b in batches:
            values, counts = shingle_sets(b["text"])
            ends = np.cumsum(counts).tolist()
            out = []
            for start, end, parts_of in zip([0, *ends[:-1]], ends, b["flags"].to_pylist()):
                flag = unpacked(values[start:end], parts, parts_of)
                live = flag > 0
                size, purity = end - start, float(flag.sum(dtype=np.int64)) / max(1, end - start)
                out.append((size, int(live.sum()), purity, values[start:end][live].tobytes(), flag[live].tobytes()))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [b["node"], *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["node", "n", "held", "purity", "tokens", "classes"],
            )

    # the smallest need of a set is checked before its text is read again
    candidates = kept.join(flags, ["doc_id", "text_hash"]).where(F.expr("held >= (3 * n + 3) div 4"))
    schema = "node long, n long, held long, purity double, tokens binary, classes binary"
    return cut_lineage(candidates.select(node_of("doc_id", "text_hash"), "text", "flags").mapInArrow(collect, schema))


def linked(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> bool:
    if 4 * min(n_a, n_b) < 3 * max(n_a, n_b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (n_a + n_b - both)


def leader_links(sets: DataFrame, round_: int) -> DataFrame:
    """True links ``a, b`` of sets to a purer one that shares the smallest shingle under the round's hash."""
    seed = SEEDS[2 + round_]

    def keys(batches):
        for b in batches:
            key = []
            for t in b["tokens"].to_pylist():
                v = mixed(np.frombuffer(t, np.uint64) ^ seed)
                key.append(int(v.min().view(np.int64)) if len(v) else 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), *[b[c] for c in ("node", "n", "purity", "tokens")]], ["key", "node", "n", "purity", "tokens"]
            )

    schema = "key long, node long, n long, purity double, tokens binary"
    rows = sets.select("node", "n", "purity", "tokens").mapInArrow(keys, schema)
    wide = cut_lineage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > GROUP))
    salt = F.when(F.col("size").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / GROUP)))
    dealt = rows.join(F.broadcast(wide) if wide.count() < 100_000 else wide, "key", "left").withColumn("salt", salt).drop("size")

    def lead(batches):
        group, leaders = None, []
        for b in batches:
            a_ids, b_ids = [], []
            for key, salt, node, n, tokens in zip(*[b[c].to_pylist() for c in ("key", "salt", "node", "n", "tokens")]):
                if (key, salt) != group:
                    group, leaders = (key, salt), []
                mine = np.frombuffer(tokens, np.uint64)
                for other, m, theirs in leaders:
                    if other != node and linked(mine, n, theirs, m):
                        a_ids.append(node)
                        b_ids.append(other)
                        break
                else:
                    if len(leaders) < LEADERS:
                        leaders.append((node, n, mine))
            yield pa.RecordBatch.from_arrays([pa.array(a_ids, pa.int64()), pa.array(b_ids, pa.int64())], ["a", "b"])

    placed = dealt.repartition(partitions(sets.sparkSession), "key", "salt")
    return placed.sortWithinPartitions("key", "salt", F.desc("purity"), "node").mapInArrow(lead, "a long, b long")


def prefix_of(tokens: np.ndarray, classes: np.ndarray, n: int, order: int) -> np.ndarray:
    """Prefix of a set under one global order, without its unique shingles, which come first and match nothing."""
    length = max(0, len(tokens) - int(needed(n)) + 1)
    return tokens[np.lexsort((mixed(tokens ^ SEEDS[8 + order]), classes))[:length]]


def prefixes(sets: DataFrame) -> DataFrame:
    """``token, place, node, n, held, component``: the prefix tokens of each set under the first order, with their places."""

    def run(batches):
        for b in batches:
            lists = []
            for n, t, c in zip(*[b[x].to_pylist() for x in ("n", "tokens", "classes")]):
                lists.append(prefix_of(np.frombuffer(t, np.uint64), np.frombuffer(c, np.uint8), n, 0).view(np.int64))
            many = np.array([len(x) for x in lists], np.int64)
            tokens = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(many) - many, many)
            wide = lambda name: pa.array(np.repeat(b[name].to_numpy(zero_copy_only=False), many))
            columns = ["node", "n", "held", "component"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens), pa.array(place), *[wide(c) for c in columns]], ["token", "place", *columns]
            )

    kept = sets.select("node", "n", "held", "component", "tokens", "classes")
    return cut_lineage(kept.mapInArrow(run, "token long, place long, node long, n long, held long, component long"))


def across(prefix: DataFrame) -> DataFrame:
    """Prefix rows whose token two or more components hold."""
    wide = prefix.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return prefix.join(wide.select("token"), "token", "left_semi")


def cross_pairs(sets: DataFrame) -> DataFrame:
    """Pairs of sets in different components that share a prefix token under the first order, each once.

    Unique shingles never match, and neither do the tokens before the first common one, so two sets share at most the
    smaller rest of their ``held`` tokens from there; a pair whose sizes ask for more is left out (positional filter)."""
    rows = cut_lineage(across(prefixes(sets)))
    other = rows.select("token", *[F.col(c).alias("l_" + c) for c in ("place", "node", "n", "held", "component")])
    # at the first common token x shared ones are at most what is left, and 100 x >= 75 (m + n - x); a later common
    # token asks the same of fewer, so a pair that passes at none of them is not linked
    enough = F.expr("7 * least(l_held - l_place, held - place) >= 3 * (l_n + n)")
    return (
        other.join(rows, "token")
        .where((F.col("l_node") < F.col("node")) & (F.col("l_component") != F.col("component")) & enough)
        .select(F.col("l_node").alias("a"), F.col("node").alias("b"))
        .distinct()
    )


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that share a prefix token under all other orders too and whose whole sets link."""
    names = ["n", "tokens", "classes"]
    side = lambda k: sets.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in names])

    def run(batches):
        for b in batches:
            hit = []
            for m, x, cx, n, y, cy in zip(*[b[f"{c}_{k}"].to_pylist() for k in "ab" for c in names]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                cx, cy = np.frombuffer(cx, np.uint8), np.frombuffer(cy, np.uint8)
                meet = all(
                    len(np.intersect1d(prefix_of(x, cx, m, order), prefix_of(y, cy, n, order), assume_unique=True))
                    for order in range(1, ORDERS)
                )
                hit.append(meet and linked(x, m, y, n))
            mask = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([b["a"].filter(mask), b["b"].filter(mask)], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def labels_of(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """``node, component``: the root of each set's tree. A set has one parent, met in the round that took the set out,
    so trees are at most ``ROUNDS`` deep and no loop is needed."""
    out = nodes.withColumn("component", F.col("node"))
    for _ in range(ROUNDS):
        step = parents.select(F.col("a").alias("component"), "b")
        out = out.join(step, "component", "left").select("node", F.coalesce("b", "component").alias("component"))
    return cut_lineage(out)


def links(docs: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels of the sets that may have partners, and the links ``a, b`` found between different labels."""
    sets = surviving_sets(docs, first)
    parents, left = None, sets
    for round_ in range(ROUNDS):
        new = cut_lineage(leader_links(left, round_))
        parents = new if parents is None else parents.union(new)
        left = sets.join(parents.select(F.col("a").alias("node")), "node", "left_anti")  # roots go on
    labels = labels_of(sets.select("node"), parents)
    labelled = cut_lineage(sets.join(labels, "node"))
    side = lambda k: labels.select(F.col("node").alias(k), F.col("component").alias("c_" + k))
    met = verified(cross_pairs(labelled), sets).join(side("a"), "a").join(side("b"), "b")
    return labels, cut_lineage(met.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct())


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    rows = row_key(docs)
    profile = cut_lineage(profiles(rows))
    classes = cut_lineage(
        profile.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    )
    labels, found = links(rows, classes.select("k.doc_id", "k.text_hash", "n"))
    of_class = classes.select("n", "s1", "s2", F.col("k.doc_id").alias("first"), node_of("k.doc_id", "k.text_hash"))
    labelled = of_class.join(labels, "node").drop("node")
    if not found.isEmpty():
        known = cut_lineage(components(found)).select(F.col("node").alias("component"), F.col("component").alias("c"))
        labelled = labelled.join(known, "component", "left").withColumn("component", F.coalesce("c", "component")).drop("c")
    least = labelled.groupBy("component").agg(F.min("first").alias("least"))
    settled = labelled.join(least, "component").select("n", "s1", "s2", "least")
    by_class = of_class.join(settled, ["n", "s1", "s2"], "left").select("n", "s1", "s2", F.coalesce("least", "first").alias("c"))
    return profile.join(by_class, ["n", "s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id")
    )
