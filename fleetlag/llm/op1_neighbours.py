"""Approximate nearest neighbours by multi-index hashing.

Nearness is the inner product, so vectors get one more component that makes all of them equally long
(``sqrt(M^2 - |x|^2)``; 0 for queries): large products are then small angles. Learned rotations (iterative
quantisation, several of them behind one another) turn a vector into ``BITS`` signs. The code is split into
``SUBSTRINGS`` parts with an index each. If two codes differ in at most R bits, some part differs in at most
R // SUBSTRINGS; probing all index entries of a part within that distance therefore finds every code within R. Codes
within R are ranked by the exact product in double precision. A query with too few finds is searched again without a
radius.

Rotations and R are fitted in one task on at most ``SAMPLE`` distinct vectors, the first by a hash; R covers
``COVER`` of the sample's own nearest neighbours, which are farther apart than those among all rows. Every vector is
indexed. Equal vectors are one entry with the smallest ids that any query can need. Queries and entries meet in
blocks of fixed size, a stated query set against all rows.

Rows: vectors that are null, zero, or hold a null or a non-finite component take no part, nor do those of another
dimension than most and rows without vec_id; equal products rank by smaller vec_id; a row repeated with the same
vec_id counts once. Other columns are ignored. An empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag.session import cut_lineage

NEAREST = 20
EVERY = 20
BITS = 256
SUBSTRINGS = 16
SAMPLE = 6000
PROBES = 400
COVER = 0.985
ITERATIONS = 12
QUERY_BLOCK = 4096
ENTRY_BLOCK = 8192
STEP = 128
GATHER = 1 / 16  # share of pairs up to which they are compared one by one


def clean(embeddings: DataFrame) -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & good & F.exists("vector", lambda x: x != 0))
    most = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("vector") == (most[0]["d"] if most else 0))


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors as bytes with their ``keep`` smallest ids."""

    def run(batches):
        held: dict[bytes, list[int]] = {}
        for b in batches:
            flat = b["vector"].flatten().to_numpy(zero_copy_only=False) + 0.0  # no negative zero
            for i, v in zip(b["vec_id"].to_pylist(), flat.reshape(len(b["vec_id"]), -1)):
                ids = held.setdefault(v.tobytes(), [])
                ids.append(i)
                if len(ids) > 4 * keep:
                    ids[:] = sorted(set(ids))[:keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array([sorted(set(x))[:keep] for x in held.values()], pa.list_(pa.int64()))], ["v", "ids"]
        )

    found = rows.mapInArrow(run, "v binary, ids array<long>").groupBy("v").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return found.select("v", F.slice(F.array_sort(F.array_distinct("ids")), 1, keep).alias("ids"))


class Coder:
    """Rotations, radius and length bound."""

    def __init__(self, longest: float, mean: np.ndarray, rotation: np.ndarray, radius: int = BITS):
        self.longest, self.mean, self.rotation, self.radius = longest, mean, rotation, radius

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        long = np.sqrt((x * x).sum(axis=1))
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - long**2, 0))
        y = np.column_stack([x, extra]) / (np.maximum(long, 1e-300)[:, None] if query else self.longest)
        signs = (y - self.mean) @ self.rotation > 0
        return np.packbits(signs, axis=1).view(np.uint64)

    def packed(self) -> bytes:
        return np.concatenate([[self.longest, self.radius], self.mean, self.rotation.ravel()]).tobytes()

    @staticmethod
    def of(data: bytes, d: int) -> "Coder":
        a = np.frombuffer(data)
        return Coder(a[0], a[2 : d + 3], a[d + 3 :].reshape(d + 1, BITS), int(a[1]))


def fitted(x: np.ndarray, longest: float) -> Coder:
    """Iterative quantisation from several random starts, then the radius."""
    d = x.shape[1] + 1
    y = np.column_stack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))]) / longest
    mean = y.mean(axis=0)
    centred = y - mean
    directions = np.linalg.svd(centred.T @ centred)[0][:, : min(d, BITS)]
    flat = centred @ directions
    random = np.random.default_rng(5)
    turns = []
    while sum(t.shape[1] for t in turns) < BITS:
        turn = np.linalg.qr(random.standard_normal((flat.shape[1],) * 2))[0]
        for _ in range(ITERATIONS):
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        turns.append(directions @ turn)
    coder = Coder(longest, mean, np.concatenate(turns, axis=1)[:, :BITS])
    stored, asked = coder.codes(x, False), coder.codes(x[:PROBES], True)
    away = []
    for i in range(len(asked)):
        product = x @ x[i]
        product[i] = -np.inf
        best = np.argsort(-product)[: min(NEAREST, len(x) - 1)]
        away.append(np.bitwise_count(stored[best] ^ asked[i]).sum(axis=1, dtype=np.int64))
    if away and sum(map(len, away)):
        coder.radius = int(np.quantile(np.concatenate(away), COVER, method="higher"))
    return coder


def fit(table: DataFrame, d: int, longest: float) -> Coder:
    sample = table.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE)

    def run(found: pa.Table) -> pa.Table:
        x = np.stack([np.frombuffer(v) for v in found["v"].to_pylist()])
        return pa.table({"coder": pa.array([fitted(x, longest).packed()], pa.binary())})

    one = sample.groupBy(F.lit(1).alias("g")).applyInArrow(run, "coder binary").first()
    return Coder.of(bytes(one["coder"]), d)


def probed(asked: np.ndarray, stored: np.ndarray, radius: int) -> np.ndarray:
    """Codes within ``radius`` of each asked code, through the substring indexes."""
    near = np.zeros((len(asked), len(stored)), bool)
    a, s = asked.view(np.uint16), stored.view(np.uint16)
    for k in range(SUBSTRINGS):
        values, bucket = np.unique(s[:, k], return_inverse=True)
        near |= (np.bitwise_count(a[:, k, None] ^ values) <= radius // SUBSTRINGS)[:, bucket]
    if np.count_nonzero(near) > near.size * GATHER:  # a scan of all pairs is cheaper
        away = np.zeros(near.shape, np.uint16)
        for w in range(asked.shape[1]):
            away += np.bitwise_count(asked[:, w, None] ^ stored[:, w])
        return near & (away <= radius)
    row, at = np.nonzero(near)
    near[row, at] = distances(asked, stored, row, at) <= radius
    return near


def distances(asked: np.ndarray, stored: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Differing bits of pairs of codes."""
    away = np.zeros(len(row), np.uint16)
    for w in range(asked.shape[1]):
        away += np.bitwise_count(asked[row, w] ^ stored[at, w])
    return away


def block_search(queries, entries_, coder: Coder | None, keep: int):
    """Nearest members of one block of entries for one block of queries: (query number, id, product) arrays."""
    x = np.stack([np.frombuffer(v) for v in entries_["v"].to_pylist()])
    ids = entries_["ids"].to_pylist()
    q = np.stack([np.frombuffer(v) for v in queries["v"].to_pylist()])
    stored = coder.codes(x, False) if coder else None
    out = ([], [], [])
    for a in range(0, len(q), STEP):
        part = q[a : a + STEP]
        near = probed(coder.codes(part, True), stored, coder.radius) if coder else np.ones((len(part), len(x)), bool)
        for i in range(len(part)):
            at = np.flatnonzero(near[i])
            score = np.einsum("ij,j->i", x[at], part[i])
            if len(at) > keep:
                least = np.partition(score, len(score) - keep)[len(score) - keep]
                at, score = at[score >= least], score[score >= least]
            found = sorted((-s, m) for s, e in zip(score.tolist(), at.tolist()) for m in ids[e])[:keep]
            out[0].append(np.full(len(found), a + i))
            out[1].append([m for _, m in found])
            out[2].append([-s for s, _ in found])
    return [np.concatenate(c) if c else np.zeros(0) for c in out]


def nearest(queries: DataFrame, table: DataFrame, coder: Coder | None, keep: int) -> DataFrame:
    """``v, vec_id, score``: the nearest ``keep`` members for every query vector, from all blocks."""
    n_query, n_entry = queries.count(), table.count()
    blocks = lambda n, size: max(1, -(-n // size))
    many, wide = blocks(n_query, QUERY_BLOCK), blocks(n_entry, ENTRY_BLOCK)
    number = lambda n: F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("qb", number(many)).withColumn("eb", every(wide))
    e = table.withColumn("eb", number(wide)).withColumn("qb", every(many))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        vectors = left["v"].to_pylist()
        row, ids, score = block_search(left, right, coder, keep) if len(left) and len(right) else [np.zeros(0)] * 3
        return pa.table(
            {
                "v": pa.array([vectors[i] for i in row.astype(np.int64)], pa.binary()),
                "vec_id": pa.array(ids.astype(np.int64)),
                "score": pa.array(score.astype(np.float64)),
            }
        )

    met = q.groupBy("qb", "eb").cogroup(e.groupBy("qb", "eb")).applyInArrow(run, "v binary, vec_id long, score double")
    best = met.groupBy("v").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("all"))
    return best.select("v", F.slice("all", 1, keep).alias("found"))


def search(embeddings: DataFrame, every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each row whose id is divisible by ``every``."""
    rows = clean(embeddings)
    table = cut_lineage(entries(rows, k + 1))
    asked = cut_lineage(
        rows.where(F.col("vec_id") % every == 0).select("vec_id", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector")).mapInArrow(
            as_bytes, "query_id long, v binary"
        ).distinct()
    )
    distinct = asked.select("v").distinct()
    facts = table.agg(F.count(F.lit(1)), F.max(F.octet_length("v")), F.sum(F.size("ids"))).first()
    if not facts[0]:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    length = rows.select(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    coder = fit(table, facts[1] // 8, float(np.sqrt(length)) * (1 + 1e-12))
    found = cut_lineage(nearest(distinct, table, coder, k + 1))
    few = F.size("found") < min(k + 1, int(facts[2]))
    short = cut_lineage(distinct.join(found.where(~few), "v", "left_anti"))
    if short.first() is not None:
        found = found.where(~few).union(nearest(short, table, None, k + 1))
    listed = asked.join(found, "v").select("query_id", F.filter("found", lambda f: f["vec_id"] != F.col("query_id")).alias("found"))
    return listed.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("rank", "f")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.s")).alias("score")
    )


def as_bytes(batches):
    for b in batches:
        flat = b["vector"].flatten().to_numpy(zero_copy_only=False) + 0.0
        v = [x.tobytes() for x in flat.reshape(len(b["vec_id"]), -1)]
        yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(v, pa.binary())], ["query_id", "v"])
