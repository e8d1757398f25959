"""Every operator against its plain version, over a fixture of hard cases, and over empty tables."""

import math
import os

import brute
import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlag.llm import (
    exchange, op1_neighbours, op2_jaccard, op3_license, op4_bpe, op5_contamination, op6_suffix_array, op7_quality, op8_substrings,
    op9_suffix_tree, op10_pii,
)
from fleetlag.llm.components import components
from fleetlag.llm.texts import part_count
from fleetlag.session import cut_lineage, shared_dir

P = pytest.importorskip("public_tokenizers")
ROWS = cases.documents()


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark, cases.with_null_id(ROWS)).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return cases.frame(spark, [])


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def got(df, names):
    return sorted((tuple(r[n] for n in names.split()) for r in df.collect()), key=key)


def same(df, names, want):
    assert got(df, names) == sorted(want, key=key)


def test_jaccard(docs, none):
    names = "doc_id n_shingles component_id"
    same(op2_jaccard.join(docs), names, brute.jaccard(ROWS))
    same(op2_jaccard.join(none), names, [])


def test_jaccard_keeps_a_link_that_leaders_miss(spark):
    # a chain: neighbours link, ends do not
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[12 * i : 12 * i + 120])) for i in range(20)]
    same(op2_jaccard.join(cases.frame(spark, rows)), "doc_id n_shingles component_id", brute.jaccard(rows))


def test_exchange_answers_do_not_travel_by_document_and_part(spark):
    parts, keys = part_count(spark), np.random.default_rng(5).integers(0, 2**64, (40, 30), dtype=np.uint64)
    rows = [(d, d % 3, keys[d % 40]) for d in range(400)]  # every set ten times
    sets = spark.createDataFrame([(d, h, k.tobytes()) for d, h, k in rows], "doc_id long, text_hash long, keys binary")

    def ask(batches):
        for b in batches:
            found = [np.frombuffer(k, np.uint64) for k in b["keys"].to_pylist()]
            yield exchange.packed(*op2_jaccard.ids_of(b), [len(k) for k in found], np.concatenate(found), parts)

    answered = exchange.answers(sets.mapInArrow(ask, exchange.PACKED), lambda k, d, r: d % 2 * (1 + k % np.uint64(7)).astype(np.int64))
    assert answered.count() <= parts**2 < 200 * parts
    found = {(r.doc_id, r.text_hash): (r.held, exchange.unpacked(keys[r.doc_id % 40], parts, r.flags)) for r in exchange.by_document(answered).collect()}
    assert set(found) == {(d, h) for d, h, _ in rows if d % 2}
    low = np.uint64(2**40 - 1)
    for (d, _), (held, flags) in found.items():
        assert held == 30 and (flags == 1 + (keys[d % 40] & low) % np.uint64(7)).all()


def test_license(docs, none):
    names = "doc_id n_words n_base first_word last_word base_labels"
    found = op3_license.scan(docs)
    same(found, names, brute.license_base(ROWS, op3_license.PHRASES))
    by_doc = {r.doc_id: r for r in found.collect()}
    assert by_doc[1403].labels == "apache-2,cc-by-nc,mit" and by_doc[1403].score == 1.0
    assert by_doc[1404].labels == "gpl-3" and by_doc[1404].base_labels == ""
    same(op3_license.scan(none), names, [])


def test_license_blocks_are_complete():
    words = b"x y licensed z under the apache q license version 2 0 w".split()
    t = op3_license.Template("l", "licensed under the apache license version 2 0", {})
    best = max(len(t.words & set(words[i : i + t.block])) for i in range(len(words)))
    assert t.best(words)[0] == best


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = []
    for d, t in ROWS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(back)))
    same(op4_bpe.digests(docs, path), "doc_id n_tokens ids_sha256 decoded_sha256", want)
    back = op4_bpe.decode(op4_bpe.encode(docs, path), path)
    same(back, "doc_id text", [(d, t or "") for d, t in ROWS])
    same(op4_bpe.digests(none, path), "doc_id", [])


def test_contamination(spark, docs, none):
    items = cases.benchmark()
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, words string, start int")
    names = "doc_id n_words n_hit n_items items_sha256 contaminated"
    want = brute.contamination(ROWS, [(i, t) for i, t in items if i is not None])
    same(op5_contamination.contamination(docs, table), names, want)
    same(op5_contamination.contamination(none, table), names, [])
    assert op5_contamination.contamination(docs, table.limit(0)).where("n_hit > 0").count() == 0


def test_contamination_uses_no_broadcast_beyond_its_bound(spark, docs, monkeypatch):
    items = cases.benchmark()
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(op5_contamination, "BROADCAST_BYTES", 0)
    want = brute.contamination(ROWS, [(i, t) for i, t in items if i is not None])
    same(op5_contamination.contamination(docs, table), "doc_id n_words n_hit n_items items_sha256 contaminated", want)


def test_proximity(spark):
    docs = cases.frame(spark, [(1, "alpha x beta y gamma"), (2, "alpha " + "z " * 60 + "beta gamma"), (3, "gamma beta alpha")])
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    found = op5_contamination.proximity(docs, items, terms=3, within=20)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, "7"), (3, "7")}


def test_suffix_array(docs, none):
    names = "doc_id n_bytes n_removed n_spans kept_sha256"
    same(op6_suffix_array.dedup(docs), names, brute.byte_dedup(ROWS))
    same(op6_suffix_array.dedup(none), names, [])


def test_induced_order_equals_a_plain_sort():
    rng = np.random.default_rng(1)
    for letters, n in ((1, 200), (2, 500), (3, 2000), (20, 3000)):
        text = rng.integers(97, 97 + letters, n).astype(np.uint8)
        small = lambda: op6_suffix_array.BucketQueue(limit=100)  # noqa: E731  spills
        raw = text.tobytes()
        order = op6_suffix_array.suffix_order(text, small).tolist()
        assert sorted(order) == list(range(n))
        first = [raw[i : i + op6_suffix_array.DEPTH] for i in order]
        assert all(a.ljust(64, b"\0") <= b.ljust(64, b"\0") for a, b in zip(first, first[1:]))


def test_names_are_sorted_within_their_groups():
    rng = np.random.default_rng(4)
    group, values = np.sort(rng.integers(0, 300, 2000)), rng.integers(0, 40, 2000).astype(np.uint64)
    order = op6_suffix_array.by_group(group, values)
    assert sorted(order.tolist()) == list(range(2000))
    assert list(zip(group[order], values[order])) == sorted(zip(group, values))


def test_substrings(docs, none):
    names = "doc_id n_words n_removed kept_sha256"
    same(op8_substrings.dedup(docs), names, brute.word_dedup(ROWS))
    same(op8_substrings.dedup(none), names, [])


def test_deep_suffixes_do_not_depend_on_the_group_size():
    from fleetlag.llm.texts import prefix_sums

    words = np.random.default_rng(2).integers(1, 3, 3000).astype(np.uint64)
    sums, at = prefix_sums(words), np.arange(2900)
    many = {}
    for i in at:
        many.setdefault(tuple(words[i : i + 12]), []).append(i)
    want = [len(many[tuple(words[i : i + 12])]) > 1 for i in at]
    for group in (1, 50, 10**6):
        assert op8_substrings.deep_suffixes(sums, at, 12, group).tolist() == want


def test_language_model(docs, none):
    names = "doc_id held_out n_tokens n_known train_tokens"
    found = op9_suffix_tree.scores(docs).collect()
    want = sorted(brute.unigram_scores(ROWS), key=key)
    assert sorted((tuple(r[n] for n in names.split()) for r in found), key=key) == [r[:5] for r in want]
    by = lambda rows: sorted((r[0], round(r[-1], 6)) for r in rows)
    assert by([(r.doc_id, r.base_score) for r in found]) == by(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    trained = [r for r in found if not r.held_out]
    assert sum(r.score for r in trained) > sum(r.base_score for r in trained)
    assert op9_suffix_tree.scores(none).count() == 0


def test_language_model_is_a_distribution(spark):
    """All continuations of each context sum to one."""
    rows = [(i, "a b a b c a b a b d " * (3 + i)) for i in range(20)]
    train = cases.frame(spark, rows)

    def keys_of(text):
        import pyarrow as pa

        return next(op9_suffix_tree.token_keys(pa.array([text])))[2:]

    def count(batches):
        for b in batches:
            found = [np.unique(k, return_counts=True) for _, _, k, _ in op9_suffix_tree.token_keys(b["text"])]
            yield op9_suffix_tree.count_batch([k for k, _ in found], [c for _, c in found], 4)

    table = op9_suffix_tree.summed(train.select("text").mapInArrow(count, op9_suffix_tree.COUNTS))
    tree = op9_suffix_tree.grow(train, table)
    assert any(c.any() for c in tree.context)
    for context in ("a", "a b", "b a", "x", "b c"):
        total = 0.0
        for word in "abcd":
            score, outside = op9_suffix_tree.local_scores(tree, *keys_of(f"{context} {word}"))
            assert not outside[-2]
            total += 10 ** score[-2]
        end, _ = op9_suffix_tree.local_scores(tree, *keys_of(context))
        rest, outside = op9_suffix_tree.local_scores(tree, *keys_of(f"{context} unseen"))
        total += 10 ** end[-1] + 10 ** rest[-2] / (tree.total + tree.distinct + 1)
        assert abs(total - 1) < 1e-9


def test_language_model_scores_do_not_depend_on_the_frequent_part(docs, monkeypatch):
    want = {r.doc_id: r.score for r in op9_suffix_tree.scores(docs.dropDuplicates(["doc_id"])).collect()}
    monkeypatch.setattr(op9_suffix_tree, "SHARE", 0.02)
    found = {r.doc_id: r.score for r in op9_suffix_tree.scores(docs.dropDuplicates(["doc_id"])).collect()}
    assert found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-6 for k in want)


def test_language_model_keeps_only_the_tables_that_are_read(spark, docs):
    train = docs.where("doc_id IS NOT NULL")
    counts = lambda batches: (op9_suffix_tree.count_batch(*zip(*[np.unique(k, return_counts=True) for *_, k, _ in op9_suffix_tree.token_keys(b["text"])]), 8) for b in batches if b.num_rows)
    table = cut_lineage(op9_suffix_tree.summed(train.select("text").mapInArrow(counts, op9_suffix_tree.COUNTS)))
    before = set(os.listdir(shared_dir(spark)))
    tree = op9_suffix_tree.grow(train, table)
    left = set(os.listdir(shared_dir(spark))) - before
    assert {os.path.basename(os.path.dirname(f)) for f in tree.table.inputFiles()} == left


def test_language_model_keeps_a_sequence_when_unrelated_text_is_added(spark):
    import zlib

    trained = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != op9_suffix_tree.HELD_OUT]
    held = next(i for i in range(60) if i not in trained)
    rows = [(i, "alpha beta gamma delta") for i in trained[:5]] + [(i, "beta alpha delta") for i in trained[5:9]]
    rows.append((held, "alpha beta gamma"))
    phrases = cases.frame(spark, rows).select("doc_id", "text")

    def gain(rows_of_filler):
        filler = spark.range(100, 100 + rows_of_filler).selectExpr("id AS doc_id", "repeat('lorem ipsum ', 100000) AS text")
        r = op9_suffix_tree.scores(phrases.unionByName(filler)).where(F.col("doc_id") == held).first()
        return r.score - r.base_score, r.train_tokens

    (small, _), (large, tokens) = gain(1), gain(20)
    assert op9_suffix_tree.SHARE * tokens > 5  # the phrase is not in the frequent part
    assert 0 < small < large  # its contexts hold, and words that are rarer gain more by them


def test_personal_data(spark, docs, none):
    names = "doc_id n_email n_ip n_card n_phone base_sha256"
    same(op10_pii.find(docs), names, brute.personal(ROWS))
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weights = op10_pii.train(op10_pii.training_regions(given))
    found = op10_pii.find(docs, weights)
    same(found, names, brute.personal(ROWS))
    spans = {r.doc_id: r.spans for r in found.collect()}
    assert spans[1401].count("phone:") == 2 and "secret:" in spans[1402]
    text = dict(ROWS)[1402]
    masked = {r.doc_id: r.text for r in op10_pii.mask(docs, weights).collect()}
    assert "04dbebab" not in masked[1402] and masked[1302] == dict(ROWS)[1302] and len(text) > len(masked[1402])
    same(op10_pii.find(none), names, [])


def test_spans_of_the_field_that_meet_no_base_span(monkeypatch):
    rng = np.random.default_rng(12)
    for _ in range(50):
        spans = lambda n: [("email", int(a), int(a + d)) for a, d in zip(rng.integers(0, 300, n), rng.integers(1, 30, n))]
        base, field = spans(int(rng.integers(0, 12))), spans(12)
        monkeypatch.setattr(op10_pii, "field_spans", lambda text, weights: field)
        want = [x for x in field if not any(a < x[2] and b > x[1] for _, a, b in base)]
        assert sorted(op10_pii.all_spans("", base, None)) == sorted([*base, *want])


def test_spans_of_a_very_long_text_take_no_square_time(monkeypatch):
    import time

    base = [("email", 10 * i, 10 * i + 4) for i in range(200_000)]
    monkeypatch.setattr(op10_pii, "field_spans", lambda text, weights: [("phone", 10 * i + 5, 10 * i + 9) for i in range(200_000)])
    start = time.process_time()
    assert len(op10_pii.all_spans("", base, None)) == 400_000
    assert time.process_time() - start < 20


def test_segment_probabilities_sum_to_one():
    scores = np.random.default_rng(4).standard_normal((7, op10_pii.LONGEST, len(op10_pii.LABELS)))
    scores[:, 1:, 0] = -np.inf
    p = op10_pii.expected(scores)
    covering = sum(p[i, n].sum() for i in range(7) for n in range(op10_pii.LONGEST) if i <= 3 <= i + n)
    assert abs(covering - 1) < 1e-9


def test_quality(spark, docs, none):
    labels = spark.createDataFrame(
        [(d, int(i % 7 > 0), 0) for i, (d, _) in enumerate(ROWS)] + [(None, 1, 0), (1302, None, 0), (99999, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    found = op7_quality.score(docs, labels).collect()
    assert sorted(r.doc_id for r in found) == sorted(d for d, _ in ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (brute.fold(r.doc_id, 5) == 0) for r in found)
    assert op7_quality.score(none, labels).count() == 0
    assert op7_quality.score(docs, labels.limit(0)).count() == len(ROWS)
    assert op7_quality.accepted(docs, labels).columns == docs.columns


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = op7_quality.score(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    right = found.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.97


def neighbours(rows, every=20, k=20):
    good = [(i, np.array(v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            out[i] = sorted((-float(np.sum(v * w)), j) for j, w in good if j != i)[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(16) * (1 + i % 3)]) for i in range(600)]
    rows += [(600 + i, rows[0][1]) for i in range(60)]
    rows += [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [1.0] * 15 + [None]), (780, [float("inf")] * 16)]
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, v string")
    want = neighbours([r for r in rows if r[0] < 700])
    found = {}
    for r in op1_neighbours.search(table).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(want)
    hit = 0
    for q, near in found.items():
        assert [r for r, _, _ in sorted(near)] == list(range(1, 21))
        assert [(-s, i) for _, i, s in sorted(near)] == sorted((-s, i) for _, i, s in near)
        hit += len({i for _, i, _ in near} & {i for _, i in want[q]})
    assert hit >= 0.9 * 20 * len(want)
    assert op1_neighbours.search(table.limit(0)).count() == 0


def test_neighbours_compare_whole_codes_of_probed_pairs_only(monkeypatch):
    r = np.random.default_rng(6)
    stored = r.integers(0, 2**64, (300, 4), dtype=np.uint64)
    asked = stored[:5] ^ np.uint64(1)
    plain = np.bitwise_count(asked[:, None] ^ stored).sum(axis=2)
    seen = []
    real = op1_neighbours.distances
    monkeypatch.setattr(op1_neighbours, "distances", lambda a, s, row, at: seen.append(len(row)) or real(a, s, row, at))
    for radius in (3, 20, 40, 110, 256):
        assert (op1_neighbours.probed(asked, stored, radius) == (plain <= radius)).all()
    assert 5 <= seen[0] < asked.shape[0] * len(stored) / 16  # a narrow radius leaves few pairs


def test_neighbours_of_few_rows(spark):
    rows = [(20 * i, [1.0, float(i)]) for i in range(4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert op1_neighbours.search(table).count() == 12


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[100] == found[95] == 90


def test_jaccard_of_two_very_long_near_copies(spark):
    r = np.random.default_rng(11)
    words = [f"w{x}" for x in r.integers(0, 50_000, 100_000)]
    other = list(words)
    for i in r.integers(0, 100_000, 2_000).tolist():
        other[i] = "new"
    far = list(words)
    for i in range(0, 100_000, 12):
        far[i] = "far"
    rows = [(7, " ".join(words)), (8, " ".join(other)), (9, " ".join(far)), (10, "short text of six words here")]
    same(op2_jaccard.join(cases.frame(spark, rows)), "doc_id n_shingles component_id", brute.jaccard(rows))


def test_jaccard_pairs_are_formed_from_small_rows(spark):
    tokens = np.arange(40_000, dtype=np.uint64)
    sets = spark.createDataFrame(
        [(i, 40_000, 40_000, i, tokens.tobytes(), np.ones(40_000, np.uint8).tobytes()) for i in (1, 2)],
        "node long, n long, held long, component long, tokens binary, classes binary",
    )
    prefix = op2_jaccard.prefixes(sets)
    assert prefix.count() == 2 * 10_001 and all(kind == "bigint" for _, kind in prefix.dtypes)
    assert [tuple(r) for r in op2_jaccard.cross_pairs(sets).collect()] == [(1, 2)]
