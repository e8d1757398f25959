"""Alignment, packing and phrases against their plain versions."""

import random
import zlib

import brute
import cases
import numpy as np
import pytest
from compare import connect
from pyspark.sql import functions as F

from fleetlag.llm import op11_alignment, op12_packing, op13_phrases, oracles

P = pytest.importorskip("public_tokenizers")
ROWS = cases.documents()
BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark, cases.with_null_id(ROWS)).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return cases.frame(spark, [])


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_alignment(docs, none):
    assert rows_of(op11_alignment.align(docs, BPE, PIECES)) == sorted(brute.alignment(ROWS, BPE, PIECES))
    assert op11_alignment.align(none, BPE, PIECES).count() == 0


def test_alignment_of_texts_that_do_not_come_back(spark):
    rows = [(1, "a ▁ b"), (2, None), (3, ""), (4, " lead"), (5, "<s> <|endoftext|> <0x41>"), (6, "ﬁ x²   \r\n"), (6, "same id"), (7, "\x00\x01")]
    found = op11_alignment.align(cases.frame(spark, rows), BPE, PIECES)
    assert rows_of(found) == sorted(brute.alignment(rows, BPE, PIECES))


def test_alignment_does_not_depend_on_batches_and_salts(docs, monkeypatch):
    want = rows_of(op11_alignment.align(docs, BPE, PIECES))
    for name, value in (("BATCH_BYTES", 3000), ("RUNS", 2), ("CHUNK", 3), ("RADIX", 7)):
        monkeypatch.setattr(op11_alignment, name, value)
    assert rows_of(op11_alignment.align(docs, BPE, PIECES)) == want


def test_pair_counts(spark):
    rows = [(1, "the cat"), (2, "the dog"), (3, "the the")]
    found = op11_alignment.pair_counts(cases.frame(spark, rows), BPE, PIECES)
    assert max(r.documents for r in found.collect()) == 3 and found.where("best").count() == found.select("a").distinct().count()


def test_runs_are_merged_as_a_sum():
    rng, press = np.random.default_rng(3), op11_alignment.press
    runs, want = [], {}
    for _ in range(9):
        keys = np.unique(rng.integers(0, 90000, 40000))
        counts = rng.integers(1, 5, len(keys))
        runs.append((press(keys), press(counts)))
        for k, c in zip(keys.tolist(), counts.tolist()):
            want[k] = want.get(k, 0) + c
    found = list(op11_alignment.merged(runs))
    keys = np.concatenate([k for k, _ in found])
    assert len(found) > 3 and (np.diff(keys) > 0).all()
    assert dict(zip(keys.tolist(), np.concatenate([c for _, c in found]).tolist())) == want


def whole(pieces):
    """Pieces by document row, in order; every sequence is gapless and holds at most its size."""
    by_sequence, by_doc = {}, {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= op12_packing.SIZE
    return by_sequence, by_doc


def test_packing(docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BPE)
    rows = {d: t for d, t in ROWS if [x for x, _ in ROWS].count(d) == 1}
    frame = docs.where(F.col("doc_id").isin(list(rows)))
    pieces = op12_packing.pack(frame, BPE, with_ids=True).collect()
    _, by_doc = whole(pieces)
    assert set(by_doc) == set(rows)
    for d, text in rows.items():
        want = [*lib.encode(text or "", add_special_tokens=False).ids, op12_packing.END]
        mine = sorted(by_doc[d], key=lambda r: r.start)
        assert [i for r in mine for i in r.ids] == want
        assert all(r.doc_tokens == len(want) and r.ids == want[r.start : r.start + r.length] for r in mine)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
    assert op12_packing.padding(op12_packing.pack(docs, BPE)).first().padded == 0
    again = op12_packing.pack(docs, BPE).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert again.where("doc_id = 1020 AND n = 2 * t").count() == 1  # a repeated row is packed twice
    assert op12_packing.pack(none, BPE).count() == 0


def test_a_document_goes_where_the_sum_of_squares_is_least():
    r = random.Random(5)
    packer = op12_packing.Packer(size=40, bound=10**6)
    for i in range(3000):
        n = r.choice([3, 7, 12, 20, 26, 33, r.randint(1, 39)])
        levels = packer.level.copy()

        def after(h):
            new = levels.copy()
            if h:
                new[h] -= 1
            if h + n < 40:
                new[h + n] += 1
            return int((new**2).sum())

        choices = [0, *[h for h in range(1, 41 - n) if levels[h]]]
        best = min(after(h) for h in choices)
        assert packer.choose(n) == max(h for h in choices if after(h) == best)
        list(packer.add(i, np.arange(n, dtype="<u4")))
        assert packer.open == packer.level.sum() == sum(map(len, packer.windows.values()))


def test_packing_holds_a_bounded_number_of_windows():
    r = random.Random(6)
    for sizes in ([1500] * 400, [2048, 5000, 1] * 50, [r.randint(1, 3000) for _ in range(500)], [1025 + i for i in range(300)]):
        packer, closed = op12_packing.Packer(bound=20), []
        for i, n in enumerate(sizes):
            closed += packer.add(i, np.full(n, i, "<u4"))
            assert packer.open <= 20
        closed += packer.close()
        assert packer.open == 0
        held = [sum(len(ids) for _, _, ids, _ in w) for w in closed]
        assert all(n == 2048 or n & (n - 1) == 0 for n in held) and sum(held) == sum(sizes)
        of = {}
        for w in closed:
            for doc, start, ids, total in w:
                assert total == sizes[doc] and (ids == doc).all()
                of.setdefault(doc, []).append((start, len(ids)))
        for doc, parts in of.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at
                at += n
            assert at == sizes[doc]


def small_corpus():
    r = random.Random(8)
    words = ["New", "york", "the", "of", "a", "é", "x-ray", "city", "hall", "big"]
    rows = []
    for i in range(300):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 30)))
        rows.append((i, text.replace("a of", "a, of") + r.choice([" new york city", "\nnew YORK", "; the  big\tx", ""]), r.choice(["en", "fr", None, "und"])))
    rows += [(400, None, "en"), (401, "", "de"), (402, "the the the the " * 40, "en"), (403, "w" * 70000, "en"), (None, "of of " * 10, "fr")]
    return rows + rows[:5]


def test_phrases(spark, none):
    rows = small_corpus()
    table = spark.createDataFrame([(d, t, x, 1, 2) for d, t, x in rows], "doc_id long, text string, lang string, rank int, a int").repartition(4)
    want = sorted(brute.phrases([(x, t) for _, t, x in rows]))
    assert want and any(len(r[2].split()) == 3 for r in want)
    assert rows_of(op13_phrases.collocations(table)) == want
    few = sorted(brute.phrases([(x, t) for _, t, x in rows], 25, 80, 7))
    assert rows_of(op13_phrases.collocations(table, 25, 80, 7, shards=2)) == few
    assert op13_phrases.collocations(none).count() == 0


def test_states_are_read_without_a_shuffle(spark):
    counting = op13_phrases.Counting(spark.createDataFrame([(t, x) for _, t, x in small_corpus()], "text string, lang string"), 2, 10)
    counting.ask_words(0)
    counting.ask_words(1)
    asks = counting.shard(0).mapInArrow(lambda b: b, "block long, lang string, words binary, codes binary")
    state = counting.table("words").groupBy("part").cogroup(asks.withColumn("part", F.lit(1)).groupBy("part"))
    plan = state.applyInArrow(lambda a, b: a, op13_phrases.STATE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the asks alone
    met = counting.met(counting.shard(1), counting.answers("words", 1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = met._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1  # the answers alone
    counting.forget()


def test_phrases_in_sql():
    con = connect(cases.SF)
    rows = con.sql("SELECT lang, text FROM documents").fetchall()
    assert sorted(con.sql(oracles.PHRASES).fetchall()) == sorted(brute.phrases(rows))
