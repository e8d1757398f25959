"""The pipeline's stages against plain versions, each on its own input."""

import brute
import cases
import corpus_pipeline as pipeline

SF = cases.SF


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in pipeline.STAGES:
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if name != "tokens":
            assert after.columns == docs.columns
        kept = {r.doc_id for r in after.collect()}
        if name == "quality":
            assert kept and kept < {d for d, _ in rows}
        if name == "near_duplicates":
            assert kept == {c for _, _, c in brute.jaccard(rows)}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert kept == {r[0] for r in brute.contamination(rows, items) if not r[-1]}
        if name == "private_data":
            texts = {r.doc_id: r.text for r in after.collect()}
            assert set(texts) == {d for d, _ in rows}
            base = {r[0]: r[1:5] for r in brute.personal(rows)}
            clean = {d: t for d, t in rows if not sum(base[d]) and "@" not in t and not any(c.isdigit() for c in t)}
            assert all(texts[d] == t for d, t in clean.items())
            assert all(not sum(r[1:5]) for r in brute.personal(list(texts.items())))
        if name == "tokens":
            assert {r.doc_id: r.decoded_sha256 for r in after.collect()} == {d: brute.sha(t) for d, t in rows}
        before = after


def test_run(spark):
    found = pipeline.run(spark, SF)
    assert found.count() > 0 and {"doc_id", "n_tokens", "ids_sha256"} <= set(found.columns)


def test_near_duplicates_keep_clashing_columns_and_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e f", "mine", 5), (1, "a b c d e f", "mine", 5), (2, "a b c d e f", "keep-me", 6), (3, None, "x", 0), (4, "", "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string, component_id int")
    found = pipeline.near_duplicates(spark, docs, SF)
    assert found.columns == docs.columns
    assert sorted(tuple(r) for r in found.collect()) == [rows[0], rows[3], rows[4]]
    assert pipeline.near_duplicates(spark, docs.limit(0), SF).count() == 0
