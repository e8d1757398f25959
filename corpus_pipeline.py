"""A training-corpus pipeline: every stage works on the documents that its predecessor kept.

1. quality: documents that the classifier rejects go (predicted 0).
2. near_duplicates: of each group of linked documents the one with the smallest doc_id stays, once.
3. decontamination: documents that hold test passages by the contamination rule go.
4. private_data: every personal span is replaced by its kind in brackets; all documents stay.
5. tokens: every text is encoded and decoded; the rows of the last stage are its ids and digests.

Texts that a stage does not change keep all columns of ``documents``; ``n_chars`` follows a changed text. Documents
without doc_id leave at the first stage. ``ORACLE_SQL`` is None: the classifier, the field and the byte-pair
encoder have no SQL form; ``tests/llm/test_pipeline.py`` holds the stages against plain versions.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlag.llm import op2_jaccard, op4_bpe, op5_contamination, op7_quality, op10_pii
from fleetlag.llm.texts import bounded_batches
from fleetlag.session import scratch_path, ship_code

VOCABULARY = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    bounded_batches(spark)
    return op7_quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links."""
    bounded_batches(spark)
    kept = op2_jaccard.join(docs).where("doc_id = component_id").select("doc_id").distinct()
    mark = _unused("text_hash", docs)
    hashed = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    first = hashed.groupBy("doc_id").agg(F.min(mark).alias(mark)).join(kept, "doc_id", "left_semi")
    return hashed.join(first, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark]).select(*docs.columns)


def _unused(name: str, docs: DataFrame) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark. Of several rows of one doc_id all go if one is."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = op5_contamination.contamination(docs, benchmark).where("contaminated").select("doc_id").distinct()
    return docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal spans replaced by their kind."""
    bounded_batches(spark)
    return op10_pii.mask(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digests of ids and decoded text."""
    bounded_batches(spark)
    return op4_bpe.digests(docs, public_tokenizers.path(VOCABULARY), with_ids=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    ship_code()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
