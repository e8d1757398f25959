"""The registered queries of the operators, over whole tables, and their SQL."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetlag.llm import (
    op1_neighbours,
    op2_jaccard,
    op3_license,
    op4_bpe,
    op5_contamination,
    op6_suffix_array,
    op7_quality,
    op8_substrings,
    op9_suffix_tree,
    op10_pii,
    op11_alignment,
    op12_packing,
    op13_phrases,
    oracles,
)
from fleetlag.llm.texts import bounded_batches, documents


def op4_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return op4_bpe.digests(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))


def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return op3_license.scan(documents(spark, sf))


def op7_quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    return op7_quality.score(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


def op2_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return op2_jaccard.join(documents(spark, sf))


def op5_contamination_index(spark: SparkSession, sf: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    return op5_contamination.contamination(documents(spark, sf), benchmark)


def op6_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return op6_suffix_array.dedup(documents(spark, sf))


def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return op8_substrings.dedup(documents(spark, sf))


def op10_pii_spans(spark: SparkSession, sf: str) -> DataFrame:
    return op10_pii.find(documents(spark, sf))


def op1_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    bounded_batches(spark)
    return op1_neighbours.search(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op9_suffix_tree_scores(spark: SparkSession, sf: str) -> DataFrame:
    return op9_suffix_tree.scores(documents(spark, sf))


def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return op11_alignment.align(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_window_packing(spark: SparkSession, sf: str) -> DataFrame:
    return op12_packing.pack(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))


def op13_phrase_mining(spark: SparkSession, sf: str) -> DataFrame:
    return op13_phrases.collocations(documents(spark, sf, "lang", "text"))


QUERIES = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op9_suffix_tree_scores": op9_suffix_tree_scores,
    "op2_jaccard_join": op2_jaccard_join,
    "op5_contamination_index": op5_contamination_index,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op10_pii_spans": op10_pii_spans,
    "op3_license_scan": op3_license_scan,
    "op7_quality_scores": op7_quality_scores,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op11_token_alignment": op11_token_alignment,
    "op12_window_packing": op12_window_packing,
    "op13_phrase_mining": op13_phrase_mining,
}
ORACLES = {
    "op2_jaccard_join": oracles.JACCARD,
    "op5_contamination_index": oracles.CONTAMINATION,
    "op8_substring_dedup": oracles.SUBSTRINGS,
    "op13_phrase_mining": oracles.PHRASES,
}
