"""The queries op1 to op13 of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from notemill.llm import divergence, prefix_trie
from notemill.session import ship

#: Where the vocabularies are; operators take a file's path as their parameter.
TOKENIZERS = public_tokenizers.path("").rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notemill.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), 40)


def op5_collision_counting_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notemill.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op6_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notemill.llm.pieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_minimum_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notemill.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_ftrl_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notemill.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op3_line_block_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notemill.llm.html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op4_bit_sliced_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notemill.llm.simhash_dedup import dedup_documents

    return dedup_documents(table(spark, sf_dir, "documents"))


def op8_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notemill.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notemill.llm.secrets import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))


def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notemill.llm.quality import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_systolic_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notemill.llm.divergence import audit_documents

    return audit_documents(table(spark, sf_dir, "documents"))


def op12_prefix_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notemill.llm.prefix_trie import conversation_nodes

    return conversation_nodes(table(spark, sf_dir, "conversations"))


def op13_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notemill.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hash_tree_sharding,
        op2_ftrl_language_id,
        op3_line_block_extraction,
        op4_bit_sliced_simhash_dedup,
        op5_collision_counting_neighbours,
        op6_sampled_pieces,
        op7_minimum_bin_slack_packing,
        op8_simhash_fingerprints,
        op9_forest_secret_scan,
        op10_subword_quality,
        op11_systolic_divergence,
        op12_prefix_ownership,
        op13_transducer_bpe,
    )
}

#: Queries that SQL can express; the others are held against brute force in tests/llm.
ORACLES: dict[str, str] = {"op11_systolic_divergence": divergence.SQL, "op12_prefix_ownership": prefix_trie.SQL}
