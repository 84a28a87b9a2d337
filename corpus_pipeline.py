"""From raw documents to packed sequences: five stages, each on all that the one before it kept.

In every stage null and empty texts, texts of any length, repeated rows, rows without
doc_id, empty tables and further columns are allowed; each says what becomes of them.
Every stage but the last returns the columns of its input. A stage's input is what the
one before wrote; run() writes each stage's rows as Parquet below spark.checkpoint.dir
(a temporary folder where that is unset) and reads them again, which also cuts the
lineage: a lost executor costs the tasks of one stage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from notemill.llm import language, near_copies, packing, quality, secrets
from notemill.llm.queries import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents predicted to be of label 0. A null text is scored as the empty one; equal texts have equal scores, so repeated rows stay or go together."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without a recognisable language: null texts and those without a letter go; repeated rows stay or go together."""
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard index 0.8 or more) the document with the smallest doc_id stays.

    Texts without words are copies of each other and of nothing else. Rows that repeat a kept doc_id, and those without one, all stay.
    """
    return near_copies.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets; no document goes. Null and empty texts stay as they are, and repeated rows are masked alike."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. A null or empty text is its end token; repeated rows are packed as often as they occur."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: SQL can express neither the trained models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="corpus-")
    folder = f"{shared}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return docs
