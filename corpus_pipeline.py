"""Corpus pipeline: quality classifier, near-duplicates, decontamination, secrets, tokens.

Every stage but the last returns the columns of documents; each is written as Parquet and read again
as the next one's documents.

In every stage a null text is an empty one, whole texts are read whatever their length, repeated rows
are rows of their own (near-dedup keeps one), an empty table stays empty, and columns may have clashing names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, quality, secrets, simhash
from tidemark.llm.common import documents, materialise


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws, as many as the classifier's threshold lets through; all, where there are no labels of both kinds."""
    return quality.drawn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity of 0.8 or more): the least id, a null
    id being the largest. A group is all that such pairs connect, so its ends may differ more."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; those that are mostly such passages go. Texts without
    words, and all where the benchmark is empty, stay as they are."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark; overlapping ones by one. Null texts stay null."""
    return secrets.redact(docs, secrets.vocabulary_words([public_tokenizers.path(f) for f in secrets.VOCABULARIES]))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: doc_id, n_tokens, ids_sha256, decoded_sha256; none for a null or empty text."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("BPE encoding and decoding", tokens),
]

#: The classifier, the fingerprints and the tokenizer have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
