"""Corpus pipeline: quality rules, line dedup, near-dedup, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next stage's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import shared_dir, table
from larkspur.llm.line_dedup import dedup_lines
from larkspur.llm.mixing import mix
from larkspur.llm.quality_rules import quality_rules
from larkspur.llm.queries import model_bytes
from larkspur.llm.sentencepiece_codec import encode_documents
from larkspur.llm.simhash import keep_one

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; rows that repeat an id share a verdict if their texts do."""
    return quality_rules(docs, carry=True).filter("kept").select(*COLUMNS)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that ten documents or more hold; n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of texts linked at a similarity of 0.8 or more of their five-word shingles."""
    return keep_one(docs).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources uses them."""
    return mix(docs).select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; a document that is used several times has a row for each."""
    return encode_documents(docs, model_bytes())


STAGES = [
    ("quality rules", rules_stage),
    ("line dedup", lines_stage),
    ("near-dedup", near_stage),
    ("source mixing", mix_stage),
    ("sentencepiece", tokens_stage),
]

#: SQL has neither the fingerprints' hash nor the tokenizer: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = shared_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        path = os.path.join(root, str(i))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
