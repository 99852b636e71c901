"""A corpus preparation pipeline out of the training-data operators.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and gives the next stage's docs with
the columns of `documents`, the last one the packed pieces. Nulls, repeated rows, ties (the least doc_id stays),
very long texts and empty tables are handled as the operators say; n_chars follows the text where a stage
changes it; further columns, whatever their names, pass through up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import decontam, fmdedup
from skeinwork.llm._shared import discard, stage, table
from skeinwork.llm.packing import pack_documents
from skeinwork.llm.quality import clean
from skeinwork.llm.queries import tokenizer_path
from skeinwork.llm.simhash import drop_near_duplicates


def counted(cleaned: DataFrame, docs: DataFrame) -> DataFrame:
    """The cleaned documents, with n_chars after their texts."""
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go, and documents that the rules reject; all others stay."""
    return counted(clean(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays."""
    return drop_near_duplicates(docs, "doc_id", "text", n=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of sequences that start in an earlier document, or earlier in the same one, go."""
    return counted(fmdedup.clean_texts(docs), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their places in sequences."""
    packed = pack_documents(docs, tokenizer_path())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None  # fingerprint classes, edit distance and token ids are beyond SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spent = []
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*spent)
        spent = [docs]
    return docs
