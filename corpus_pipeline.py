"""The corpus pipeline: from documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return documents with all their columns,
whatever further columns there are and however these are called. A stage works on all rows that the one before kept, whole
texts however long, and an empty table gives an empty one. run() writes what a stage returns to the shared folder and hands it to the next, as a cluster would between jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.llm.common import materialise
from skerry.llm.near_duplicates import drop_near_duplicates
from skerry.llm.packing import pack
from skerry.llm.quality import keep_good
from skerry.llm.repeated_spans import drop_repeated
from skerry.llm.toxicity import keep_harmless


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, with their site's posterior, rejects go (operator 7).

    A null or empty text is judged as an empty one, a null source or lang is a site of its own, repeated rows are judged alike;
    without labels nothing goes.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), host="source", path="lang")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with significant toxic passages go (operator 8).

    A null or empty text has no passage; repeated rows are judged alike; without labels of both kinds every document has the base rate.
    """
    return keep_harmless(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more (operator 3).

    The one with the least doc_id stays, rows without a doc_id only where no other is in their group. Texts without words are
    linked with nothing; a row repeated with its doc_id and text stays once.
    """
    return drop_near_duplicates(docs, size=5, percent=80)


def repeated_span_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes, shorter than fifty words, that start more than once go from the texts; documents left without text go (operator 4).

    All places of such a string go, the first included, so rows that repeat a text of 200 bytes go wholly; a null text, or one without
    such strings, stays as it is.
    """
    return drop_repeated(docs, span=200)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids (operator 1): a row for each piece. A null or empty text is the separator alone."""
    return pack(docs, window=1024, tokenizer="byte_bpe_50k.json", separator=0)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeated spans", repeated_span_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the trained filters nor the packing plan; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
