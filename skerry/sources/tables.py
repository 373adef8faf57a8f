"""Saved indexes."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..operators.index import Index
from .cut import hadoop_path

VERSION = 1
META = "meta.json"  # without the leading underscore that Spark's readers skip
TABLES = ("documents", "postings", "doc_stats")


def index_exists(spark: SparkSession, path: str) -> bool:
    files, at = hadoop_path(spark, f"{path}/{META}")
    return files.exists(at)


def save_index(index: Index, path: str) -> None:
    """Write all tables, replacing what is there.

    Postings are dealt by term, in one pass (dealing by ranges would invert all documents twice), and sorted within files, so that a
    term's lookup reads few row groups; partitions that a frequent term makes too large are split at run time.
    """
    spark = index.postings.sparkSession
    index.postings.hint("rebalance", "term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    index.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")
    index.documents.write.mode("overwrite").parquet(f"{path}/documents")
    files, at = hadoop_path(spark, f"{path}/{META}")
    out = files.create(at, True)
    out.write(bytearray(json.dumps({"format": "skerry-index", "version": VERSION}).encode()))
    out.close()


def load_index(spark: SparkSession, path: str) -> Index:
    """A saved index; a missing one, another format or version is an error. Lookups by term are pushed down to the files."""
    if not index_exists(spark, path):
        raise FileNotFoundError(f"no index at {path}")
    meta = json.loads(spark.read.text(f"{path}/{META}", wholetext=True).first()[0])
    if meta.get("format") != "skerry-index" or meta.get("version") != VERSION:
        raise ValueError(f"not an index of version {VERSION}: {meta}")
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in TABLES))


def append_documents(more: Index, path: str) -> None:
    """Add documents to a saved index by appending files; ids that it has already are an error."""
    spark = more.postings.sparkSession
    held = load_index(spark, path)
    if (row := more.doc_stats.join(held.doc_stats.select("doc_id"), "doc_id", "left_semi").first()) is not None:
        raise ValueError(f"document {row['doc_id']} is indexed already")
    more.postings.sortWithinPartitions("term", "doc_id").write.mode("append").parquet(f"{path}/postings")
    more.doc_stats.write.mode("append").parquet(f"{path}/doc_stats")
    more.documents.write.mode("append").parquet(f"{path}/documents")
