"""Retrieval quality: precision, recall, DCG and NDCG at k, and their means by method."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def relevant(qrels: DataFrame, least: int = 1) -> DataFrame:
    """The judgments (query, doc_id, grade) of at least this grade."""
    return qrels.where(F.col("grade") >= least)


def metrics_at_k(ranked: DataFrame, qrels: DataFrame, k: int = 5, keys: tuple[str, ...] = ("query",)) -> DataFrame:
    """keys, precision, recall, dcg, ndcg of ranked (keys, doc_id, rank from 1) against qrels (query, doc_id, grade).

    Precision divides by what was returned, at most k; a recall without relevant documents and an NDCG without gain are 0.
    """
    best = Window.partitionBy("query").orderBy(F.desc("grade"))
    ideal = qrels.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    ideal = ideal.groupBy("query").agg(F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("place") + 1)).alias("ideal"))
    total = relevant(qrels).groupBy("query").agg(F.count("*").alias("total"))
    gains = ranked.where(F.col("rank") <= k).join(qrels, ["query", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    got = gains.groupBy(*keys).agg(
        F.count("*").alias("returned"),
        F.sum((F.col("grade") >= 1).cast("int")).alias("hits"),
        F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    joined = got.join(total, "query", "left").join(ideal, "query", "left")
    return joined.select(
        *keys,
        (F.col("hits") / F.col("returned")).alias("precision"),
        F.coalesce(F.col("hits") / F.col("total"), F.lit(0.0)).alias("recall"),
        F.col("dcg"),
        F.when(F.coalesce("ideal", F.lit(0.0)) > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"),
    )


def compare(metrics: DataFrame) -> DataFrame:
    """Means by method."""
    return metrics.groupBy("method").agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "ndcg")))


def latency_report(latencies: DataFrame, value: str = "seconds") -> DataFrame:
    """mean, p50, p95, p99 (by place in the sorted list, not interpolated) and max of a column of measured seconds; all null without any.

    The column is numbered in order by ranges; the rows at the places asked for are picked by one aggregation.
    """
    rows = numbered(latencies.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL"), ["v"], "place", first=0)
    total = rows.count()
    at = lambda q: F.max(F.when(F.col("place") == int(total * q), F.col("v")))
    return rows.agg(F.avg("v").alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("v").alias("max"))
