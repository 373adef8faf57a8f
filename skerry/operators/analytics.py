"""Query-log analytics over query_log(id, api_key, query, result_count, ts)."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id long, api_key string, query string, result_count long, ts double"


class QueryLog:
    """An append-only log in a folder of Parquet files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def record(self, api_key: str, query: str, result_count: int, ts: float | None = None) -> None:
        now = time.time() if ts is None else ts
        self.spark.createDataFrame([(time.time_ns(), api_key, query, result_count, float(now))], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def history(log: DataFrame, api_key: str, limit: int = 50) -> DataFrame:
    """The key's queries, newest first; of the same time the later id first."""
    return log.where(F.col("api_key") == api_key).orderBy(F.desc("ts"), F.desc("id")).limit(limit).select("query", "result_count", "ts")


def total_queries(log: DataFrame, api_key: str | None = None) -> DataFrame:
    """One row (total)."""
    return (log if api_key is None else log.where(F.col("api_key") == api_key)).agg(F.count("*").alias("total"))


def top_queries(log: DataFrame, limit: int = 10) -> DataFrame:
    return log.groupBy("query").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "query").limit(limit)


def queries_per_user(log: DataFrame) -> DataFrame:
    return log.groupBy("api_key").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "api_key")


def average_result_count(log: DataFrame) -> DataFrame:
    """One row (average), 0 for an empty log."""
    return log.agg(F.coalesce(F.avg("result_count"), F.lit(0.0)).alias("average"))
