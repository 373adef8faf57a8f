"""What a query's plan is and how long it takes."""

from __future__ import annotations

import re
import time
from collections import Counter

from pyspark.sql import DataFrame, SparkSession


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The text that explain() prints."""
    spark = df.sparkSession
    return spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def operator_counts(df: DataFrame) -> Counter:
    """How often each physical operator stands in the plan: exchanges, joins, sorts, Python."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return Counter(re.findall(r"\b(\w*(?:Exchange|Join|Sort|Aggregate|Window|Scan|Python|InArrow|InPandas|TakeOrderedAndProject|Generate))\b", text))


def run_time(df: DataFrame) -> float:
    """Seconds to compute all rows, written nowhere."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def slowest(queries: dict[str, DataFrame], limit: int = 10) -> DataFrame:
    """(query, seconds), the slowest first."""
    rows = sorted(((name, run_time(df)) for name, df in queries.items()), key=lambda r: -r[1])[:limit]
    return SparkSession.active().createDataFrame(rows, "query string, seconds double")
