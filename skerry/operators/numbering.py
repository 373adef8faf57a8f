"""Row numbers in a global order without a single sorting task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.cut import table_cut


def numbered(df: DataFrame, order: list, name: str, first: int = 1) -> DataFrame:
    """df with `name`: 1, 2, ... in the order of the given columns or sort expressions.

    Rows are dealt by ranges of the order and sorted within partitions; how many rows each partition has, one number a
    partition, is all that the driver gathers, and each row's number is its place plus its partition's offset.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = rows.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    rows = table_cut(rows, "numbered")
    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], first
    for part, n in counts:
        offsets.append((part, total))
        total += n
    starts = df.sparkSession.createDataFrame(offsets, "_part int, _start long")
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")
