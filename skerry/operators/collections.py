"""Ordered and keyed collections as DataFrame operations: heaps, priority queues, keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered


def heap_order(values: DataFrame, column: str = "value", largest: bool = False, limit: int | None = None) -> DataFrame:
    """The values as a heap gives them out; with a limit each task keeps that many only."""
    ordered = values.orderBy(F.desc(column) if largest else F.asc(column))
    return ordered if limit is None else ordered.limit(limit)


def heap_top(values: DataFrame, column: str = "value", largest: bool = False):
    """The value at the top; an empty heap is an error."""
    top = values.agg((F.max if largest else F.min)(column)).first()[0]
    if top is None:
        raise IndexError("the heap is empty")
    return top


def priority_order(items: DataFrame, largest: bool = False) -> DataFrame:
    """items(item, priority, seq) as a priority queue gives them out: equal priorities first in, first out."""
    return items.orderBy(F.desc("priority") if largest else F.asc("priority"), F.asc("seq"))


def priority_places(items: DataFrame, largest: bool = False) -> DataFrame:
    """items with `place`: 1, 2, ... in the order in which the queue gives them out, numbered by ranges without one sorting task."""
    return numbered(items, [F.desc("priority") if largest else F.asc("priority"), F.asc("seq")], "place")


def put_keys(table: DataFrame, more: DataFrame) -> DataFrame:
    """table(key, value) with more's keys set; of a key given twice the last (by seq, if there) holds."""
    last = more.groupBy("key").agg(F.max_by("value", "seq").alias("value")) if "seq" in more.columns else more.select("key", "value")
    return remove_keys(table, last).unionByName(last)


def remove_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.select("key", "value").join(keys.select("key").distinct(), "key", "left_anti")


def get_key(table: DataFrame, key) -> DataFrame:
    return table.where(F.col("key") == F.lit(key)).select("value")


def map_put(values: Column, key: Column, value: Column) -> Column:
    """A map column with one key set."""
    return F.map_concat(F.map_filter(values, lambda k, _: k != key), F.create_map(key, value))


def map_remove(values: Column, key: Column) -> Column:
    return F.map_filter(values, lambda k, _: k != key)
