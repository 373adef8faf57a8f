"""Stateful operators over arrivals: sliding-window rate limits, cache replay, and the query log as a stream."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SlidingLog:
    """The times of a client's accepted requests, ascending; one exactly a window old still counts, and refused ones leave no trace.

    No more than `limit` of them can count at a time, so only the latest ones are kept.
    """

    def __init__(self, limit: int, window: float, held: list[float] = ()):
        self.limit, self.window, self.accepted = limit, window, sorted(held)

    def count(self, now: float) -> int:
        """How many accepted requests are in the window that ends now."""
        return len(self.accepted) - bisect_left(self.accepted, now - self.window)

    def allow(self, now: float) -> bool:
        free = self.count(now) < self.limit
        if free:
            insort(self.accepted, now)
            self.accepted = self.accepted[-self.limit :]
        return free


def rate_limited(requests: DataFrame, limit: int = 10, window: float = 60.0, client: str = "client") -> DataFrame:
    """requests(client, ts seconds as double, seq) with allowed and held (requests that count after it), client by client in order of (ts, seq).

    Whether a request counts depends on the decisions before it, so it is a fold over each client's requests, and a client is one
    task however many it makes: its rows come sorted as a stream of Arrow batches, of which `limit` accepted times are kept.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema.fields)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, None
        for rows in batches:
            allowed, held = [], []
            for who, now in zip(rows[client], rows["ts"], strict=True):
                if log is None or who != current:
                    current, log = who, SlidingLog(limit, window)
                allowed.append(log.allow(now))
                held.append(log.count(now))
            yield rows.assign(allowed=allowed, held=held)

    ordered = requests.repartition(client).sortWithinPartitions(client, "ts", "seq")
    return ordered.mapInPandas(fold, f"{kinds}, allowed boolean, held long")


def rate_limited_stream(requests: DataFrame, limit: int = 10, window: float = 60.0, client: str = "client") -> DataFrame:
    """The same for a stream of requests(client, ts, seq): a list state for each client holds its accepted times.

    Within a micro-batch requests are taken in order of (ts, seq); one that comes in a later batch than a younger one is judged as it comes.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
    from pyspark.sql.types import DoubleType, StructField, StructType

    kind = requests.schema[client].dataType.simpleString()

    class Limiter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.times = handle.getListState("times", StructType([StructField("ts", DoubleType())]))

        def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
            log = SlidingLog(limit, window, [t[0] for t in self.times.get()])
            every = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
            every["allowed"] = [log.allow(t) for t in every["ts"]]
            self.times.put([(float(t),) for t in log.accepted])
            yield every[[client, "ts", "seq", "allowed"]]

        def close(self) -> None:
            pass

    return requests.groupBy(client).transformWithStateInPandas(Limiter(), f"{client} {kind}, ts double, seq long, allowed boolean", "Append", "None")


def cache_replay(trace: DataFrame, capacity: int, cache: str = "cache_id") -> DataFrame:
    """trace(cache_id, seq, op get or put, key) replayed on least-recently-used caches: with hit (for get) and evicted (the key a put pushes out)."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in trace.schema.fields)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, OrderedDict()
        for rows in batches:
            hits, evicted = [], []
            for who, op, key in zip(rows[cache], rows["op"], rows["key"], strict=True):
                if who != current:
                    current, kept = who, OrderedDict()
                hit = key in kept
                if hit:
                    kept.move_to_end(key)
                gone = None
                if op == "put" and not hit:
                    if len(kept) >= capacity:
                        gone, _ = kept.popitem(last=False)
                    kept[key] = True
                hits.append(hit if op == "get" else None)
                evicted.append(gone)
            yield rows.assign(hit=pd.array(hits, "boolean"), evicted=evicted)

    ordered = trace.repartition(cache).sortWithinPartitions(cache, "seq")
    return ordered.mapInPandas(fold, f"{kinds}, hit boolean, evicted {trace.schema['key'].dataType.simpleString()}")


def query_counts_stream(log: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """A stream of query_log rows (api_key, query, result_count, at timestamp) as counts by key and time window; rows later than `late` are dropped."""
    return log.withWatermark("at", late).groupBy(F.window("at", window), "api_key").agg(F.count("*").alias("queries"), F.avg("result_count").alias("average"))


def append_stream(log: DataFrame, path: str, checkpoint: str):
    """Write a stream of the query log as Parquet files; all that is there now, then stop."""
    return log.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
