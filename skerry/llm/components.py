"""Connected components of a graph given as edges, by repeated contraction to the least neighbour."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: A task contracts so many edges at a time before any shuffle.
EDGES_AT_ONCE = 500_000
#: A graph of no more edges than this is contracted by one task at once.
ALONE = 100_000


def _spanning_stars(batches: Iterator[pa.RecordBatch], least: bool = False) -> Iterator[pa.RecordBatch]:
    """The edges of a task, contracted by union-find: each node with the least node that these edges join it to. least: also for the least nodes themselves."""
    parent: dict = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    kind = None

    def flush() -> pa.RecordBatch:
        rows = [(root(x), x) for x in list(parent)]
        rows = [(a, b) for a, b in rows if least or a != b]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], kind), pa.array([b for _, b in rows], kind)], ["a", "b"])

    for batch in batches:
        kind = batch.column("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > EDGES_AT_ONCE:
            yield flush()
    if kind is not None:
        yield flush()


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the least node that it is joined to.

    Each round every node points to its least neighbour, pointers are followed four steps, and edges between what they
    point to make the next, smaller graph; edges within a task are contracted before. The number of rounds grows with the
    logarithm of the longest chain; a graph of ALONE edges or less needs no further round. Links and labels stay in tables of the shared folder; the driver sees only whether
    how many edges are left. Edges with a null end or equal ends are dropped; an empty table gives an empty one. rows: a bound of their
    number, where one is known.
    """
    kind = edges.schema["a"].dataType.simpleString()

    def contracted(graph: DataFrame, rows: int | None) -> DataFrame:
        stars = graph.select("a", "b").mapInArrow(_spanning_stars, f"a {kind}, b {kind}")
        return materialise(stars.where("a <> b").distinct(), "edges", rows, True)

    graph = contracted(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b"), rows)
    labels, nodes = None, None
    while left := graph.count():
        nodes = nodes or 2 * left
        if alone := left <= ALONE:
            points = graph.coalesce(1).mapInArrow(lambda x: _spanning_stars(x, True), f"a {kind}, b {kind}").select(F.col("b").alias("node"), F.col("a").alias("to"))
        else:
            both = graph.union(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
            points = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to"))
            points = materialise(points, "pointers", 2 * left, True)
            for _ in range(2):
                further = points.select(F.col("node").alias("to"), F.col("to").alias("further"))
                points = points.join(further, "to").select("node", F.col("further").alias("to"))
            points = materialise(points, "pointers", 2 * left, True)
            start, end = (points.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
            graph = contracted(graph.join(start, "a").join(end, "b").where("a_to <> b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")), left)
        if labels is None:
            labels = points.select("node", F.col("to").alias("component"))
        else:
            moved = points.select(F.col("node").alias("component"), "to")
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = materialise(labels, "labels", nodes, True)
        if alone:
            break
    return labels if labels is not None else edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
