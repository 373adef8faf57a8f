"""Graphs as edge tables: link authority, traversals, accessors."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.cut import table_cut
from .numbering import numbered


def graph_edges(edges: DataFrame, directed: bool = True) -> DataFrame:
    """(src, dst, seq): parallel edges once, with their least seq; undirected ones both ways."""
    both = edges.select("src", "dst", "seq")
    if not directed:
        both = both.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "seq"))
    return both.groupBy("src", "dst").agg(F.min("seq").alias("seq"))


def graph_nodes(edges: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """(id): all ends of edges, and given isolated nodes."""
    nodes = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    return (nodes if isolated is None else nodes.union(isolated.select("id"))).distinct()


def neighbors(edges: DataFrame, node) -> DataFrame:
    """(dst) in the order in which the edges came."""
    return edges.where(F.col("src") == F.lit(node)).orderBy("seq", "dst").select("dst")


def has_edge(edges: DataFrame, src, dst) -> bool:
    return edges.where((F.col("src") == F.lit(src)) & (F.col("dst") == F.lit(dst))).limit(1).count() == 1


def edge_count(edges: DataFrame, directed: bool = True) -> int:
    n = edges.count()
    return n if directed else n // 2


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("out_degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, cut_every: int = 5) -> DataFrame:
    """(id, authority): ranks that sum to 1; nodes without out-edges give theirs to all alike.

    A round is one join on src and one aggregation on dst. The driver sees three sums a round: nodes, dangling mass, change.
    Lineage is cut in the shared folder every few rounds.
    """
    nodes = table_cut(nodes.select("id").distinct(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("authority"))
    links = table_cut(edges.select("src", "dst").distinct().join(degrees(edges.select("src", "dst").distinct()), "src"), "links")
    # A node's share goes to its links and a zero to itself, so that nodes without in-links stay.
    ranks = nodes.select("id", F.lit(1.0 / n).alias("authority"))
    sources = links.select(F.col("src").alias("id")).distinct()
    held: list[DataFrame] = []
    for turn in range(rounds):
        dangling = ranks.join(sources, "id", "left_anti").agg(F.coalesce(F.sum("authority"), F.lit(0.0))).first()[0]
        base = (1 - damping) / n + damping * dangling / n
        sent = links.join(ranks.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("authority") / F.col("out_degree")).alias("got"))
        new = sent.groupBy("id").agg(F.sum("got").alias("got"))
        new = ranks.withColumnRenamed("authority", "old").join(new, "id", "left").select("id", "old", (base + damping * F.coalesce("got", F.lit(0.0))).alias("authority"))
        if turn % cut_every == cut_every - 1:
            new = table_cut(new, "ranks")
            while held:
                held.pop().unpersist()
        else:
            held.append(new := new.persist())
        change = new.agg(F.sum(F.abs(F.col("authority") - F.col("old")))).first()[0]
        ranks = new.select("id", "authority")
        if change < tolerance:
            break
    return ranks


def bfs(edges: DataFrame, start, most_levels: int | None = None) -> DataFrame:
    """(id, level, place, path) of what start reaches; the breadth-first order is that of (level, place).

    place lists the seq of the edges of path, the first-found way of fewest edges, so siblings come by their parents' order and
    then by seq. A level is one join with the edges, an anti join with what was seen and one aggregation; no task sees a whole level.
    A start that no edge has gives no rows. Levels go on until nothing new is found; more than most_levels are an error.
    """
    known = graph_nodes(edges).where(F.col("id") == F.lit(start))
    frontier = table_cut(known.select("id", F.lit(0).alias("level"), F.array().cast("array<long>").alias("place"), F.array("id").alias("path")), "level")
    seen = frontier
    links = edges.select("src", "dst", F.col("seq").cast("long").alias("seq"))
    for level in count(1):
        step = frontier.join(links, frontier["id"] == links["src"]).select(F.col("dst").alias("id"), F.concat("place", F.array("seq")).alias("place"), F.concat("path", F.array("dst")).alias("path"))
        step = step.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("place", "path")).alias("first"))
        frontier = table_cut(step.select("id", F.lit(level).alias("level"), "first.place", "first.path"), "level")
        if frontier.isEmpty():
            break
        if most_levels is not None and level > most_levels:
            raise RuntimeError(f"the graph has more than {most_levels} levels")
        seen = table_cut(seen.unionByName(frontier), "seen")
    return seen


def bfs_order(edges: DataFrame, start) -> DataFrame:
    """(id, visit): the breadth-first order as numbers from 1."""
    return numbered(bfs(edges, start), ["level", "place"], "visit").select("id", "visit")


def shortest_path(edges: DataFrame, start, target) -> list | None:
    """The nodes of the first-found way of fewest edges; None if there is none; [start] if it is the target."""
    if start == target:
        return [start] if graph_nodes(edges).where(F.col("id") == F.lit(start)).limit(1).count() else None
    row = bfs(edges, start).where(F.col("id") == F.lit(target)).select("path").first()
    return row["path"] if row else None


#: Edges of a graph that one task can walk.
WALKABLE = 20_000_000


def dfs(edges: DataFrame, start, key: str | None = None, most_edges: int = WALKABLE) -> DataFrame:
    """(id, visit): depth-first preorder from start, neighbours in edge order.

    The order is sequential by nature, so each graph (one, or one for each value of key) is walked in one task and must fit there:
    one of more than most_edges is an error. Only the two ends and the order of edges go to it.
    """
    import pandas as pd

    edges = edges.select(*([key] if key else []), "src", "dst", "seq")
    largest = (edges.groupBy(key) if key else edges.groupBy()).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if largest is not None and largest > most_edges:
        raise ValueError(f"a graph of {largest} edges is more than one task can walk ({most_edges})")

    kind = edges.schema["src"].dataType.simpleString()

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seq", "dst"], kind="stable")
        after: dict = {}
        for a, b in zip(rows["src"].tolist(), rows["dst"].tolist(), strict=True):
            after.setdefault(a, []).append(b)
            after.setdefault(b, [])
        order, stack, seen = [], [start] if start in after else [], set()
        while stack:
            node = stack.pop()
            if node not in seen:
                seen.add(node)
                order.append(node)
                stack += [x for x in reversed(after[node]) if x not in seen]
        ids = pd.Series(order) if order else rows["src"].iloc[:0]
        out = pd.DataFrame({"id": ids, "visit": pd.Series(range(1, len(order) + 1), dtype="int64")})
        return out.assign(**{key: rows[key].iloc[0]})[[key, "id", "visit"]] if key else out

    if key:
        return edges.groupBy(key).applyInPandas(walk, f"{key} {edges.schema[key].dataType.simpleString()}, id {kind}, visit long")
    return edges.withColumn("_graph", F.lit(1)).groupBy("_graph").applyInPandas(walk, f"id {kind}, visit long")
