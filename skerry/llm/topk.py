"""Exact top-k search by inner product with multi-resolution segment statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Queries that one pass over the vectors serves; a block of them goes to the executors.
BLOCK = 4096
#: Vectors compared with a block of queries at a time.
CHUNK = 1024
#: The least long, as a double.
LEAST = -(2.0**63)


@dataclass
class Vectors:
    """Scaled vectors of one dimension: as doubles, for bounds, and exactly, as longs or, where a score with them may not fit a long, as integers of any size."""

    ids: np.ndarray
    floats: np.ndarray
    longs: np.ndarray
    wide: dict[int, list[int]]

    def part(self, a: int, b: int) -> Vectors:
        return Vectors(self.ids[a:b], self.floats[a:b], self.longs[a:b], {k - a: x for k, x in self.wide.items() if a <= k < b})

    def exact(self, k: int) -> list[int]:
        return self.wide.get(k) or self.longs[k].tolist()

    def products(self, rows: np.ndarray, other: Vectors, of: np.ndarray) -> np.ndarray:
        """The inner products of rows with the rows `of` of another; beyond a long, the nearest long."""
        out = np.einsum("ij,ij->i", self.longs[rows], other.longs[of])
        if self.wide or other.wide:
            for k in np.flatnonzero(np.isin(rows, list(self.wide)) | np.isin(of, list(other.wide))):
                score = sum(x * y for x, y in zip(self.exact(int(rows[k])), other.exact(int(of[k])), strict=True))
                out[k] = min(max(score, -(1 << 63)), (1 << 63) - 1)
        return out


def _scaled(x: float, scale: float) -> int:
    """floor(scale * x), also where the product is no finite double."""
    y = x * scale
    return math.floor(y) if math.isfinite(y) else math.floor(Fraction(x) * Fraction(scale))


def _vectors(ids: pa.Array, column: pa.Array, scale: float) -> Iterator[Vectors]:
    """For each dimension that occurs, the rows whose vectors are whole and finite."""
    lists = column.cast(pa.list_(pa.float64()))
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = lists.offsets.to_numpy()
    values = lists.values
    whole = values.is_valid().to_numpy(zero_copy_only=False)
    flat = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    numbers = ids.fill_null(-1).to_numpy(zero_copy_only=False)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero((lengths == d) & known)
        at = offsets[:-1][rows][:, None] + np.arange(d)
        fine = (whole[at] & np.isfinite(flat[at])).all(1)
        if fine.any():
            at, rows = at[fine], rows[fine]
            with np.errstate(over="ignore"):
                scaled = np.floor(flat[at] * scale)
            most = math.isqrt((1 << 62) // int(d))
            large = np.flatnonzero((np.abs(scaled) > most).any(1))
            longs = scaled.copy()
            longs[large] = 0
            yield Vectors(numbers[rows], scaled, longs.astype(np.int64), {k: [_scaled(x, scale) for x in flat[at[k]].tolist()] for k in large.tolist()})


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """sqrt(length) times the mean, and the norm of the deviations, of each segment of each row of x."""
    edges = np.linspace(0, x.shape[1], segments + 1).round().astype(int)
    lengths = np.diff(edges)
    means = np.add.reduceat(x, edges[:-1], 1) / lengths
    deviations = np.sqrt(np.maximum(np.add.reduceat(np.square(x, dtype=float), edges[:-1], 1) - lengths * means**2, 0))
    return means * np.sqrt(lengths), deviations


def resolutions(dimensions: int) -> list[int]:
    """The numbers of segments, coarse to fine."""
    return [s for s in (1, 4, 16) if s < dimensions] or [1]


class _Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0, np.int64)] * queries, [np.zeros(0, np.int64)] * queries
        self.floor = np.full(queries, -np.inf)

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[query], scores]), np.concatenate([self.ids[query], ids])
        best = np.lexsort((ids, ~scores))[: self.k]
        self.scores[query], self.ids[query] = scores[best], ids[best]
        if len(best) == self.k:
            self.floor[query] = np.nextafter(float(scores[best[-1]]), -np.inf)


def search_chunk(best: _Best, queries: Vectors, vectors: Vectors, statistics: list) -> None:
    """Compare all queries with all vectors of a chunk.

    |q-v|^2 = |q|^2 + |v|^2 - 2qv, so a lower bound of the distance is an upper bound of the score. Over a segment the score
    is m*mean*mean plus the deviations' inner product, and that is at most the product of their norms.
    Bounds go from coarse to fine; only pairs whose bound reaches the query's k-th score so far go on. What doubles cannot say goes on too.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        norms_q, norms_v = (np.sqrt(np.square(x.floats).sum(1)) for x in (queries, vectors))
        pairs = None
        for segments, (query_means, query_deviations) in statistics:
            means, deviations = segment_statistics(vectors.floats, segments)
            if pairs is None:
                bound = query_means @ means.T + query_deviations @ deviations.T + 1e-9 * np.outer(norms_q, norms_v) + 1e-6
                pairs = np.nonzero(~(np.maximum(bound, LEAST) < best.floor[:, None]))
            else:
                a, b = pairs
                keep = np.zeros(len(a), bool)
                for s in range(0, len(a), 1 << 16):
                    i, j = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
                    bound = np.einsum("ij,ij->i", query_means[i], means[j]) + np.einsum("ij,ij->i", query_deviations[i], deviations[j])
                    keep[s : s + len(i)] = ~(np.maximum(bound + 1e-9 * norms_q[i] * norms_v[j] + 1e-6, LEAST) < best.floor[i])
                pairs = a[keep], b[keep]
    a, b = pairs
    other = queries.ids[a] != vectors.ids[b]
    a, b = a[other], b[other]
    parts = [queries.products(a[s : s + (1 << 16)], vectors, b[s : s + (1 << 16)]) for s in range(0, len(a), 1 << 16)]
    if not parts:
        return
    scores = np.concatenate(parts)
    keep = scores >= best.floor[a]
    a, b, scores = a[keep], b[keep], scores[keep]
    edges = np.searchsorted(a, np.arange(len(queries.ids) + 1))
    for i in np.unique(a):
        at = slice(edges[i], edges[i + 1])
        best.add(int(i), scores[at], vectors.ids[b[at]])


def _search(block: list[Vectors], k: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore", invalid="ignore"):
            state = {x.floats.shape[1]: (x, _Best(len(x.ids), k), [(s, segment_statistics(x.floats, s)) for s in resolutions(x.floats.shape[1])]) for x in block}
        for batch in batches:
            for vectors in _vectors(batch.column("vec_id"), batch.column("embedding"), scale):
                if (held := state.get(vectors.floats.shape[1])) is None:
                    continue
                queries, best, statistics = held
                for s in range(0, len(vectors.ids), CHUNK):
                    search_chunk(best, queries, vectors.part(s, s + CHUNK), statistics)
        for queries, best, _ in state.values():
            counts = [len(x) for x in best.ids]
            if sum(counts):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries.ids, counts)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, block: int = BLOCK) -> DataFrame:
    """For each query vector the k vectors of the highest integer inner product: query_id, rank, vec_id, score.

    Both tables hold vec_id and embedding; other columns are not read. A component x counts as floor(scale * x), x as
    double. The queries are dealt into blocks of about `block` by their id's hash; for each block the vectors are read
    once, every task keeps k candidates a query, and these few meet in one shuffle. So the driver holds a block, and no
    task holds more than a block and a chunk. A query isn't compared with rows of its own id; ties go to the smaller
    vec_id. Rows take no part whose vec_id or vector is null, whose vector is empty, holds a null or non-finite
    component or one beyond 2^27 after scaling; nor does a vector for queries of another length. Of query rows with the
    same id the least vector counts; repeated candidate rows count each. Where there are fewer than k, all are returned.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = asked.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    asked = materialise(asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    blocks = max(1, -(-asked.count() // block))
    found = []
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        own = list(_vectors(own.column("vec_id").combine_chunks(), own.column("embedding").combine_chunks(), scale)) if own.num_rows else []
        local = rows.mapInArrow(_search(own, k, scale), "query_id long, vec_id long, score long")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        top = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found.append(materialise(top, "top") if blocks > 1 else top)
    return reduce(DataFrame.union, found).select("query_id", "rank", "vec_id", "score")
