"""Dense vectors as column expressions: cosine, normalisation, hash embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; the longer vector's rest counts nothing."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)


def magnitude(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a missing, empty or zero vector has 0 with everything."""
    size = magnitude(a) * magnitude(b)
    return F.coalesce(F.when(size == 0, 0.0).otherwise(dot(a, b) / size), F.lit(0.0))


def normalise(a: Column) -> Column:
    """Divided by its magnitude where that isn't 0."""
    scaled = lambda size: F.when(size > 0, F.transform(a, lambda v: v / size)).otherwise(a)
    return F.element_at(F.transform(F.array(magnitude(a)), scaled), 1)


def hash_bucket(word: Column, dimension: int) -> Column:
    """The 128-bit MD5 of a word modulo dimension, by Horner's rule over its four 32-bit parts."""
    digest = F.md5(word)
    out = F.lit(0).cast("long")
    for k in range(3 if (1 << 32) % dimension == 0 else 0, 4):  # where dimension divides 2^32 the last part alone decides
        part = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
        out = (out * F.lit((1 << 32) % dimension) + part) % dimension
    return out


def hash_embedding(text: Column, dimension: int = 64) -> Column:
    """Counts of a text's lower-cased words by bucket, normalised; a blank or null text is the zero vector.

    In Arrow batches: a word's bucket is computed once and remembered, a text is one count over its words' buckets.
    """

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets = _Buckets(dimension)
        for texts in batches:
            vectors = []
            for value in texts:
                words = (value or "").lower().split()
                counts = np.bincount(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), minlength=dimension).astype(float)
                size = np.sqrt((counts * counts).sum())
                vectors.append(counts / size if size else counts)
            yield pd.Series(vectors, dtype=object)

    return embed(text)


class _Buckets(dict):
    """word -> MD5 modulo dimension, of the last words asked for."""

    def __init__(self, dimension: int):
        super().__init__()
        self.dimension = dimension

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        found = int(hashlib.md5(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest(), 16) % self.dimension
        self[word] = found
        return found


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; one half where all are the same."""
    return F.when(high == low, 0.5).otherwise((value - low) / (high - low))
