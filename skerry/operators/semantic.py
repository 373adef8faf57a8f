"""Vector index, hybrid fusion, query expansion, extractive answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, words
from ..functions.vectors import cosine, hash_embedding, min_max
from ..sources.cut import table_cut
from .index import Index
from .rank import DECIMALS, bm25_scores, by_score, check_top_k

# The default synonyms.
SYNONYMS = {
    "fast": ["quick", "rapid", "speedy"],
    "error": ["bug", "exception", "issue"],
    "function": ["method", "procedure"],
    "big": ["large", "huge"],
    "small": ["tiny", "little"],
    "start": ["begin", "launch"],
    "search": ["find", "lookup", "query"],
}

# Fixed value: the answer where nothing was retrieved.
NO_ANSWER = "No relevant information found."

EmbeddingProvider = Callable[[Column], Column]


def embed(documents: DataFrame, text: str = "raw_text", dimension: int = 64, provider: EmbeddingProvider | None = None) -> DataFrame:
    """(doc_id, embedding) by the hash embedding, or by a provider: any function from a text column to a vector column."""
    make = provider or (lambda c: hash_embedding(c, dimension))
    return documents.select("doc_id", make(F.col(text)).alias("embedding"))


def precomputed(keys: DataFrame, vectors: DataFrame, key: str = "key") -> DataFrame:
    """keys with their given embedding; a key without one is an error."""
    joined = keys.join(vectors.select(key, "embedding"), key, "left")
    missing = F.raise_error(F.concat(F.lit("no embedding for "), F.col(key).cast("string")))
    return joined.withColumn("embedding", F.when(F.col("embedding").isNull(), missing.cast("array<double>")).otherwise(F.col("embedding")))


def model_provider(name: str) -> EmbeddingProvider:
    """A sentence model as a provider, if its package is there; each executor's worker loads it once a batch stream."""
    try:
        import sentence_transformers  # noqa: F401
    except ImportError as e:
        raise ImportError("the package sentence_transformers is needed for model embeddings; hash_embedding needs none") from e
    from collections.abc import Iterator

    import pandas as pd

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sentence_transformers.SentenceTransformer(name)
        for texts in batches:
            yield pd.Series(list(model.encode(texts.fillna("").tolist())))

    return encode


def upsert_vectors(vectors: DataFrame, more: DataFrame) -> DataFrame:
    """vectors(doc_id, embedding) with those of more added or replaced."""
    return remove_vectors(vectors, more).unionByName(more)


def remove_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def nearest(vectors: DataFrame, query: list[float], top_k: int = 10) -> DataFrame:
    """(doc_id, score): the top_k by cosine with one vector, ties by the greater doc_id."""
    check_top_k(top_k)
    scored = vectors.select("doc_id", cosine(F.col("embedding"), F.lit(query).cast("array<double>")).alias("score"))
    return scored.orderBy(by_score(), F.desc("doc_id")).limit(top_k)


#: Queries that go to all tasks at a time, and vectors that a task compares with them at a time.
BLOCK, CHUNK = 1024, 2048


def _matrix(lists: pa.Array, dimension: int | None = None) -> np.ndarray:
    """Unit rows, filled up with zeros; a vector that is null, of size 0, or has a null or non-finite part is all zeros."""
    lists = lists.cast(pa.list_(pa.float64()))
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)  # a null part is NaN
    out = np.zeros((len(lengths), max(dimension or 0, int(lengths.max(initial=0)))))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    with np.errstate(invalid="ignore", over="ignore"):
        sizes = np.sqrt((out * out).sum(1))
        out = out / np.where(sizes > 0, sizes, 1)[:, None]
    out[~np.isfinite(out).all(1)] = 0
    return out


def _nearest_to(asked: pa.Table, top_k: int):
    ids, queries = asked.column("query_id").combine_chunks(), _matrix(asked.column("embedding").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids, held = np.zeros((len(queries), 0), np.int64), np.zeros((len(queries), 0))
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                vectors = _matrix(part.column("embedding"), queries.shape[1])
                scores = np.pad(queries, ((0, 0), (0, vectors.shape[1] - queries.shape[1]))) @ vectors.T
                doc_ids = np.broadcast_to(part.column("doc_id").to_numpy(), scores.shape)
                held, held_ids = np.hstack([held, scores]), np.hstack([held_ids, doc_ids])
                best = np.lexsort((-held_ids, -np.round(held, DECIMALS)))[:, :top_k]
                held, held_ids = np.take_along_axis(held, best, 1), np.take_along_axis(held_ids, best, 1)
        rows = np.repeat(np.arange(len(queries)), held.shape[1])
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(held_ids.ravel()), pa.array(held.ravel())], ["query_id", "doc_id", "score"])

    return run


def nearest_per_query(vectors: DataFrame, queries: DataFrame, top_k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank): for each of the queries (query_id, embedding) the top_k by cosine, ties by the greater doc_id.

    Queries go out in blocks of about `block`; for each the vectors are read once, a task keeps top_k for each query of the block, and
    these few meet in one shuffle. A vector without a direction (null, zero, or with a null or non-finite part) has score 0 with all.
    """
    check_top_k(top_k)
    asked = table_cut(queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")), "queries")
    rows = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("doc_id IS NOT NULL")
    kind = asked.schema["query_id"].dataType.simpleString()
    blocks = max(1, -(-asked.count() // block))
    best = Window.partitionBy("query_id").orderBy(by_score(), F.desc("doc_id"))
    found = []
    for k in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).toArrow()
        local = rows.mapInArrow(_nearest_to(own, top_k), f"query_id {kind}, doc_id long, score double")
        found.append(local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k))
    return reduce(DataFrame.union, found)


def hybrid_scores(candidates: DataFrame, alpha: float = 0.5) -> DataFrame:
    """candidates(doc_id, keyword, vector) with score = alpha * scaled keyword + (1 - alpha) * scaled vector.

    The four extremes are one aggregated row, broadcast; no window gathers the candidates.
    """
    ends = F.broadcast(candidates.agg(*(f(c).alias(f"_{n}_{c}") for c in ("keyword", "vector") for n, f in (("min", F.min), ("max", F.max)))))
    scaled = candidates.crossJoin(ends)
    for c in ("keyword", "vector"):
        scaled = scaled.withColumn(f"{c}_scaled", min_max(F.col(c), F.col(f"_min_{c}"), F.col(f"_max_{c}")))
    return scaled.select("doc_id", "keyword", "vector", (alpha * F.col("keyword_scaled") + (1 - alpha) * F.col("vector_scaled")).alias("score"))


def hybrid_search(index: Index, vectors: DataFrame, terms: list[str], query_vector: list[float], candidates: DataFrame, top_k: int = 10, alpha: float = 0.5) -> DataFrame:
    """(doc_id, score): BM25 and cosine of all candidates, each scaled to 0..1 among them and blended; ties by the smaller doc_id."""
    keyword = bm25_scores(index, terms, candidates).withColumnRenamed("score", "keyword")
    both = keyword.join(vectors.select("doc_id", "embedding"), "doc_id", "left")
    both = both.select("doc_id", "keyword", cosine(F.col("embedding"), F.lit(query_vector).cast("array<double>")).alias("vector"))
    return hybrid_scores(both, alpha).select("doc_id", "score").orderBy(by_score(), "doc_id").limit(top_k)


def expand(queries: DataFrame, query: str = "query", synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """queries with (variant_no, variant): the query itself first, then one variant a (place, synonym), in lower case."""
    table = SYNONYMS if synonyms is None else synonyms
    given = queries.withColumn("_words", words(F.lower(F.col(query))))
    known = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v))))) if table else None
    if known is None:
        variants = F.array().cast("array<string>")
    else:
        place = lambda w, i: F.transform(F.coalesce(known[w], F.array().cast("array<string>")), lambda s: F.array_join(F.concat(F.slice("_words", 1, i), F.array(s), F.slice("_words", i + 2, F.size("_words"))), " "))
        variants = F.flatten(F.transform("_words", place))
    every = F.concat(F.array(F.col(query)), variants)
    return given.select(*queries.columns, F.posexplode(every).alias("variant_no", "variant"))


def extractive_answers(snippets: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, answer) from (key, query, snippet_no, snippet): the sentence with the most words of the query, the first of equals.

    A null snippet stands for nothing retrieved. Without any sentence the first 200 characters of the first snippet answer.
    """
    split = snippets.select(key, "query", "snippet_no", "snippet", F.posexplode_outer(sentences(F.col("snippet"))).alias("sentence_no", "sentence"))
    distinct_words = lambda c: F.array_distinct(words(F.lower(c)))
    overlap = F.size(F.array_intersect(distinct_words(F.col("query")), distinct_words(F.col("sentence"))))
    scored = split.withColumn("_order", F.struct(overlap.alias("overlap"), (-F.col("snippet_no")).alias("s"), (-F.col("sentence_no")).alias("n")))
    stripped = F.regexp_replace("sentence", r"^\s+|\s+$", "")
    best = scored.groupBy(key).agg(
        F.max_by(F.when(F.col("sentence").isNotNull(), stripped), F.when(F.col("sentence").isNotNull(), F.col("_order"))).alias("best"),
        F.min_by(F.substring("snippet", 1, 200), "snippet_no").alias("fallback"),
    )
    return best.select(key, F.coalesce("best", "fallback", F.lit(NO_ANSWER)).alias("answer"))


def answer(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], synonyms: dict[str, list[str]] | None = None, rewrite: bool = True, generate: Callable[[DataFrame], DataFrame] = extractive_answers) -> DataFrame:
    """(query_id, answer) of queries(query_id, query): expand, retrieve for each variant, drop repeated snippets, answer the original.

    retrieve takes (query_id, variant_no, variant) and returns these with (snippet_no, snippet); generate takes (query_id, query, snippet_no, snippet).
    """
    variants = expand(queries, "query", synonyms if rewrite else {}).select("query_id", "variant_no", "variant")
    found = retrieve(variants).groupBy("query_id", "snippet").agg(F.min(F.struct("variant_no", "snippet_no")).alias("first"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    numbered = found.select("query_id", "snippet", order.alias("snippet_no"))
    return generate(queries.select("query_id", "query").join(numbered, "query_id", "left"))


def language_model_answers(client: Callable[[str], str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A generator for answer() that asks an outside model by a client given by the caller: prompt -> text, run in Arrow batches."""
    if client is None:
        raise ImportError("no language model client is set up; extractive_answers needs none")

    @F.pandas_udf("string")
    def ask(prompts):
        return prompts.map(client)

    def generate(snippets: DataFrame) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct("snippet_no", "snippet")))
        context = F.array_join(F.transform(parts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["snippet"])), "\n\n")
        prompt = F.concat(F.lit("Use only these passages; say so if they don't suffice.\n\n"), context, F.lit("\n\n"), F.first("query"))
        return snippets.groupBy("query_id").agg(prompt.alias("prompt")).select("query_id", ask("prompt").alias("answer"))

    return generate
