"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode_digests
from .html_blocks import extract_text
from .media import media_columns
from .near_duplicates import near_duplicates
from .packing import pack
from .quality import classify
from .repeated_spans import removal_digests
from .topk import top_k
from .toxicity import score
from .url_rules import filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), window=1024, tokenizer="byte_bpe_50k.json", separator=0)


def op2_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10, scale=1024.0)


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), size=5, percent=85)


def op4_lyndon_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(_table(spark, sf_dir, "documents"), span=400)


def op5_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_table(spark, sf_dir, "documents"))


def op6_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), host="source", path="lang")


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(_table(spark, sf_dir, "documents"), tokenizer="word_bpe_49k.json")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_nnls_packing, op2_segment_topk, op3_lsh_forest, op4_lyndon_suffix_dedup, op5_chunked_media, op6_crf_main_text, op7_site_quality, op8_toxic_segments, op9_bpe_roundtrip, op10_url_rules)}

ORACLE_SQL: dict[str, str] = {
    "op2_segment_topk": """
        WITH fine AS (
            SELECT vec_id, embedding FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
        ), candidates AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM fine
        ), asked AS (
            SELECT vec_id, list_transform(min(embedding), lambda x: floor(1024 * x::DOUBLE)) AS v FROM fine WHERE vec_id % 100 = 0 GROUP BY vec_id
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM asked q JOIN candidates c ON c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op10_url_rules": r"""
        WITH parts AS (
            SELECT page_id, url, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
            FROM pages
        ), split AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path
            FROM parts
        ), rules(rule_host, rule_path, verdict) AS (
            VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
        ), fits AS (
            SELECT s.page_id, s.host, s.path, max_by(struct_pack(rule := r.rule_host || r.rule_path, verdict := r.verdict), length(r.rule_host || r.rule_path)) AS best
            FROM split s LEFT JOIN rules r
              ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path)
            GROUP BY s.page_id, s.host, s.path
        )
        SELECT page_id, host, path, best.rule AS rule,
               coalesce(best.verdict, CASE
                   WHEN regexp_matches(host || path, '^([^/]*\.)?spam-farm\.[^/]*(/.*)?$')
                     OR regexp_matches(host || path, '^[^/]*\bcasino\b')
                     OR regexp_matches(host || path, '^([^/]*\.)?(ads|adserver)[0-9]*\.')
                     OR regexp_matches(host || path, '^[^/]*/(.*/)?login(/|$)')
                   THEN 'block' ELSE 'allow' END) AS verdict
        FROM fits
    """,
}
