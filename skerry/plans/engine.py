"""The search engine: a folder or table of documents indexed once, then searched, suggested from, saved and measured."""

from __future__ import annotations

import logging
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from ..operators import analytics, suggest
from ..operators.index import Index, build_index, empty_index, remove_documents, update_documents
from ..operators.query import boolean_search
from ..operators.rank import search_ranked
from ..sources.cut import table_cut
from ..sources.documents import load_folder
from ..sources.tables import load_index, save_index
from ..streaming.limiter import SlidingLog

#: Requests a client may make in a minute.
SEARCHES_A_MINUTE, SUGGESTIONS_A_MINUTE = 30, 60


class TooManyRequests(RuntimeError):
    """A client's request beyond its limit."""


class Unauthorised(PermissionError):
    """A wrong key."""


def configure_logging() -> None:
    """The level that the environment names (SKERRY_LOG_LEVEL), else INFO."""
    logging.basicConfig(level=os.environ.get("SKERRY_LOG_LEVEL", "INFO").upper(), format="%(asctime)s %(levelname)s %(name)s %(message)s", stream=sys.stderr)


def check_key(key: str | None) -> str:
    """One of the keys in SKERRY_API_KEYS (comma list; dev-key if unset); a missing one is a ValueError, a wrong one Unauthorised."""
    if key is None:
        raise ValueError("a key is needed")
    if key not in {k.strip() for k in os.environ.get("SKERRY_API_KEYS", "dev-key").split(",")}:
        raise Unauthorised("invalid key")
    return key


class SearchEngine:
    """Holds an index; every method that changes it gives it a new set of tables, which earlier results don't see."""

    def __init__(self, spark: SparkSession, history: analytics.QueryLog | None = None):
        self.spark, self.history = spark, history
        self.index: Index = empty_index(spark)
        self._words: DataFrame | None = None
        self._limits: dict[tuple[str, str], SlidingLog] = {}

    def _set(self, index: Index) -> None:
        self.index = Index(*(table_cut(t, n) for t, n in ((index.documents, "documents"), (index.postings, "postings"), (index.doc_stats, "doc_stats"))))
        self._words = None

    def index_documents(self, documents: DataFrame) -> int:
        """Add documents (all columns of the model); those with ids that are there are replaced. Returns how many came."""
        new = build_index(table_cut(documents, "incoming"), cut=True)
        self._set(update_documents(self.index, new))
        return new.document_count()

    def index_folder(self, folder: str) -> int:
        """Index all readable files of a folder, with ids after those in use; returns how many."""
        from pyspark.sql import functions as F

        last = self.index.doc_stats.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
        return self.index_documents(load_folder(self.spark, folder).withColumn("doc_id", F.col("doc_id") + last))

    def remove(self, ids: list[int]) -> None:
        self._set(remove_documents(self.index, self.spark.createDataFrame([(i,) for i in ids], "doc_id long")))

    @property
    def document_count(self) -> int:
        return self.index.document_count()

    @property
    def vocabulary_size(self) -> int:
        return self.index.vocabulary_size()

    def search(self, query: str) -> DataFrame:
        """Documents that the boolean query selects: doc_id, title, source_path."""
        return boolean_search(self.index, query)

    def search_ranked(self, query: str, source_type: str | None = None, top_k: int = 10) -> DataFrame:
        return search_ranked(self.index, query, source_type, top_k)

    def suggest(self, prefix: str, limit: int = 10) -> list[str]:
        if self._words is None:
            self._words = table_cut(suggest.vocabulary(self.index.documents), "words")
        return [r["word"] for r in suggest.suggest(self._words, prefix, limit).collect()]

    def save(self, path: str) -> None:
        save_index(self.index, path)

    def load(self, path: str) -> None:
        self.index, self._words = load_index(self.spark, path), None

    # What a service in front of the engine would call; arguments are checked as at its door.

    def _admit(self, what: str, client: str, limit: int, now: float | None) -> None:
        held = self._limits.setdefault((what, client), SlidingLog(limit, 60.0))
        if not held.allow(time.monotonic() if now is None else now):
            raise TooManyRequests(f"{client}: more than {limit} a minute")

    def get_search(self, q: str, source_type: str | None = None, top_k: int = 10, key: str | None = None, client: str = "local", now: float | None = None) -> dict:
        self._admit("search", client, SEARCHES_A_MINUTE, now)
        if not q or not 1 <= top_k <= 100:
            raise ValueError("q must not be empty, top_k must be 1 to 100")
        hits = [r.asDict() for r in self.search_ranked(q, source_type, top_k).collect()]
        if self.history is not None:
            self.history.record(key or "anonymous", q, len(hits))
        return {"query": q, "count": len(hits), "results": hits}

    def get_suggest(self, prefix: str, limit: int = 10, client: str = "local", now: float | None = None) -> dict:
        self._admit("suggest", client, SUGGESTIONS_A_MINUTE, now)
        if not prefix or not 1 <= limit <= 50:
            raise ValueError("prefix must not be empty, limit must be 1 to 50")
        return {"prefix": prefix, "suggestions": self.suggest(prefix, limit)}

    def post_index(self, folder: str, key: str | None) -> dict:
        check_key(key)
        return {"indexed": self.index_folder(folder), **self.get_stats()}

    def get_stats(self) -> dict:
        return {"document_count": self.document_count, "vocabulary_size": self.vocabulary_size}

    def get_health(self) -> dict:
        return {"status": "ok"}

    def _history(self) -> DataFrame:
        if self.history is None:
            raise ValueError("no query log is kept")
        return self.history.table()

    def get_history(self, key: str | None, limit: int = 50) -> dict:
        check_key(key)
        table = self._history()
        return {"api_key": key, "total_queries": analytics.total_queries(table, key).first()["total"], "recent": [r.asDict() for r in analytics.history(table, key, limit).collect()]}

    def get_analytics(self, key: str | None) -> dict:
        check_key(key)
        table = self._history()
        return {
            "total_queries": analytics.total_queries(table).first()["total"],
            "top_queries": [r.asDict() for r in analytics.top_queries(table).collect()],
            "queries_per_user": [r.asDict() for r in analytics.queries_per_user(table).collect()],
            "average_result_count": analytics.average_result_count(table).first()["average"],
        }
