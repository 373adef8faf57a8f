"""The positional inverted index as DataFrames: built in one pass, looked up, changed by set operations."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.porter import porter_stem, stem
from ..functions.text import STOPWORDS, TOKEN, remove_stopwords, tokenize
from ..sources.cut import table_cut

Analyzer = Callable[[Column], Column]


def analyze(text: Column) -> Column:
    """The index terms of a text, in order: tokens, without stopwords, stemmed; all in the JVM."""
    return F.transform(remove_stopwords(tokenize(text)), porter_stem)


def analyze_plain(text: Column) -> Column:
    """As analyze, without stemming."""
    return remove_stopwords(tokenize(text))


class _Terms(dict):
    """token as it stands -> number of its index term, -1 for a stopword; terms lists the terms by number."""

    #: Tokens remembered; beyond it all are forgotten, so that a stream of ever new ones stays small.
    MOST = 300_000

    def __init__(self):
        super().__init__()
        self.terms: list[str] = []
        self.numbers: dict[str, int] = {}
        self.stop = frozenset(STOPWORDS)

    def __missing__(self, token: str) -> int:
        word = token.lower()
        if word in self.stop:
            number = -1
        else:
            term = stem(word)
            if (number := self.numbers.get(term, -1)) < 0:
                number = self.numbers[term] = len(self.terms)
                self.terms.append(term)
        self[token] = number
        return number

    def forget(self) -> None:
        self.clear()
        self.numbers.clear()
        self.terms = []


def _numbered_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]]:
    """For each batch with a column text: (batch, terms a document, the number of each document's every term, numbers -> terms)."""
    find = re.compile(TOKEN).findall
    known = _Terms()

    def named(numbers: np.ndarray) -> pa.Array:
        distinct, which = np.unique(numbers, return_inverse=True)
        return pa.array([known.terms[k] for k in distinct.tolist()], pa.string()).take(pa.array(which))

    for batch in batches:
        if len(known) > _Terms.MOST:
            known.forget()
        parts = [np.zeros(0, np.int64)]
        for text in batch.column("text").to_pylist():
            tokens = find(text or "")
            numbers = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
            parts.append(numbers[numbers >= 0])
        yield batch, np.array([len(x) for x in parts[1:]], np.int64), np.concatenate(parts), named


def _analyze_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, lengths, numbers, named in _numbered_terms(batches):
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, named(numbers))], ["doc_id", "terms"])


def _index_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of the batches' documents, and a row without a term for each document, whose tf is its length."""
    names = ["term", "doc_id", "tf", "positions"]
    for batch, lengths, numbers, named in _numbered_terms(batches):
        at, counts, owner, positions = _grouped(lengths, numbers)
        ids = batch.column("doc_id")
        yield pa.RecordBatch.from_arrays([named(at), ids.take(pa.array(owner)), pa.array(counts, pa.int32()), positions], names)
        empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(lengths) + 1), pa.int32()), pa.array([], pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(lengths), pa.string()), ids, pa.array(lengths, pa.int32()), empty], names)


def _count_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, lengths, numbers, named in _numbered_terms(batches):
        at, counts, owner, _ = _grouped(lengths, numbers)
        offsets = pa.array(np.searchsorted(owner, np.arange(len(lengths) + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, named(at)), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))], ["doc_id", "terms", "tfs"])


def _grouped(lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(term number, count, document, positions) of each posting of documents of so many terms."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.lexsort((place, numbers, owner))
    numbers, owner, place = numbers[order], owner[order], place[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (numbers[1:] != numbers[:-1])
    at = np.flatnonzero(fresh)
    ends = np.append(at, len(order))
    return numbers[at], np.diff(ends), owner[at], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32()))


def analyzed(documents: DataFrame, text: str = "raw_text", analyzer: Analyzer | None = None) -> DataFrame:
    """(doc_id, terms) of every document.

    By default in Arrow batches: a token's fate (stopword, or the number of its stem) is looked up in a memo, and a document is one
    array of numbers; tokens as JVM arrays, filtered and stemmed by lambdas, cost several times as much. An analyzer replaces all of it.
    """
    if analyzer is not None:
        return documents.select("doc_id", analyzer(F.col(text)).alias("terms"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_analyze_arrays, "doc_id long, terms array<string>")


def term_counts(documents: DataFrame, text: str = "raw_text") -> DataFrame:
    """(doc_id, terms, tfs) of every document: its distinct terms and how often each stands, a row for each document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_count_arrays, "doc_id long, terms array<string>, tfs array<int>")


@dataclass(frozen=True)
class Index:
    """documents(doc_id, ...), postings(term, doc_id, tf, positions), doc_stats(doc_id, doc_len)."""

    documents: DataFrame
    postings: DataFrame
    doc_stats: DataFrame

    @property
    def term_stats(self) -> DataFrame:
        """(term, df)"""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    @property
    def corpus_stats(self) -> DataFrame:
        """One row: n_docs, avgdl (0 for an empty index), vocabulary."""
        return self.doc_stats.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("avgdl")).crossJoin(F.broadcast(self.postings.agg(F.count_distinct("term").alias("vocabulary"))))

    def document_count(self) -> int:
        return self.doc_stats.count()

    def vocabulary_size(self) -> int:
        return self.postings.select("term").distinct().count()

    def get_postings(self, term: str) -> DataFrame:
        return self.postings.where(F.col("term") == term)

    def document_ids(self, term: str) -> DataFrame:
        return self.get_postings(term).select("doc_id")

    def document_frequency(self, term: str) -> int:
        return self.get_postings(term).count()

    def term_frequency(self, term: str, doc_id: int) -> int:
        row = self.get_postings(term).where(F.col("doc_id") == doc_id).select("tf").first()
        return row["tf"] if row else 0

    def document_length(self, doc_id: int) -> int:
        row = self.doc_stats.where(F.col("doc_id") == doc_id).select("doc_len").first()
        return row["doc_len"] if row else 0

    def document_terms(self, doc_id: int) -> DataFrame:
        return self.postings.where(F.col("doc_id") == doc_id).select("term")

    def all_terms(self) -> DataFrame:
        return self.postings.select("term").distinct()

    def all_document_ids(self) -> DataFrame:
        return self.doc_stats.select("doc_id")

    def cached(self) -> Index:
        """The same index with its tables kept in memory or on disk between queries."""
        return replace(self, postings=self.postings.persist(), doc_stats=self.doc_stats.persist())


def empty_index(spark: SparkSession) -> Index:
    return Index(
        spark.createDataFrame([], "doc_id long, source_path string, source_type string, title string, raw_text string, metadata map<string,string>"),
        spark.createDataFrame([], "term string, doc_id long, tf int, positions array<int>"),
        spark.createDataFrame([], "doc_id long, doc_len int"),
    )


def grouped_postings_of(terms: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions) from (doc_id, terms) in the JVM, by one shuffle on (term, doc_id): partial lists, then merged ones."""
    each = terms.select("doc_id", F.posexplode("terms").alias("pos", "term"))
    grouped = each.groupBy("term", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return grouped.select("term", "doc_id", F.size("positions").alias("tf"), "positions")


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = batch.column("terms")
        flat = terms.flatten().dictionary_encode()
        lengths = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, counts, owner, positions = _grouped(lengths, flat.indices.to_numpy().astype(np.int64))
        yield pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(at)), batch.column("doc_id").take(pa.array(owner)), pa.array(counts, pa.int32()), positions], ["term", "doc_id", "tf", "positions"])


def inverted(terms: DataFrame) -> DataFrame:
    """The same in Arrow batches: each document is inverted where it lies, in linear time and without a shuffle."""
    return terms.select(F.col("doc_id").cast("long").alias("doc_id"), "terms").mapInArrow(_invert, "term string, doc_id long, tf int, positions array<int>")


def build_index(documents: DataFrame, text: str = "raw_text", analyzer: Analyzer | None = None, terms: DataFrame | None = None, cut: bool = False) -> Index:
    """Index documents(doc_id, text, ...), or ready-made (doc_id, terms). A document's id is expected once; see add_documents.

    With cut the postings and lengths are written to the shared folder as one table, made by one pass over the texts, so that what
    reads the index's tables doesn't analyse the texts anew.

    Documents without terms count, with length 0. Neither the map side nor the reduce side of a separate merge is needed: postings
    are complete in the task that reads the document.
    """
    if cut and analyzer is None and terms is None:
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        rows = table_cut(rows.mapInArrow(_index_arrays, "term string, doc_id long, tf int, positions array<int>"), "index")
        return Index(documents, rows.where("term IS NOT NULL"), rows.where("term IS NULL").select("doc_id", F.col("tf").alias("doc_len")))
    terms = analyzed(documents, text, analyzer) if terms is None else terms
    terms = table_cut(terms, "terms") if cut else terms
    return Index(documents, inverted(terms), terms.select("doc_id", F.size("terms").alias("doc_len")))


def remove_documents(index: Index, ids: DataFrame) -> Index:
    """Without the documents of ids(doc_id); terms that lose all their documents are gone with them."""
    ids = ids.select("doc_id").distinct()
    return Index(*(t.join(ids, "doc_id", "left_anti") for t in (index.documents, index.postings, index.doc_stats)))


def add_documents(index: Index, more: Index) -> Index:
    """Both indexes' documents; a doc_id that both have, or that more has twice, is an error."""
    known = more.doc_stats.join(index.doc_stats.select("doc_id"), "doc_id", "left_semi").select("doc_id")
    twice = more.doc_stats.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if (row := known.union(twice).first()) is not None:
        raise ValueError(f"document {row['doc_id']} is indexed already")
    return Index(
        index.documents.unionByName(more.documents, allowMissingColumns=True),
        index.postings.unionByName(more.postings),
        index.doc_stats.unionByName(more.doc_stats),
    )


def update_documents(index: Index, more: Index) -> Index:
    """Upsert: documents of the same ids are replaced, new ones added."""
    return add_documents(remove_documents(index, more.doc_stats), more)


def vectors_by_term(index: Index, weight: Column) -> DataFrame:
    """(doc_id, term, weight) for a weight expression over tf and df."""
    return index.postings.join(index.term_stats, "term").select("doc_id", "term", weight.alias("weight"))
