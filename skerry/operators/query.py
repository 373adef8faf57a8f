"""The query language and its evaluation: one filter of the postings and one aggregation by document, whatever the query."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.porter import stem
from ..functions.text import STOPWORDS, TOKEN
from .index import Index

LEXEME = re.compile(r'"[^"]*"|\S+')
OPERATORS = ("AND", "OR", "NOT")


def terms_of(text: str, stemmed: bool = True) -> list[str]:
    """The index terms of a query's text, as the analyzer of the index gives them."""
    kept = [t.lower() for t in re.findall(TOKEN, text)]
    kept = [t for t in kept if t not in STOPWORDS]
    return [stem(t) for t in kept] if stemmed else kept


@dataclass(frozen=True)
class Operand:
    """A word (its one term) or a phrase (its terms side by side; none: matches nothing)."""

    terms: tuple[str, ...]
    phrase: bool = False


@dataclass
class Query:
    """operands with the operator before each; scoring terms (with repeats); raw words to highlight."""

    operands: list[tuple[str, Operand]] = field(default_factory=list)
    scoring: list[str] = field(default_factory=list)
    highlight: list[str] = field(default_factory=list)


def word_operand(word: str, stemmed: bool = True) -> Operand:
    """A word stands for its first term only; one without terms, such as a stopword, for itself, which no document has."""
    found = terms_of(word, stemmed)
    return Operand((found[0] if found else word.lower(),))


def parse(query: str, stemmed: bool = True) -> Query:
    """Operators in any case, strictly from left to right; without one AND holds; of several in a row the last; after the last operand none counts.

    The first operand begins the result whatever stands before it. Words after NOT still score and highlight.
    """
    out, pending, texts = Query(), "AND", []
    for token in LEXEME.findall(query.strip()):
        if token.upper() in OPERATORS:
            pending = token.upper()
            continue
        quoted = token.startswith('"') and token.endswith('"')
        text = token[1:-1] if quoted else token
        texts.append(text)
        out.highlight += re.findall(r"\w+", text)
        operand = Operand(tuple(terms_of(text, stemmed)), True) if quoted and len(token) > 1 else word_operand(token, stemmed)
        out.operands.append((pending, operand))
        pending = "AND"
    out.scoring = terms_of(" ".join(texts), stemmed)
    return out


def _flag(operand: Operand, name: str) -> tuple[list[Column], Column]:
    """(aggregates over a document's postings, the condition on them)."""
    if not operand.terms:
        return [], F.lit(False)
    if len(operand.terms) == 1:
        return [F.bool_or(F.col("term") == operand.terms[0]).alias(name)], F.col(name)
    columns = [F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"{name}_{i}") for i, t in enumerate(operand.terms)]
    rest = [lambda p, i=i: F.array_contains(F.col(f"{name}_{i}"), p + i) for i in range(1, len(operand.terms))]
    there = reduce(lambda a, b: a & b, [F.col(f"{name}_{i}").isNotNull() for i in range(len(operand.terms))])
    return columns, there & F.exists(F.col(f"{name}_0"), lambda p: reduce(lambda a, b: a & b, [f(p) for f in rest]))


def folded(operands: list[tuple[str, Column]]) -> Column:
    """The operands' conditions folded from the left; the first operator isn't looked at."""
    result = operands[0][1]
    for operator, condition in operands[1:]:
        if operator == "AND":
            result = result & condition
        elif operator == "OR":
            result = result | condition
        elif operator == "NOT":
            result = result & ~condition
        else:
            raise ValueError(f"unknown operator: {operator}")
    return result


def matches(index: Index, operands: list[tuple[str, Operand]], scored: tuple[Column, list[str]] | None = None, postings: DataFrame | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, and score if asked for, and more aggregates by name) of the documents that the operands select.

    A match has at least one operand's term, so postings of other terms are never read: the filter on term reaches the scan,
    and one aggregation by doc_id tells every operand's truth. scored: an expression to sum, and the terms it needs.
    """
    parts = [_flag(o, f"m{i}") for i, (_, o) in enumerate(operands)]
    wanted = {t for _, o in operands for t in o.terms} | set(scored[1] if scored else ())
    rows = (index.postings if postings is None else postings).where(F.col("term").isin(sorted(wanted)))
    aggregates = [a for columns, _ in parts for a in columns] + ([F.sum(scored[0]).alias("score")] if scored else []) + [c.alias(n) for n, c in (more or {}).items()]
    kept = ["doc_id", *(["score"] if scored else []), *(more or {})]
    if not operands or not any(o.terms for _, o in operands):
        return rows.where(F.lit(False)).groupBy("doc_id").agg(*(aggregates or [F.count("*").alias("n")])).select(*kept)
    chosen = rows.groupBy("doc_id").agg(*aggregates).where(F.coalesce(folded([(op, F.coalesce(c, F.lit(False))) for (op, _), (_, c) in zip(operands, parts, strict=True)]), F.lit(False)))
    return chosen.select(*kept)


def search_ids(index: Index, query: str, stemmed: bool = True) -> DataFrame:
    """(doc_id) of the documents that a query in the query language selects."""
    return matches(index, parse(query, stemmed).operands)


def search_and(index: Index, words: list[str], stemmed: bool = True) -> DataFrame:
    """Documents with all words; none for no words."""
    return matches(index, [("AND", word_operand(w, stemmed)) for w in words])


def search_or(index: Index, words: list[str], stemmed: bool = True) -> DataFrame:
    """Documents with any word."""
    return matches(index, [("OR", word_operand(w, stemmed)) for w in words])


def search_not(index: Index, word: str, stemmed: bool = True) -> DataFrame:
    """All documents without the word."""
    return index.doc_stats.select("doc_id").join(matches(index, [("AND", word_operand(word, stemmed))]), "doc_id", "left_anti")


def evaluate(index: Index, pairs: list[tuple[str, str]], stemmed: bool = True) -> DataFrame:
    """(operator, word) pairs folded from the left; an unknown operator after the first is an error."""
    for operator, _ in pairs[1:]:
        if operator not in OPERATORS:
            raise ValueError(f"unknown operator: {operator}")
    return matches(index, [(op, word_operand(w, stemmed)) for op, w in pairs])


def search_phrase(index: Index, phrase: str, stemmed: bool = True) -> DataFrame:
    """Documents with the phrase's terms side by side; stopwords between them don't count."""
    return matches(index, [("AND", Operand(tuple(terms_of(phrase, stemmed)), True))])


def boolean_search(index: Index, query: str, stemmed: bool = True) -> DataFrame:
    """(doc_id, title, source_path), by doc_id."""
    return search_ids(index, query, stemmed).join(index.documents, "doc_id").select("doc_id", "title", "source_path").orderBy("doc_id")

