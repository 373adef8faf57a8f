"""Prefix suggestions in the order in which a character tree walks its words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize


def vocabulary(documents: DataFrame, text: str = "raw_text") -> DataFrame:
    """(word, first_seen): the distinct tokens, unstemmed and with stopwords; first_seen is (doc_id, place) of the first."""
    # The outer form keeps Spark from computing the tokens a second time for a filter on their number.
    tokens = documents.select("doc_id", F.posexplode_outer(tokenize(F.col(text))).alias("pos", "word")).where(F.col("word").isNotNull())
    return tokens.groupBy("word").agg(F.min(F.struct("doc_id", "pos")).alias("first_seen"))


def insert(vocabulary: DataFrame, words: DataFrame) -> DataFrame:
    """Words (word, first_seen) added; the empty word is none, and a word keeps its first place."""
    return vocabulary.unionByName(words.where(F.col("word") != "")).groupBy("word").agg(F.min("first_seen").alias("first_seen"))


def delete(vocabulary: DataFrame, words: DataFrame) -> DataFrame:
    return vocabulary.join(words.select("word").distinct(), "word", "left_anti")


def contains(vocabulary: DataFrame, word: str) -> bool:
    return vocabulary.where(F.col("word") == word).limit(1).count() == 1


def starts_with(vocabulary: DataFrame, prefix: str) -> bool:
    return vocabulary.where(F.col("word").startswith(prefix)).limit(1).count() == 1


def autocomplete(vocabulary: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    """(word) with the prefix, a word before its extensions, siblings by which letter came first.

    The order is that of the list of first_seen of all the word's prefixes beyond the given one; only words with the prefix are read,
    and the scan gets that condition.
    """
    found = vocabulary.where(F.col("word").startswith(prefix))
    lengths = F.sequence(F.lit(len(prefix)), F.length("word"))
    each = found.select("word", "first_seen", F.explode(lengths).alias("n"))
    firsts = each.groupBy(F.substring("word", F.lit(1), F.col("n")).alias("start")).agg(F.min("first_seen").alias("came"))
    keyed = each.withColumn("start", F.substring("word", F.lit(1), F.col("n"))).join(firsts, "start")
    order = keyed.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "came"))), lambda x: x["came"]).alias("key"))
    ordered = order.orderBy("key", "word").select("word")
    return ordered if limit is None else ordered.limit(limit)


def suggest(vocabulary: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """autocomplete() of the prefix in lower case."""
    return autocomplete(vocabulary, prefix.lower(), limit)


def suggest_for_input(vocabulary: DataFrame, typed: str, limit: int = 8) -> DataFrame:
    """Suggestions for the last word of what has been typed, once it has two letters."""
    last = typed.split(" ")[-1]
    return suggest(vocabulary, last, limit) if len(last) >= 2 else vocabulary.select("word").limit(0)
