"""Text functions as column expressions: tokens, stopwords, words, sentences, snippets, matching positions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stopwords.
STOPWORDS = (
    "a an the and or but if then else is are was were be been being in on at by for with about against "
    "to from of as into through during this that these those i you he she it we they me him her us them "
    "my your his its our their not no nor so too very can will just should now do does did doing "
    "have has had having there here when where why how all any both each few more most other some such only own same"
).split()

# What separates words where Unicode white space does (Java's \s is ASCII only).
WHITE_SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]+"

TOKEN = "[a-zA-Z0-9]+"


def tokenize(text: Column) -> Column:
    """ASCII letter and digit runs, in lower case; lower-casing comes after matching, so other letters split words."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def is_stopword(token: Column) -> Column:
    """Whether the token, as it is, is a stopword."""
    return token.isin(STOPWORDS)


def remove_stopwords(tokens: Column) -> Column:
    """The tokens that are no stopwords, in order and with repeats."""
    return F.filter(tokens, lambda t: ~is_stopword(t))


def words(text: Column) -> Column:
    """The parts of a text between Unicode white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def is_blank(text: Column) -> Column:
    """Whether nothing but white space is there; null is blank."""
    return F.size(words(text)) == 0


def preview(text: Column, length: int = 50) -> Column:
    """The first characters on one line."""
    return F.replace(F.substring(text, 1, length), F.lit("\n"), F.lit(" "))


def file_stem(path: Column) -> Column:
    """The file's name without its last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def file_suffix(path: Column) -> Column:
    """The file's last suffix in lower case, with its dot."""
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def sentences(text: Column) -> Column:
    """The text cut after . ! or ? and white space; blank parts are dropped."""
    return F.filter(F.split(text, r"(?<=[.!?])" + WHITE_SPACE), lambda s: ~is_blank(s))


def snippet(text: Column, query_words: list[str], window: int = 12) -> Column:
    """The words about the first that has any query word in it, else the first ones; "..." follows where words are left out."""
    every = words(text)
    wanted = [w.lower() for w in query_words if w]
    hit = F.array_position(F.transform(every, lambda w: F.exists(F.array(*map(F.lit, wanted)), lambda q: F.contains(F.lower(w), q))), F.lit(True)) if wanted else F.lit(0).cast("long")
    first = F.greatest(hit - 1 - window, F.lit(0))
    last = F.when(hit > 0, F.least(hit - 1 + window, F.size(every))).otherwise(F.least(F.lit(2 * window), F.size(every)))
    first = F.when(hit > 0, first).otherwise(F.lit(0))
    taken = F.slice(every, (first + 1).cast("int"), (last - first).cast("int"))
    return F.concat(F.array_join(taken, " "), F.when(last - first < F.size(every), "...").otherwise(""))


def find_all(text: Column, pattern: str) -> Column:
    """All starts (from 0, overlapping) at which pattern stands in text; none for an empty or a longer pattern."""
    m = len(pattern)
    if not m:
        return F.array().cast("array<int>")
    starts = F.when(F.length(text) >= m, F.sequence(F.lit(0), F.length(text) - m)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.substring(text, i + 1, F.lit(m)) == pattern)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in code points."""
    return F.levenshtein(a, b)


def highlight(text: Column, query_words: list[str]) -> Column:
    """array<struct<text, is_match>>: the text cut at the query words, whatever their case, longest first."""
    wanted = sorted({w.lower() for w in query_words if w}, key=lambda w: (-len(w), w))
    if not wanted:
        return F.array(F.struct(text.alias("text"), F.lit(False).alias("is_match")))
    pattern = "(?i)(" + "|".join(map(_quoted, wanted)) + ")"
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    both = F.zip_with(
        F.transform(between, lambda x: F.struct(x.alias("text"), F.lit(False).alias("is_match"))),
        F.transform(matches, lambda x: F.struct(x.alias("text"), F.lit(True).alias("is_match"))),
        lambda x, y: F.array(x, y),
    )
    return F.filter(F.flatten(both), lambda x: x.isNotNull())


def _quoted(word: str) -> str:
    return re.sub(r"([\\.*+?^${}()|\[\]])", r"\\\1", word)


def sorted_array(values: Column) -> Column:
    """Ascending order; equal values are indistinguishable, so stability needs no care."""
    return F.array_sort(values)


def binary_search(values: Column, wanted: Column) -> Column:
    """The first place (from 0) of wanted in an ascending array, -1 without one."""
    return F.array_position(values, wanted).cast("int") - 1


def lower_bound(values: Column, wanted: Column) -> Column:
    """The leftmost place (from 0) to put wanted into an ascending array."""
    return F.size(F.filter(values, lambda v: v < wanted))


def upper_bound(values: Column, wanted: Column) -> Column:
    """The rightmost place (from 0) to put wanted into an ascending array."""
    return F.size(F.filter(values, lambda v: v <= wanted))
