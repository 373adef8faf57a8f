"""The Porter stemmer as one Catalyst expression, as DuckDB SQL for oracles, and as Python with a memo for the index build."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and their replacements by step; of the suffixes that fit a word the longest decides.
STEP_1A = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = tuple((s, "") for s in "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize ion".split())

_CONSONANTS = "bcdfghjklmnpqrstvwxz0123456789"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _form(word: Column) -> Column:
    """C for each consonant, V for each vowel; y is a consonant at the start and after a vowel."""
    form = F.translate(word, _CONSONANTS + "aeiou", "C" * len(_CONSONANTS) + "VVVVV")
    form = F.regexp_replace(form, "^y", "C")
    for _ in range(2):
        form = F.replace(F.replace(form, F.lit("Cy"), F.lit("CV")), F.lit("Vy"), F.lit("VC"))
    follow = lambda seen, c: F.concat(seen, F.when(c != "y", c).when(seen.endswith("V"), "C").otherwise("V"))
    return _let(form, lambda f: F.when(~F.contains(f, F.lit("y")), f).otherwise(F.aggregate(F.split(f, ""), F.lit(""), follow)))


def _measure(form: Column) -> Column:
    return F.regexp_count(form, F.lit("VC"))


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _rules(word: Column, form: Column, rules, least: int | None) -> Column:
    """The word after the rule of its longest suffix; with least, only if the stem's measure is at least so much."""
    out = None
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        changed = F.concat(_cut(word, len(suffix)), F.lit(new))
        if least is not None:
            fits = _measure(_cut(form, len(suffix))) >= least
            if suffix == "ion":
                fits = fits & _cut(word, 3).rlike("[st]$")
            changed = F.when(fits, changed).otherwise(word)
        test = word.endswith(suffix)
        out = F.when(test, changed) if out is None else out.when(test, changed)
    return out.otherwise(word)


def _double(word: Column, form: Column) -> Column:
    return word.rlike(r"(.)\1$") & form.endswith("C")


def _cvc(word: Column, form: Column) -> Column:
    return form.endswith("CVC") & word.rlike("[^wxy]$")


def _step_1b(word: Column) -> Column:
    def tidy(stem: Column) -> Column:
        return _let(_form(stem), lambda f: F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e"))).when(_double(stem, f) & ~stem.rlike("[lsz]$"), _cut(stem, 1)).when((_measure(f) == 1) & _cvc(stem, f), F.concat(stem, F.lit("e"))).otherwise(stem))

    def by_form(form: Column) -> Column:
        def ending(n: int) -> Column:
            return F.when(F.contains(_cut(form, n), F.lit("V")), _let(_cut(word, n), tidy)).otherwise(word)

        return F.when(word.endswith("eed"), F.when(_measure(_cut(form, 3)) > 0, _cut(word, 1)).otherwise(word)).when(word.endswith("ing"), ending(3)).when(word.endswith("ed"), ending(2)).otherwise(word)

    return _let(_form(word), by_form)


def _step_1c(word: Column) -> Column:
    return F.when(word.endswith("y") & F.contains(_cut(_form(word), 1), F.lit("V")), F.concat(_cut(word, 1), F.lit("i"))).otherwise(word)


def _step_5a(word: Column) -> Column:
    def by_form(form: Column) -> Column:
        stem, short = _cut(word, 1), _cut(form, 1)
        return F.when(word.endswith("e") & ((_measure(short) > 1) | ((_measure(short) == 1) & ~_cvc(stem, short))), stem).otherwise(word)

    return _let(_form(word), by_form)


def _step_5b(word: Column) -> Column:
    return F.when(word.endswith("ll") & (_measure(_form(word)) > 1), _cut(word, 1)).otherwise(word)


def porter_stem(word: Column) -> Column:
    """The Porter stem of a lower-case ASCII word; words of two letters or fewer stay as they are.

    Each step's word is bound once, so the expression stays small and in the JVM. Meant for vocabularies, which are short.
    """
    steps: list[Callable[[Column], Column]] = [
        lambda w: _rules(w, w, STEP_1A, None),
        _step_1b,
        _step_1c,
        lambda w: _let(_form(w), lambda f: _rules(w, f, STEP_2, 1)),
        lambda w: _let(_form(w), lambda f: _rules(w, f, STEP_3, 1)),
        lambda w: _let(_form(w), lambda f: _rules(w, f, STEP_4, 2)),
        _step_5a,
        _step_5b,
    ]
    return F.when(F.length(word) <= 2, word).otherwise(reduce(_let, steps, word))


def stem_sql(table: str, word: str = "token") -> str:
    """DuckDB: a query of (token, stem) for the distinct words of a table expression."""
    form = lambda w: (
        f"replace(replace(replace(replace(replace(replace(regexp_replace(translate({w}, '{_CONSONANTS}aeiou', '{'C' * len(_CONSONANTS)}VVVVV'), '^y', 'C'), 'Cy', 'CV'), 'Vy', 'VC'), 'Cy', 'CV'), 'Vy', 'VC'), 'Cy', 'CV'), 'Vy', 'VC')"
    )
    cut = lambda w, n: f"left({w}, length({w}) - {n})"
    m = lambda f: f"len(regexp_extract_all({f}, 'VC'))"
    cvc = lambda w, f: f"(ends_with({f}, 'CVC') AND regexp_matches({w}, '[^wxy]$'))"

    def rules(rows, least):
        out = []
        for suffix, new in sorted(rows, key=lambda r: -len(r[0])):
            changed = f"{cut('w', len(suffix))} || '{new}'"
            if least is not None:
                fits = f"{m(cut('f', len(suffix)))} >= {least}" + (f" AND regexp_matches({cut('w', 3)}, '[st]$')" if suffix == "ion" else "")
                changed = f"CASE WHEN {fits} THEN {changed} ELSE w END"
            out.append(f"WHEN ends_with(w, '{suffix}') THEN {changed}")
        return "CASE " + " ".join(out) + " ELSE w END"

    tidy = f"CASE WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN length(w) > 1 AND substr(w, length(w), 1) = substr(w, length(w) - 1, 1) AND ends_with(f, 'C') AND NOT regexp_matches(w, '[lsz]$') THEN {cut('w', 1)} WHEN {m('f')} = 1 AND {cvc('w', 'f')} THEN w || 'e' ELSE w END"
    vowel = lambda n: f"contains({cut('f', n)}, 'V')"
    steps = [
        rules(STEP_1A, None),
        # The ending goes in one step and the stem is tidied in the next; z tells whether it is to be.
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {m(cut('f', 3))} > 0 THEN {cut('w', 1)} ELSE w END WHEN ends_with(w, 'ing') THEN CASE WHEN {vowel(3)} THEN {cut('w', 3)} || '\t' ELSE w END WHEN ends_with(w, 'ed') THEN CASE WHEN {vowel(2)} THEN {cut('w', 2)} || '\t' ELSE w END ELSE w END",
        "TIDY",
        f"CASE WHEN ends_with(w, 'y') AND {vowel(1)} THEN {cut('w', 1)} || 'i' ELSE w END",
        rules(STEP_2, 1),
        rules(STEP_3, 1),
        rules(STEP_4, 2),
        f"CASE WHEN ends_with(w, 'e') AND ({m(cut('f', 1))} > 1 OR ({m(cut('f', 1))} = 1 AND NOT {cvc(cut('w', 1), cut('f', 1))})) THEN {cut('w', 1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {m('f')} > 1 THEN {cut('w', 1)} ELSE w END",
    ]
    query = f"SELECT DISTINCT {word} AS token, {word} AS w FROM {table}"
    for step in steps:
        if step == "TIDY":
            inner = f"SELECT token, rtrim(w, '\t') AS w, ends_with(w, '\t') AS z, {form("rtrim(w, '\t')")} AS f FROM ({query})"
            query = f"SELECT token, CASE WHEN z THEN {tidy} ELSE w END AS w FROM ({inner})"
        else:
            query = f"SELECT token, {step} AS w FROM (SELECT token, w, {form('w')} AS f FROM ({query}))"
    return f"SELECT token, CASE WHEN length(token) <= 2 THEN token ELSE w END AS stem FROM ({query})"


_VOWEL_RUN = re.compile("VC")


def _python_form(word: str) -> str:
    out = []
    for c in word:
        out.append("V" if c in "aeiou" or (c == "y" and out and out[-1] == "C") else "C")
    return "".join(out)


def stem(word: str) -> str:
    """The same stem in Python, for the memo of the index build and for queries, which are parsed on the driver."""
    if len(word) <= 2:
        return word

    def measure(s: str) -> int:
        return len(_VOWEL_RUN.findall(_python_form(s)))

    def cvc(s: str) -> bool:
        return _python_form(s).endswith("CVC") and s[-1] not in "wxy"

    def by_rules(w: str, rules, least: int | None) -> str:
        for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(suffix):
                s = w[: -len(suffix)]
                fits = least is None or (measure(s) >= least and (suffix != "ion" or s.endswith(("s", "t"))))
                return s + new if fits else w
        return w

    w = by_rules(word.lower(), STEP_1A, None)
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) else w
    elif w.endswith(("ing", "ed")):
        s = w[:-3] if w.endswith("ing") else w[:-2]
        if "V" in _python_form(s):
            if s.endswith(("at", "bl", "iz")):
                w = s + "e"
            elif len(s) > 1 and s[-1] == s[-2] and _python_form(s)[-1] == "C" and s[-1] not in "lsz":
                w = s[:-1]
            else:
                w = s + "e" if measure(s) == 1 and cvc(s) else s
    if w.endswith("y") and "V" in _python_form(w[:-1]):
        w = w[:-1] + "i"
    w = by_rules(by_rules(by_rules(w, STEP_2, 1), STEP_3, 1), STEP_4, 2)
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w
