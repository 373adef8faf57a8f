"""URL filter: pattern rules indexed by their rarest literal token; only the rules that a URL's tokens fetch run their patterns."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """A pattern over host + path. tokens: [A-Za-z0-9]+ runs that each matching URL has, whole or with digits after them; none: the rule is tried on all."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int
    listed: bool = field(default=True)  # its name is reported as the rule that decided


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """The rule for a host with all its subdomains and the paths that begin with path; longer rules weigh more."""
    literal = f"{host}{path}"
    whole = re.findall(TOKEN, literal)
    if whole and re.search(TOKEN + "$", literal):
        whole.pop()  # its last token may go on in the URL
    return Rule(literal, verdict, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(whole), len(literal))


def pattern_rule(name: str, verdict: str, pattern: str, tokens: Iterable[str]) -> Rule:
    """A rule of the method's own list: consulted where no host rule fits."""
    return Rule(name, verdict, pattern, tuple(tokens), 0, False)


#: The host rules in force.
HOST_RULES = (
    host_rule("org", "/", "allow"),
    host_rule("example.org", "/es/", "block"),
    host_rule("example.org", "/en/1", "block"),
    host_rule("com", "/fr/", "allow"),
    host_rule("com", "/de/", "block"),
)

#: The method's own patterns, for URLs that no host rule fits; where none of these fits either, a URL is allowed.
OWN_RULES = (
    pattern_rule("spam-farm", "block", r"(?:[^/]*\.)?spam-farm\.[^/]*(?:/.*)?$", ("spam", "farm")),
    pattern_rule("casino", "block", r"[^/]*\bcasino\b", ("casino",)),
    pattern_rule("ads", "block", r"(?:[^/]*\.)?ads\d*\.", ("ads",)),
    pattern_rule("adserver", "block", r"(?:[^/]*\.)?adserver\d*\.", ("adserver",)),
    pattern_rule("login", "block", r"[^/]*/(?:.*/)?login(?:/|$)", ("login",)),
)


def rarest_tokens(urls: DataFrame, column: str, rules: Iterable[Rule]) -> dict[str, int]:
    """How often each token of the rules stands in the URLs of the whole table: a row for each rule token at most."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    whole = F.regexp_extract_all(F.col(column).cast("string"), F.lit(f"({TOKEN})"), F.lit(1))
    stripped = F.transform(whole, lambda t: F.regexp_replace(t, "[0-9]+$", ""))
    tokens = F.array_intersect(F.concat(whole, stripped), F.array(*map(F.lit, wanted)))
    counted = urls.select(F.explode(tokens).alias("token")).groupBy("token").count().collect()
    return {t: 0 for t in wanted} | {x["token"]: x["count"] for x in counted}


def build_index(rules: Iterable[Rule], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """(rules by their rarest token, rules without a token)."""
    index, always = defaultdict(list), []
    for rule in rules:
        if rule.tokens:
            index[min(rule.tokens, key=lambda t: (counts.get(t, 0), t))].append(rule)
        else:
            always.append(rule)
    return dict(index), always


UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host after the first ://, A-Z in lower case; both empty without :// or for null."""
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(UPPER_TO_LOWER), slash + path


def _judge(index: dict[str, list[Rule]], always: list[Rule], id_column: str, url_column: str, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r: re.compile(r.pattern, re.DOTALL).match for rules in [*index.values(), always] for r in rules}
        tokens = re.compile(TOKEN).findall
        for batch in slices(batches, url_column):
            hosts, paths, names, verdicts = [], [], [], []
            for url in batch.column(url_column).to_pylist():
                host, path = split_url(url)
                subject = host + path
                best = None
                found = {*tokens(subject)}
                found |= {t.rstrip("0123456789") for t in found}
                for rule in (r for rules in [always, *(index[t] for t in found if t in index)] for r in rules):
                    if compiled[rule](subject) and (best is None or (rule.listed, rule.weight, rule.name) > (best.listed, best.weight, best.name)):
                        best = rule
                hosts.append(host)
                paths.append(path)
                names.append(best.name if best and best.listed else None)
                verdicts.append(best.verdict if best else default)
            yield pa.RecordBatch.from_arrays([batch.column(id_column), *(pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts))], [id_column, "host", "path", "rule", "verdict"])

    return run


def filter_urls(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules: Iterable[Rule] = HOST_RULES + OWN_RULES, default: str = "allow") -> DataFrame:
    """The verdict on every URL: (id, host, path, rule, verdict).

    Token counts over all URLs tell which literal token of each rule is rarest; the index from that token to its rules,
    whose size is that of the rule list (at most some hundred thousand rules), goes to the executors. The URLs are then judged
    where they lie, without a shuffle. Of the fitting host rules the longest decides, ties by name; rule is null where
    a pattern of the method's own or the default decides. A null URL or one without :// has empty host and path.
    Only the two named columns are read; repeated rows give repeated rows; an empty table gives an empty one.
    """
    rules = list(rules)
    rows = pages.select(F.col(id_column).cast("long").alias(id_column), F.col(url_column).cast("string").alias(url_column))
    index, always = build_index(rules, rarest_tokens(rows, url_column, rules))
    return rows.mapInArrow(_judge(index, always, id_column, url_column, default), f"`{id_column}` long, host string, path string, rule string, verdict string")
