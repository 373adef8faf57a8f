"""Crawling over page tables: links, robots rules, politeness, and the breadth-first crawl."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import count as numbers
from itertools import groupby
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..sources.cut import table_cut
from ..sources.documents import title_of
from .numbering import numbered


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attributes):
        if tag == "a" and (href := next((v for k, v in attributes if k == "href"), None)) and href.strip():
            self.found.append(href.strip())

    handle_startendtag = handle_starttag


def links_of(html: str | None, base: str) -> list[str]:
    """The page's links in order, each once: absolute, http or https, without fragment."""
    parser = _Links()
    parser.feed(html or "")
    parser.close()
    out = []
    for href in parser.found:
        try:
            url = urlparse(urljoin(base, href))
        except ValueError:
            continue
        if url.scheme in ("http", "https"):
            out.append(url._replace(fragment="").geturl())
    return list(dict.fromkeys(out))


@F.pandas_udf(ArrayType(StringType()))
def extract_links(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([links_of(h, b or "") for h, b in zip(html, base, strict=True)])


@F.pandas_udf(StringType())
def extract_title(html: pd.Series) -> pd.Series:
    return html.map(title_of)


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, seq) of pages(url, html)."""
    return pages.select(F.col("url").alias("src"), F.posexplode(extract_links("html", "url")).alias("seq", "dst")).select("src", "dst", "seq")


def domain(url: Column) -> Column:
    """Host with port."""
    return F.coalesce(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1), F.lit(""))


def url_path(url: Column) -> Column:
    """The path without query and fragment; / where there is none."""
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


RULES = ArrayType(StructType().add("agent", "string").add("kind", "string").add("pattern", "string").add("delay", "double"))


#: A line of a robots file: a name, a colon, a value; # begins a comment.
LINE = re.compile(r"([^#:]*):([^#]*)")
DIRECTIVES = ("user-agent", "allow", "disallow", "crawl-delay")


def _delay(value: str) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def robots_rules(text: str | None) -> list[dict]:
    """A robots file as rows (agent, kind, pattern, delay); kind is agent, allow, disallow or delay.

    Known lines come in runs, of agents and of rules in turn; a run of rules holds for the run of agents before it, and none
    holds for rules before any agent. An empty Disallow is no rule; an empty Allow fits all paths. The last delay of an agent holds, a bad one is none.
    """
    named = [(m[1].strip().lower(), m[2].strip()) for m in map(LINE.match, (text or "").splitlines()) if m]
    rows: list[tuple] = []
    agents: list[str] = []
    for is_agent, run in groupby((x for x in named if x[0] in DIRECTIVES), key=lambda x: x[0] == "user-agent"):
        values = list(run)
        if is_agent:
            agents = [agent for _, agent in values]
            rows += [(agent, "agent", None, None) for agent in agents]
            continue
        rules = [("delay", None, _delay(value)) if kind == "crawl-delay" else (kind, value, None) for kind, value in values if value or kind != "disallow"]
        rows += [(agent, *rule) for rule in rules for agent in agents]
    return [dict(zip(("agent", "kind", "pattern", "delay"), row, strict=True)) for row in rows]


@F.pandas_udf(RULES)
def parse_robots(text: pd.Series) -> pd.Series:
    return text.map(robots_rules)


def rules_for(rules: Column, agent: str) -> Column:
    """The rows that hold for an agent: its own if it is named (in this very case), else those of *."""
    own = F.filter(rules, lambda r: r["agent"] == agent)
    return F.when(F.size(own) > 0, own).otherwise(F.filter(rules, lambda r: r["agent"] == "*"))


def _longest(rules: Column, kind: str, path: Column) -> Column:
    fit = F.filter(rules, lambda r: (r["kind"] == kind) & path.startswith(r["pattern"]))
    return F.coalesce(F.array_max(F.transform(fit, lambda r: F.length(r["pattern"]))), F.lit(-1))


def robots_allowed(rules: Column, path: Column) -> Column:
    """Whether the rules for an agent let it fetch the path: the longest fitting prefix decides, a tie allows."""
    return F.coalesce(_longest(rules, "allow", path) >= _longest(rules, "disallow", path), F.lit(True))


def crawl_delay(rules: Column) -> Column:
    """The delay of the rules for an agent, null without one."""
    return F.try_element_at(F.transform(F.filter(rules, lambda r: r["kind"] == "delay"), lambda r: r["delay"]), F.lit(-1))


def crawl_waits(fetches: DataFrame, default_delay: float = 1.0) -> DataFrame:
    """fetches(domain, ts, delay) with the wait before each: what is left of the domain's delay since its fetch before."""
    before = F.lag("ts").over(Window.partitionBy("domain").orderBy("ts"))
    return fetches.withColumn("wait", F.coalesce(F.greatest(F.lit(0.0), F.coalesce("delay", F.lit(default_delay)) - (F.col("ts") - before)), F.lit(0.0)))


def crawl_schedule(fetches: DataFrame, default_delay: float = 1.0) -> DataFrame:
    """fetches(domain, seq, ready, delay) with earliest: when each may go out if each waits for the one before in its domain.

    earliest[i] = max(ready[i], earliest[i-1] + delay) = i*delay + max over j <= i of (ready[j] - j*delay) for a domain's one delay.
    """
    order = Window.partitionBy("domain").orderBy("seq")
    place = F.row_number().over(order) - 1
    delay = F.coalesce("delay", F.lit(default_delay))
    slack = F.max(F.col("ready") - F.col("_place") * delay).over(order)
    return fetches.withColumn("_place", place).withColumn("earliest", slack + F.col("_place") * delay).drop("_place")


@dataclass(frozen=True)
class Crawl:
    """pages(url, html, title, level, crawl_order), edges(src, dst, seq)."""

    pages: DataFrame
    edges: DataFrame


def crawl(web: DataFrame, seeds: list[str], robots: DataFrame | None = None, agent: str = "SearchEngineBot", max_pages: int | None = None, most_levels: int | None = None) -> Crawl:
    """Breadth-first over web(url, html) from the seeds; robots(domain, txt) decide what may be fetched.

    A level is a join of the frontier with the pages; its order is (place of the parent, place of the link), carried as an array.
    A url is taken once, by its first place. Refused and missing pages don't count toward max_pages, but stay in the
    link graph as targets. Each robots file is parsed once. Levels go on until nothing new is found; more than most_levels are an error.
    """
    spark = web.sparkSession
    edges = table_cut(link_edges(web), "links")
    frontier = spark.createDataFrame([(u, [i]) for i, u in enumerate(dict.fromkeys(seeds))], "url string, place array<long>")
    parsed = None
    if robots is not None:
        parsed = table_cut(robots.select(F.col("domain").alias("_domain"), rules_for(parse_robots("txt"), agent).alias("rules")), "robots")
    seen = table_cut(frontier.select("url"), "seen")
    fetched = None
    count = 0
    for level in numbers():
        if most_levels is not None and level >= most_levels:
            raise RuntimeError(f"the crawl has more than {most_levels} levels")
        found = frontier.join(web.select("url", "html"), "url")
        if parsed is not None:
            found = found.join(parsed, domain(F.col("url")) == F.col("_domain"), "left").where(robots_allowed(F.col("rules"), url_path(F.col("url"))))
        found = found.select("url", "html", F.lit(level).alias("level"), "place")
        if max_pages is not None:
            found = found.orderBy("place").limit(max(max_pages - count, 0))
        found = table_cut(found, "fetched")
        here = found.count()
        count += here
        fetched = found if fetched is None else fetched.unionByName(found)
        if not here or (max_pages is not None and count >= max_pages):
            break
        step = found.select("url", "place").join(edges, found["url"] == edges["src"]).select(F.col("dst").alias("url"), F.concat("place", F.array(F.col("seq").cast("long"))).alias("place"))
        frontier = table_cut(step.join(seen, "url", "left_anti").groupBy("url").agg(F.min("place").alias("place")), "frontier")
        seen = table_cut(seen.union(frontier.select("url")), "seen")
    pages = numbered(fetched.withColumn("title", extract_title("html")), ["level", "place"], "crawl_order")
    crawled = edges.join(fetched.select(F.col("url").alias("src")), "src", "left_semi")
    return Crawl(pages.select("url", "html", "title", "level", "crawl_order"), crawled.select("src", "dst", "seq"))


def frontier(urls: DataFrame) -> DataFrame:
    """(url, place): each of urls(url, seq) once, first in first out."""
    return urls.groupBy("url").agg(F.min("seq").alias("place")).orderBy("place")

