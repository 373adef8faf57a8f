import pytest
from pyspark.sql import functions as F

from skerry.operators import crawl, graph


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src string, dst string, seq long")


GRAPH = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E")]


def test_accessors(spark):
    edges = graph.graph_edges(edges_of(spark, [*GRAPH, ("A", "B")]))
    assert edges.count() == 5
    assert [r["dst"] for r in graph.neighbors(edges, "A").collect()] == ["B", "C"]
    assert graph.has_edge(edges, "A", "B") and not graph.has_edge(edges, "B", "A")
    both = graph.graph_edges(edges_of(spark, GRAPH), directed=False)
    assert graph.edge_count(both, directed=False) == 5
    assert graph.has_edge(both, "B", "A")
    assert graph.graph_nodes(edges, spark.createDataFrame([("Z",)], "id string")).count() == 6
    assert {r["src"]: r["out_degree"] for r in graph.degrees(edges).collect()}["A"] == 2


def test_traversals(spark):
    edges = edges_of(spark, GRAPH)
    assert [r["id"] for r in graph.bfs_order(edges, "A").orderBy("visit").collect()] == list("ABCDE")
    assert [r["id"] for r in graph.dfs(edges, "A").orderBy("visit").collect()] == list("ABDEC")
    assert graph.shortest_path(edges, "A", "E") == ["A", "B", "D", "E"]
    assert graph.shortest_path(edges, "E", "A") is None
    assert graph.shortest_path(edges, "C", "C") == ["C"]
    assert graph.bfs(edges, "nowhere").count() == 0 == graph.dfs(edges, "nowhere").count()


def test_pagerank(spark):
    edges = edges_of(spark, [("A", "B"), ("B", "A")])
    assert {r["id"]: r["authority"] for r in graph.pagerank(graph.graph_nodes(edges), edges).collect()} == pytest.approx({"A": 0.5, "B": 0.5})
    dangling = edges_of(spark, [("A", "B"), ("A", "C"), ("C", "B")])
    ranks = {r["id"]: r["authority"] for r in graph.pagerank(graph.graph_nodes(dangling), dangling).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0)
    assert ranks["B"] == max(ranks.values())
    alone = spark.createDataFrame([("x",)], "id string")
    assert graph.pagerank(alone, edges.limit(0)).first()["authority"] == pytest.approx(1.0)
    assert graph.pagerank(alone.limit(0), edges.limit(0)).count() == 0


WEB = {
    "http://a.test/": '<title>Home</title><a href="/one">1</a> <a href="two#x">2</a> <a href="mailto:x@y">m</a> <a href="/one">again</a> <a href="/admin/secret">s</a>',
    "http://a.test/one": '<a href="http://b.test:8080/">b</a><a href="/broken">x</a>',
    "http://a.test/two": "<p>no links</p>",
    "http://a.test/admin/secret": "hidden",
    "http://b.test:8080/": '<title> </title><a href="http://a.test/">back</a>',
}


def test_links():
    assert crawl.links_of(WEB["http://a.test/"], "http://a.test/x/") == ["http://a.test/one", "http://a.test/x/two", "http://a.test/admin/secret"]
    assert crawl.links_of('<a href="../up?q=1&amp;r=2"></a><a>no</a><a href=" "></a>', "https://h/a/b/c") == ["https://h/a/up?q=1&r=2"]
    assert crawl.links_of(None, "http://h/") == []


def allowed(spark, text, path, agent="Bot"):
    rules = crawl.rules_for(crawl.parse_robots(F.lit(text)), agent)
    row = spark.range(1).select(crawl.robots_allowed(rules, F.lit(path)).alias("a"), crawl.crawl_delay(rules).alias("d")).first()
    return row["a"], row["d"]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private # no\nAllow: /private/open\nCrawl-delay: 1.5\n\nUser-agent: Other\nUser-agent: Bot2\nDisallow: /\nCrawl-delay: x\n"
    assert allowed(spark, text, "/private/x") == (False, 1.5)
    assert allowed(spark, text, "/private/open/x")[0]
    assert allowed(spark, text, "/a", "Bot2") == (False, None)
    assert allowed(spark, text, "/a", "bot2") == (True, 1.5)
    assert allowed(spark, "", "/a") == (True, None)
    assert allowed(spark, "User-agent: *\nDisallow:\n", "/a")[0]
    assert allowed(spark, "User-agent: *\nDisallow: /p\nAllow: /p\n", "/p")[0]


def test_crawl(spark):
    web = spark.createDataFrame(list(WEB.items()), "url string, html string")
    robots = spark.createDataFrame([("a.test", "User-agent: *\nDisallow: /admin/\n")], "domain string, txt string")
    found = crawl.crawl(web, ["http://a.test/"], robots)
    assert [r["url"] for r in found.pages.orderBy("crawl_order").collect()] == ["http://a.test/", "http://a.test/one", "http://a.test/two", "http://b.test:8080/"]
    assert {r["url"]: r["title"] for r in found.pages.collect()}["http://a.test/"] == "Home"
    assert ("http://a.test/", "http://a.test/admin/secret") in {(r["src"], r["dst"]) for r in found.edges.collect()}
    assert crawl.crawl(web, ["http://a.test/"], robots, max_pages=2).pages.count() == 2


def test_urls_and_politeness(spark):
    row = spark.range(1).select(crawl.domain(F.lit("http://h.test:81/x?y")).alias("d"), crawl.url_path(F.lit("http://h.test?q")).alias("p")).first()
    assert (row["d"], row["p"]) == ("h.test:81", "/")
    fetches = spark.createDataFrame([("d", 100.0, 2.0), ("d", 101.5, 2.0), ("d", 104.0, 2.0), ("e", 1.0, None)], "domain string, ts double, delay double")
    assert [r["wait"] for r in crawl.crawl_waits(fetches).orderBy("domain", "ts").collect()] == [0.0, 0.5, 0.0, 0.0]
    plan = spark.createDataFrame([("d", 0, 0.0, 1.0), ("d", 1, 0.2, 1.0), ("d", 2, 5.0, 1.0)], "domain string, seq long, ready double, delay double")
    assert [r["earliest"] for r in crawl.crawl_schedule(plan).orderBy("seq").collect()] == [0.0, 1.0, 5.0]
    urls = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2)], "url string, seq long")
    assert [r["url"] for r in crawl.frontier(urls).collect()] == ["a", "b"]
