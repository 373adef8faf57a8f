import json

import pytest
from pyspark.sql import functions as F

from skerry.operators import analytics, collections
from skerry.operators.index import build_index
from skerry.operators.rank import search_ranked
from skerry.plans import profile
from skerry.plans.engine import SearchEngine, TooManyRequests, Unauthorised
from skerry.sources import documents as D
from skerry.sources.tables import append_documents, load_index, save_index
from skerry.streaming import limiter


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a-b.txt").write_bytes(b"Python programming\r\nis fun \xff")
    (tmp_path / "a" / "page.HTML").write_text("<title>My page</title><style>x{}</style><p>Java &amp; <b>Python</b></p><script>var python;</script>", encoding="utf-8")
    (tmp_path / "notes.md").write_text("intro\n\n# Big Title\n\nSome **bold** text with `code` and [a link](http://x).\n\n- item\n", encoding="utf-8")
    (tmp_path / "empty.txt").write_text(" \n")
    (tmp_path / "skip.csv").write_text("python")
    return tmp_path


def test_folder(spark, folder):
    rows = D.load_folder(spark, str(folder)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["title"], r["source_type"]) for r in rows] == [(1, "My page", "html"), (2, "a-b", "txt"), (3, "Big Title", "markdown")]
    assert rows[0]["raw_text"].split("\n") == ["My page", "Java &", "Python"]
    assert rows[1]["raw_text"] == "Python programming\nis fun �"
    assert rows[2]["raw_text"].split("\n") == ["intro", "Big Title", "Some", "bold", "text with", "code", "and", "a link", ".", "item"]
    with pytest.raises(FileNotFoundError):
        D.load_folder(spark, str(folder / "nowhere"))
    with pytest.raises(Exception, match="no text"):
        D.documents_from_files(D._files(spark, str(folder / "empty.txt")).withColumn("source_type", F.lit("txt")), skip_empty=False).collect()
    assert D.load_texts(spark, [str(folder / "a-b.txt")]).first()["text"].startswith("Python")


def test_html_and_embeddings(spark, tmp_path):
    assert D.text_of("<!-- c --><p>a<br>b</p>") == "a\nb"
    assert D.title_of("<title></title><title>x</title>") is None
    (tmp_path / "e.json").write_text(json.dumps({"a": [1.0, 2.0], "b": [0.0, 1.0]}))
    assert D.load_embeddings(spark, str(tmp_path / "e.json")).count() == 2
    (tmp_path / "n.json").write_text("{}")
    with pytest.raises(ValueError, match="no embeddings"):
        D.load_embeddings(spark, str(tmp_path / "n.json"))
    corpus = D.synthetic_corpus(spark, 5, 7)
    assert corpus.count() == 5 and len(corpus.first()["tokens"]) == 7


def test_engine(spark, folder, tmp_path, monkeypatch):
    engine = SearchEngine(spark, analytics.QueryLog(spark, str(tmp_path / "log")))
    assert engine.get_health() == {"status": "ok"}
    monkeypatch.setenv("SKERRY_API_KEYS", "k1, k2")
    with pytest.raises(Unauthorised):
        engine.post_index(str(folder), "zzz")
    with pytest.raises(ValueError, match="key"):
        engine.post_index(str(folder), None)
    stats = engine.post_index(str(folder), "k1")
    assert stats["indexed"] == 3 == stats["document_count"]
    assert [r["doc_id"] for r in engine.search("python").collect()] == [1, 2]
    found = engine.get_search("python programming", key="k1", now=0.0)
    assert found["count"] == 1 and found["results"][0]["title"] == "a-b"
    engine.get_search("java", now=0.0)
    assert engine.get_suggest("PROGRAMM", now=0.0)["suggestions"] == ["programming"]
    assert engine.get_history("k1")["total_queries"] == 1
    assert engine.get_analytics("k2")["top_queries"][0]["count"] == 1
    with pytest.raises(ValueError, match="top_k"):
        engine.get_search("x", top_k=101, now=0.0)
    for _ in range(27):
        engine._admit("search", "local", 30, 0.0)
    with pytest.raises(TooManyRequests):
        engine.get_search("python", now=1.0)
    engine.save(str(tmp_path / "saved"))
    other = SearchEngine(spark)
    other.load(str(tmp_path / "saved"))
    assert other.get_stats() == engine.get_stats()
    assert [r["doc_id"] for r in other.search_ranked("python").collect()] == [r["doc_id"] for r in engine.search_ranked("python").collect()]
    engine.remove([1])
    assert engine.document_count == 2


def test_saved_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "doc_id long, raw_text string")
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        load_index(spark, path)
    save_index(build_index(docs), path)
    append_documents(build_index(spark.createDataFrame([(3, "beta gamma")], "doc_id long, raw_text string")), path)
    assert load_index(spark, path).document_frequency("beta") == 3
    with pytest.raises(ValueError, match="indexed already"):
        append_documents(build_index(docs), path)
    plan = load_index(spark, path).get_postings("beta")._jdf.queryExecution().toString()
    assert "EqualTo(term,beta)" in plan
    (tmp_path / "index" / ".meta.json.crc").unlink()
    (tmp_path / "index" / "meta.json").write_text('{"format": "skerry-index", "version": 99}')
    with pytest.raises(ValueError, match="version"):
        load_index(spark, path)


def test_ranked_plan_has_no_python_and_prunes_columns(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"/d/{i}", "txt", "t", f"alpha beta w{i}") for i in range(50)], "doc_id long, source_path string, source_type string, title string, raw_text string")
    save_index(build_index(rows), str(tmp_path / "i"))
    plan = search_ranked(load_index(spark, str(tmp_path / "i")), "alpha NOT w3")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "Python" not in plan and "InArrow" not in plan


def test_profile(spark):
    df = spark.range(100).groupBy((F.col("id") % 3).alias("k")).count()
    assert "HashAggregate" in profile.plan_text(df)
    assert profile.operator_counts(df)["HashAggregate"] == 2
    assert profile.slowest({"a": df, "b": spark.range(1)}, 1).count() == 1


def test_limiter(spark):
    rows = [("c", 100.0, 0), ("c", 100.1, 1), ("c", 100.2, 2), ("c", 110.1, 3), ("c", 115.0, 4), ("d", 100.0, 5)]
    requests = spark.createDataFrame(rows, "client string, ts double, seq long")
    found = {r["seq"]: r["allowed"] for r in limiter.rate_limited(requests, 2, 10.0).collect()}
    assert found == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True}


def test_limiter_stream(spark, tmp_path):
    rows = [("c", 100.0, 0), ("c", 100.1, 1), ("c", 100.2, 2), ("d", 100.0, 3)]
    spark.createDataFrame(rows, "client string, ts double, seq long").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("c", 100.3, 4), ("c", 115.0, 5)], "client string, ts double, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema("client string, ts double, seq long").parquet(str(tmp_path / "in"))
        q = limiter.rate_limited_stream(source, 2, 10.0).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        found = {r["seq"]: r["allowed"] for r in spark.table("limited").collect()}
    finally:
        spark.conf.unset(key)
    assert found == {0: True, 1: True, 2: False, 3: True, 4: False, 5: True}


def test_query_log_stream(spark, tmp_path):
    log = spark.createDataFrame([("k", "q", 3, "2024-01-01 00:00:10"), ("k", "q", 5, "2024-01-01 00:00:50")], "api_key string, query string, result_count long, at string").withColumn("at", F.to_timestamp("at"))
    log.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    limiter.append_stream(source, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = limiter.query_counts_stream(source).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["queries"], r["average"]) for r in spark.table("counts").collect()] == [(2, 4.0)]


def test_cache_replay(spark):
    ops = [("put", "a"), ("put", "b"), ("put", "c"), ("get", "a"), ("get", "b"), ("put", "d"), ("get", "c")]
    trace = spark.createDataFrame([(1, i, op, k) for i, (op, k) in enumerate(ops)], "cache_id long, seq long, op string, key string")
    rows = limiter.cache_replay(trace, 3).orderBy("seq").collect()
    assert [r["evicted"] for r in rows] == [None] * 5 + ["c", None]
    assert [r["hit"] for r in rows] == [None, None, None, True, True, None, False]
    with pytest.raises(ValueError, match="capacity"):
        limiter.cache_replay(trace, 0)


def test_analytics(spark):
    log = spark.createDataFrame([(1, "k", "python", 10, 1.0), (2, "k", "python", 20, 2.0), (3, "j", "java", 15, 2.0)], "id long, api_key string, query string, result_count long, ts double")
    assert [r["result_count"] for r in analytics.history(log, "k").collect()] == [20, 10]
    assert analytics.total_queries(log, "k").first()["total"] == 2
    assert tuple(analytics.top_queries(log).first()) == ("python", 2)
    assert tuple(analytics.queries_per_user(log).first()) == ("k", 2)
    assert analytics.average_result_count(log).first()["average"] == 15.0
    assert analytics.average_result_count(log.limit(0)).first()["average"] == 0.0


def test_collections(spark):
    values = spark.createDataFrame([(x,) for x in (5, 3, 8, 1, 9, 2)], "value long")
    assert [r["value"] for r in collections.heap_order(values).collect()] == [1, 2, 3, 5, 8, 9]
    assert [r["value"] for r in collections.heap_order(values, largest=True, limit=2).collect()] == [9, 8]
    assert collections.heap_top(values) == 1
    with pytest.raises(IndexError):
        collections.heap_top(values.limit(0))
    items = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("c", 1, 2)], "item string, priority long, seq long")
    assert [r["item"] for r in collections.priority_order(items).collect()] == ["a", "c", "b"]
    table = spark.createDataFrame([("x", 1)], "key string, value long")
    more = spark.createDataFrame([("x", 2, 0), ("y", 3, 1), ("y", 4, 2)], "key string, value long, seq long")
    assert dict(map(tuple, collections.put_keys(table, more).collect())) == {"x": 2, "y": 4}
    assert collections.get_key(table, "x").first()["value"] == 1
    maps = spark.range(1).select(collections.map_put(F.create_map(F.lit("a"), F.lit(1)), F.lit("a"), F.lit(2)).alias("p"), collections.map_remove(F.create_map(F.lit("a"), F.lit(1)), F.lit("a")).alias("r")).first()
    assert maps["p"] == {"a": 2} and maps["r"] == {}
