import os

import pytest

import __spark_entry__ as entry
from skerry.plans import queries as engine_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(v[i] for i in order)) for v in values)


@pytest.mark.parametrize("name", sorted(engine_queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    found = engine_queries.QUERIES[name](spark, SF)
    wanted = duck.execute(engine_queries.ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows(found.columns, map(tuple, found.collect())) == rows(columns, wanted.fetchall())


@pytest.mark.parametrize("name", ["page_text", "web_documents"])
def test_pages_with_references_that_are_cut_short(spark, duck, tmp_path, name):
    html = ["<title>one &amp two&amp</title><p>a &amp; b</p><h1>cut &lt</h1>&quot;x&quot <i>&ampx; &am</i> &", "<p>&copy;&copy &middot&middot;</p>", "<title>&amp</title>", ""]
    spark.createDataFrame([(i, f"https://h/{i}", x) for i, x in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = engine_queries.QUERIES[name](spark, str(tmp_path))
    wanted = duck.execute(f"WITH pages AS (SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')) SELECT * FROM ({engine_queries.ORACLE_SQL[name]})")
    columns = [c[0] for c in wanted.description]
    assert rows(found.select(columns).columns, map(tuple, found.select(columns).collect())) == rows(columns, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(set(engine_queries.QUERIES) - set(engine_queries.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert engine_queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
