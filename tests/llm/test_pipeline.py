"""The pipeline's stages, each judged on its own input, and the queries of the operators."""

import hashlib
import os
import random

import numpy as np
import pytest
import test_operators as T
from pyspark.sql import functions as F

import corpus_pipeline
from skerry.llm import quality, queries, toxicity
from skerry.llm.common import materialise

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@here
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left.append(materialise(stage(spark, left[-1], SF), "test"))
        assert left[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in left]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    known = [i for i in ids[0] if i in labels]
    assert all(labels[i]["quality"] == 0 for i in known if i not in ids[1])
    assert all(labels[i]["quality"] == 1 for i in ids[1] if i in labels)
    pieces = corpus_pipeline.STAGES[-1][1](spark, left[-1], SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == ids[-1]


@here
def test_pipeline_equals_its_stages(spark):
    found = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "test")
    assert sorted(found.select("doc_id", "start", "length", "ids_crc32").collect()) == sorted(docs.select("doc_id", "start", "length", "ids_crc32").collect())


@here
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    import duckdb

    found = queries.QUERIES[name](spark, SF)
    rows = found.collect()
    assert rows
    if name in queries.ORACLE_SQL:
        c = duckdb.connect()
        for t in ("embeddings", "pages"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        wanted = c.execute(queries.ORACLE_SQL[name])
        columns = [x[0] for x in wanted.description]
        assert sorted(columns) == sorted(found.columns)
        assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == sorted(map(repr, wanted.fetchall()))


CLASHES = {"k1": "x", "id": "x", "logit": "x", "score": "x", "ranges": "x", "removed": "x", "host": "x", "_id": "x", "node": "x"}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables with nulls, empty and long texts, copies, repeated rows, shared passages, insults, junk and clashing names."""
    rows, labels = T.labelled_documents(seed=11, n=260)
    r = random.Random(12)
    passage = " ".join("".join(r.choice("abcdeghil") for _ in range(6)) for _ in range(60))
    clean = [x for x, (_, good, toxic) in zip(rows, labels, strict=True) if good and not toxic]
    for k, (_, text, host, lang) in enumerate(clean[:24]):
        rows.append((1_000 + k, text if k < 8 else f"{text} {passage} {T.letters(300, k)}", host, lang))
    words = T.prose(31, 1, 0 + 9_000)[0].split()
    rows += [(2_000, None, "host1", None), (2_001, "", None, "en"), (2_001, "", None, "en"), (None, clean[0][1], "host2", "en"), (2_002, " ".join(words), "host3", "en"), clean[3], clean[3]]
    folder = str(tmp_path_factory.mktemp("odd"))
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({k: F.lit(v) for k, v in CLASHES.items()})
    table.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (5_000, None, None)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder


def keyed(rows):
    return sorted((str(r["doc_id"]), str(r["text"])) for r in rows)


def test_stages_equal_brute_force(spark, odd):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    labels = spark.read.parquet(f"{odd}/labels.parquet")
    columns = docs.columns

    def after(name, docs):
        out = materialise(stages[name](spark, docs, odd), "test")
        assert out.columns == columns and out.schema["text"].dataType == docs.schema["text"].dataType
        return out, docs.collect(), out.collect()

    good, given, kept = after("quality classifier", docs)
    p = T.brute_quality(quality.train(docs, labels), [(r["text"], r["source"], r["lang"]) for r in given])
    assert keyed(kept) == keyed(r for r, x in zip(given, p, strict=True) if x >= 0.5)
    assert len(given) - len(kept) > 30

    harmless, given, kept = after("toxicity", good)
    model = toxicity.train(good, labels)
    scores, wanted = toxicity.Scores(model.known), []
    for r in given:
        words = toxicity.WORD.findall((r["text"] or "").lower())
        values = np.array([scores[w] for w in words])
        evidence = model.evidence(model.damped(words, values, T.brute_segments(values))[1], len(words))
        if model.probability(evidence) < 0.3:
            wanted.append(r)
    assert keyed(kept) == keyed(wanted)
    assert len(given) - len(kept) > 30

    single, given, kept = after("near duplicates", harmless)
    texts = [r["text"] for r in given]
    roots = [c for _, c in T.brute_components(texts, 80)]
    least = {}
    for r, c, t in zip(given, roots, texts, strict=True):
        if r["doc_id"] is not None and (t or "").split():
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    wanted = set()
    for r, c, t in zip(given, roots, texts, strict=True):
        blank = not (t or "").split()
        if blank or c not in least or r["doc_id"] == least[c]:
            wanted.add((str(r["doc_id"]), str(t)))
    assert keyed(kept) == sorted(wanted)
    assert len(given) - len(kept) > 8

    cut, given, kept = after("repeated spans", single)
    spans = T.brute_spans([r["text"] for r in given], 200)
    assert sum(n > 0 for _, n, _, _ in spans) > 10
    left = {str(r["doc_id"]): r["text"] for r in kept}
    for r, (size, gone, _, digest) in zip(given, spans, strict=True):
        if gone and gone < size:
            assert hashlib.sha256(left[str(r["doc_id"])].encode()).hexdigest() == digest  # the fixture is ASCII where it repeats
        elif not gone:
            assert left[str(r["doc_id"])] == r["text"]
        else:
            assert str(r["doc_id"]) not in left

    pieces = stages["packing"](spark, cut, odd).collect()
    ids = [r["doc_id"] for r in kept]
    assert {x["doc_id"] for x in pieces} == set(ids)
    T.check_packing([x.asDict() | {"doc_id": ids.index(x["doc_id"])} for x in pieces], [r["text"] for r in kept], 1024)
    run = corpus_pipeline.run(spark, odd).collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["start"], x["length"], x["ids_crc32"]) for x in run) == sorted((x["doc_id"] is None, x["doc_id"] or 0, x["start"], x["length"], x["ids_crc32"]) for x in pieces)


def test_pipeline_of_an_empty_table(spark, odd, tmp_path):
    folder = str(tmp_path)
    spark.read.parquet(f"{odd}/documents.parquet").limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{odd}/labels.parquet").limit(0).write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
