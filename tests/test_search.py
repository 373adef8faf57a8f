import math
import random

import pytest
from pyspark.sql import functions as F

from skerry.operators import evaluate, rank, semantic, suggest
from skerry.operators import query as Q
from skerry.operators.index import Index, add_documents, build_index, empty_index, grouped_postings_of, remove_documents, update_documents
from skerry.plans.queries import QUERIES

TEXTS = [
    (1, "python is a programming language", "txt"),
    (2, "java is an island, and python is a snake", "txt"),
    (3, "java for programming", "html"),
    (4, "a language of programming, quickly", "html"),
]


def make(spark, texts=TEXTS) -> Index:
    rows = [(i, f"/d/{i}", kind, f"t{i}", text) for i, text, kind in texts]
    return build_index(spark.createDataFrame(rows, "doc_id long, source_path string, source_type string, title string, raw_text string")).cached()


@pytest.fixture(scope="module")
def built(spark):
    return make(spark)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_postings_and_statistics(spark, built):
    terms = spark.createDataFrame([(1, ["a", "b", "c", "a"]), (2, [])], "doc_id long, terms array<string>")
    tiny = build_index(spark.createDataFrame([(1,), (2,)], "doc_id long"), terms=terms)
    assert [tuple(r) for r in tiny.get_postings("a").collect()] == [("a", 1, 2, [0, 3])]
    assert sorted(map(tuple, tiny.postings.collect())) == sorted(map(tuple, grouped_postings_of(terms).collect()))
    assert (tiny.document_count(), tiny.vocabulary_size(), tiny.document_length(1), tiny.document_length(2), tiny.document_length(9)) == (2, 3, 4, 0, 0)
    assert tiny.corpus_stats.first()["avgdl"] == 2.0
    assert (built.document_frequency("python"), built.term_frequency("python", 1), built.term_frequency("zzz", 1)) == (2, 1, 0)
    assert empty_index(spark).corpus_stats.first().asDict() == {"n_docs": 0, "avgdl": 0.0, "vocabulary": 0}


def test_changes(spark, built):
    more = make(spark, [(4, "rust", "txt"), (9, "rust again", "txt")])
    with pytest.raises(ValueError, match="4 is indexed"):
        add_documents(built, more)
    changed = update_documents(built, more)
    assert ids(changed.document_ids("rust")) == [4, 9]
    assert changed.document_frequency("quickli") == 0
    gone = remove_documents(built, spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert "python" not in [r["term"] for r in gone.all_terms().collect()]
    assert ids(gone.all_document_ids()) == [3, 4]


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("python AND programming", [1]), ("python OR java", [1, 2, 3]), ("python programming", [1]), ("programming and language not python", [4]),
        ("NOT java", [2, 3]), ("python AND OR java", [1, 2, 3]), ("the python", []), ("python AND", [1, 2]), ("", []), ('"programming language"', [1]),
        ('"language programming"', [4]), ('"java programming"', [3]), ('""', []), ("programming NOT java OR snake", [1, 2, 4]), ('"python"', [1, 2]),
        ("programming-zzz", [1, 3, 4]),
    ],
)
def test_query_language(built, query, expected):
    assert ids(Q.search_ids(built, query)) == expected


def test_boolean_library(built):
    assert ids(Q.search_and(built, ["python", "java"])) == [2]
    assert ids(Q.search_and(built, [])) == []
    assert ids(Q.search_or(built, ["snake", "language"])) == [1, 2, 4]
    assert ids(Q.search_not(built, "python")) == [3, 4]
    assert ids(Q.evaluate(built, [("AND", "programming"), ("AND", "language"), ("NOT", "java")])) == [1, 4]
    with pytest.raises(ValueError, match="XOR"):
        Q.evaluate(built, [("AND", "a"), ("XOR", "b")])
    assert [tuple(r) for r in Q.boolean_search(built, "java").collect()] == [(2, "t2", "/d/2"), (3, "t3", "/d/3")]


def bm25(n, df, tf, length, average, k1=1.5, b=0.75):
    return math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def test_bm25_and_ranked_search(built):
    lengths = {r["doc_id"]: r["doc_len"] for r in built.doc_stats.collect()}
    average = sum(lengths.values()) / 4
    want = {d: bm25(4, 2, 1, lengths[d], average) for d in (1, 2)}
    hits = rank.search_ranked(built, "python").collect()
    assert {h["doc_id"]: h["score"] for h in hits} == pytest.approx(want)
    assert [h["doc_id"] for h in hits] == sorted(want, key=lambda d: (-want[d], d))
    assert hits[0]["snippet"].startswith("python")
    assert hits[0]["score_breakdown"] == pytest.approx({"python": want[1]})
    twice = {h["doc_id"]: h for h in rank.search_ranked(built, "python python OR java").collect()}
    assert twice[1]["score"] == pytest.approx(2 * want[1])
    assert twice[1]["score_breakdown"] == pytest.approx({"python": want[1], "java": 0.0})
    assert ids(rank.search_ranked(built, "java", source_type="html")) == [3]
    assert rank.search_ranked(built, "the").collect() == []
    with pytest.raises(ValueError, match="top_k"):
        rank.search_ranked(built, "java", top_k=0)
    explained = rank.explain_score(rank.search_ranked(built, "python OR java")).where("doc_id = 2").collect()
    assert [r["term"] for r in explained] == ["java", "python"]


def test_bm25_limits(built):
    n = built.document_count()
    no_length = {r["score"] for r in rank.bm25_scores(built, ["python"], b=0.0).collect()}
    assert len(no_length) == 1
    only_idf = rank.bm25_scores(built, ["python"], k1=0.0).first()["score"]
    assert only_idf == pytest.approx(math.log((n - 2 + 0.5) / 2.5 + 1))


def test_tfidf_and_cosine(spark, built):
    scores = {r["doc_id"]: r["score"] for r in rank.tfidf_scores(built, ["python", "program"]).collect()}
    assert scores[1] == pytest.approx(math.log10(2) + math.log10(4 / 3))
    weights = {(r["doc_id"], r["term"]): r["weight"] for r in rank.tfidf_vectors(built).collect()}
    assert weights[(1, "python")] == pytest.approx(math.log10(2))
    assert {r["term"]: r["weight"] for r in rank.tfidf_query_vector(built, ["python", "python", "zzz"]).collect()} == pytest.approx({"python": (1 + math.log10(2)) * math.log10(2), "zzz": 0.0})
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", 1.0)], "q long, term string, weight double")
    b = spark.createDataFrame([(7, "x", 1.0), (7, "z", 1.0), (8, "x", 0.0)], "d long, term string, weight double")
    assert {r["d"]: r["cosine"] for r in rank.sparse_cosine(a, b, "q", "d").collect()} == pytest.approx({7: 0.5, 8: 0.0})
    maps = spark.range(1).select(rank.map_cosine(F.create_map(F.lit("x"), F.lit(1.0), F.lit("y"), F.lit(1.0)), F.create_map(F.lit("x"), F.lit(1.0), F.lit("z"), F.lit(1.0))).alias("c"))
    assert maps.first()["c"] == pytest.approx(0.5)


@pytest.mark.parametrize(("block", "cells", "dense"), [(4096, 1 << 20, 0.05), (3, 4, 0.05), (5, 7, 2.0)])
def test_batch_cosine(spark, monkeypatch, block, cells, dense):
    """Against sparse_cosine: the same pairs, with weights of 0 and below, sums of 0, a vector of magnitude 0, nulls and repeated terms."""
    for name, value in (("BLOCK_VECTORS", block), ("CELLS", cells), ("PRODUCTS", cells), ("DENSE", dense)):
        monkeypatch.setattr(rank, name, value)
    r = random.Random(3)
    rows = [(i, f"t{min(r.randrange(1, 30), r.randrange(1, 30))}", r.choice([0.0, 0.5, 1.0, 2.5, -1.0])) for i in range(25) for _ in range(r.randrange(1, 9))]
    rows += [(40, "t1", 0.0), (41, "t1", 1.0), (41, "t2", -1.0), (42, "t1", 1.0), (42, "t2", 1.0), (43, "alone", 1.0), (None, "t1", 1.0), (44, None, 1.0)]
    b = spark.createDataFrame(rows, "d long, term string, weight double").groupBy("d", "term").agg(F.sum("weight").alias("weight"))
    a = b.where("d % 3 = 0 OR d > 30").withColumnRenamed("d", "q")
    wanted = {(x["q"], x["d"]): x["cosine"] for x in rank.sparse_cosine(a, b, "q", "d").collect()}
    found = rank.batch_cosine(rank.whole_vectors(a, "q"), rank.whole_vectors(b, "d"), "q", "d").collect()
    assert len(found) == len(wanted)
    assert {(x["q"], x["d"]): x["cosine"] for x in found} == pytest.approx(wanted, abs=1e-12)
    none = rank.whole_vectors(a.limit(0), "q")
    assert rank.batch_cosine(none, rank.whole_vectors(b, "d"), "q", "d").count() == 0


@pytest.mark.parametrize("often", [300_000, 5, 0])
def test_whole_tfidf_vectors(spark, monkeypatch, often):
    monkeypatch.setattr(rank, "OFTEN_TERMS", often)
    documents = make(spark, [*TEXTS, (None, "python without an id", "txt"), (5, None, "txt")]).documents
    wanted = {x["doc_id"]: x for x in rank.whole_vectors(rank.tfidf_vectors(build_index(documents)), "doc_id").collect()}
    found = [x for x in rank.whole_tfidf_vectors(documents).collect() if x["terms"]]
    assert {x["doc_id"]: dict(zip(x["terms"], x["weights"], strict=True)) for x in found} == {k: pytest.approx(dict(zip(x["terms"], x["weights"], strict=True))) for k, x in wanted.items()}
    assert [x["size"] for x in found] == pytest.approx([wanted[x["doc_id"]]["size"] for x in found])


@pytest.mark.parametrize(("levels", "bits"), [(4, 24), (4, 1), (1, 3), (0, 24)])
def test_whole_tfidf_vectors_by_levels(spark, monkeypatch, levels, bits):
    """Frequencies without names, where terms meet in slots and where some are over what a level's byte holds."""
    for name, value in (("OFTEN_TERMS", 2), ("LEVELS", levels), ("SLOT_BITS", bits)):
        monkeypatch.setattr(rank, name, value)
    r = random.Random(5)
    rows = [(i, " ".join(["over", "often", "most", *(f"w{min(r.randrange(1, 60), r.randrange(1, 60))}" for _ in range(9))]), "txt") for i in range(300)]
    documents = make(spark, rows).documents
    wanted = {x["doc_id"]: x for x in rank.whole_vectors(rank.tfidf_vectors(build_index(documents)), "doc_id").collect()}
    found = rank.whole_tfidf_vectors(documents).collect()
    assert {x["doc_id"]: dict(zip(x["terms"], x["weights"], strict=True)) for x in found} == {k: pytest.approx(dict(zip(x["terms"], x["weights"], strict=True))) for k, x in wanted.items()}
    assert [x["size"] for x in found] == pytest.approx([wanted[x["doc_id"]]["size"] for x in found])


def test_rare_terms_shuffle_no_documents(spark, monkeypatch):
    plans = {}
    cut = rank.table_cut
    monkeypatch.setattr(rank, "table_cut", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and cut(df, name))
    monkeypatch.setattr(rank, "OFTEN_TERMS", 5)
    assert rank.whole_tfidf_vectors(make(spark, TEXTS).documents).count() == len(TEXTS)
    assert "Exchange" not in plans["vectors"] and "Join" not in plans["vectors"]


def test_cosine_query_shuffles_no_pairs(spark):
    plan = QUERIES["tfidf_cosine"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_rank_and_blend(spark):
    scores = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 1.0)], "doc_id long, score double")
    assert [r["doc_id"] for r in rank.rank(scores).collect()] == [2, 1, 3]
    assert [r["doc_id"] for r in rank.rank(scores, 1).collect()] == [2]
    authority = spark.createDataFrame([(3, 0.5)], "doc_id long, authority double")
    assert rank.rank(rank.blended(scores, authority, 10.0), 1).first()["doc_id"] == 3


def test_batch_equals_single(spark, built):
    asked = spark.createDataFrame([(1, ["python", "program"]), (2, ["java"]), (3, ["zzz"])], "query_id long, terms array<string>")
    found = {}
    for r in rank.batch_bm25(built, asked, 10).collect():
        found.setdefault(r["query_id"], {})[r["doc_id"]] = r["score"]
    assert found[1] == pytest.approx({r["doc_id"]: r["score"] for r in rank.bm25_scores(built, ["python", "program"]).collect()})
    assert 3 not in found


def test_documents_are_scored_whole_whatever_the_batches(monkeypatch):
    import random

    import pyarrow as pa

    from skerry.operators import rank

    r = random.Random(2)
    rows = sorted({(r.randrange(60), f"t{r.randrange(12)}"): r.random() for _ in range(400)}.items())
    asked = [(q, f"t{r.randrange(12)}", r.randint(1, 3)) for q in range(9) for _ in range(3)]
    asked = list({(q, t): (q, t, n) for q, t, n in asked}.values())
    table = pa.table({"query_id": [x[0] for x in asked], "term": [x[1] for x in asked], "qtf": [x[2] for x in asked]})
    rows = [(d, t, p) for (d, t), p in rows if t in {x[1] for x in asked}]
    postings = pa.table({"term": [t for _, t, _ in rows], "doc_id": pa.array([d for d, _, _ in rows], pa.int64()), "part": [p for *_, p in rows]})
    wanted = {}
    for q in range(9):
        scores = {}
        for d, t, p in rows:
            for n in [n for k, u, n in asked if k == q and u == t]:
                scores[d] = scores.get(d, 0.0) + n * p
        wanted[q] = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]
    for chunk, size in ((1, 1), (3, 7), (100, 1000), (7, 13)):
        monkeypatch.setattr(rank, "CHUNK", chunk)
        (out,) = rank._score_block(table, 5)(iter(postings.to_batches(max_chunksize=size)))
        for q in range(9):
            got = sorted([(x["doc_id"], x["score"]) for x in out.to_pylist() if x["query_id"] == q], key=lambda x: (-round(x[1], 9), x[0]))
            assert [d for d, _ in got] == [d for d, _ in wanted[q]]
            assert [v for _, v in got] == pytest.approx([v for _, v in wanted[q]])


def test_metrics(spark):
    grades = [3, 2, 3, 0, 1, 2]
    ranked = spark.createDataFrame([("q", i, i) for i in range(1, 7)], "query string, doc_id long, rank int")
    qrels = spark.createDataFrame([("q", i + 1, g) for i, g in enumerate(grades)], "query string, doc_id long, grade int")
    row = evaluate.metrics_at_k(ranked, qrels, 6).first()
    assert row["ndcg"] == pytest.approx(0.9488107485678985)
    assert (row["precision"], row["recall"]) == (pytest.approx(5 / 6), 1.0)
    none = evaluate.metrics_at_k(ranked, qrels.where("grade < 1"), 3).first()
    assert (none["precision"], none["recall"], none["ndcg"]) == (0.0, 0.0, 0.0)
    methods = evaluate.compare(evaluate.metrics_at_k(ranked.withColumn("method", F.lit("m")), qrels, 6, ("query", "method")))
    assert methods.first()["method"] == "m"


def test_vectors_and_hybrid(spark, built):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "doc_id long, embedding array<double>")
    assert [r["doc_id"] for r in semantic.nearest(vectors, [1.0, 0.0], 3).collect()] == [1, 3, 2]
    more = spark.createDataFrame([(2, [5.0, 0.0]), (9, [0.0, 2.0])], "doc_id long, embedding array<double>")
    assert ids(semantic.upsert_vectors(vectors, more)) == [1, 2, 3, 9]
    assert ids(semantic.remove_vectors(vectors, more)) == [1, 3]
    candidates = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    found = semantic.hybrid_search(built, vectors, ["python"], [1.0, 0.0], candidates, 3, 0.5).collect()
    assert found[0]["doc_id"] == 1
    assert 0.5 < found[0]["score"] <= 1.0
    single = semantic.hybrid_search(built, vectors, ["python"], [1.0, 0.0], candidates.where("doc_id = 1"), 3, 0.5).first()
    assert single["score"] == 0.5
    with pytest.raises(Exception, match="no embedding"):
        semantic.precomputed(spark.createDataFrame([("a",)], "key string"), spark.createDataFrame([("b", [1.0])], "key string, embedding array<double>")).collect()


def test_expansion_and_answers(spark):
    asked = spark.createDataFrame([(1, "Fast search")], "query_id long, query string")
    variants = [r["variant"] for r in semantic.expand(asked).orderBy("variant_no").collect()]
    assert variants == ["Fast search", "quick search", "rapid search", "speedy search", "fast find", "fast lookup", "fast query"]
    assert semantic.expand(asked, synonyms={}).count() == 1
    snippets = spark.createDataFrame(
        [(1, "what is python", 0, "Cats sleep. Python is a language! It is old."), (1, "what is python", 1, "python is what python is."), (2, "x", 0, None), (3, "q", 0, "no match here. other")],
        "query_id long, query string, snippet_no long, snippet string",
    )
    answers = {r["query_id"]: r["answer"] for r in semantic.extractive_answers(snippets).collect()}
    assert answers == {1: "python is what python is.", 2: "No relevant information found.", 3: "no match here."}

    def retrieve(v):
        return v.select("query_id", "variant_no", F.lit(0).alias("snippet_no"), F.concat(F.lit("About "), "variant", F.lit(".")).alias("snippet"))

    assert semantic.answer(asked, retrieve).first()["answer"] == "About Fast search."
    with pytest.raises(ImportError):
        semantic.language_model_answers()
    shout = semantic.language_model_answers(lambda prompt: prompt[-11:].upper())
    assert semantic.answer(asked, retrieve, generate=shout).first()["answer"] == "FAST SEARCH"


def test_suggestions(spark, built):
    words = suggest.vocabulary(spark.createDataFrame([(1, "tea ten to team a"), (2, "to tender")], "doc_id long, raw_text string"))
    assert [r["word"] for r in suggest.autocomplete(words, "t").collect()] == ["tea", "team", "ten", "tender", "to"]
    assert [r["word"] for r in suggest.suggest(words, "TE", 2).collect()] == ["tea", "team"]
    assert suggest.contains(words, "ten") and not suggest.contains(words, "te") and suggest.starts_with(words, "te")
    left = suggest.delete(words, spark.createDataFrame([("tea",)], "word string"))
    assert not suggest.contains(left, "tea") and suggest.contains(left, "team")
    assert [r["word"] for r in suggest.suggest_for_input(words, "go Te").collect()] == ["tea", "team", "ten", "tender"]
    assert suggest.suggest_for_input(words, "go t").count() == 0
    again = suggest.insert(left, words.where("word = 'tea'"))
    assert again.count() == words.count()
