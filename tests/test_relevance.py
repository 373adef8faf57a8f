"""Rankers against graded judgments: fifteen documents, four queries, cut at five."""

import pytest
from pyspark.sql import functions as F

from skerry.functions.vectors import hash_embedding
from skerry.operators import evaluate, rank, semantic
from skerry.operators.index import build_index
from skerry.operators.query import terms_of

# The documents of the published comparison, their judgments, and its means (precision, recall, NDCG).
DOCUMENTS = {
    1: "Python is a high-level programming language known for its clean, readable syntax. It supports object-oriented, functional, and procedural programming paradigms.",
    2: "Python is widely used in data science and machine learning due to libraries like NumPy, pandas, and scikit-learn.",
    3: "JavaScript is the primary language for web browser scripting. Modern JavaScript frameworks include React, Vue, and Angular.",
    4: "Web development involves building websites and web applications using HTML, CSS, and JavaScript for the frontend.",
    5: "Machine learning is a subset of artificial intelligence that enables systems to learn patterns from data without explicit programming.",
    6: "Deep learning uses neural networks with many layers to model complex patterns, and has driven major advances in computer vision and natural language processing.",
    7: "Natural language processing combines linguistics and machine learning to help computers understand and generate human language.",
    8: "REST APIs allow web applications to communicate over HTTP using standard methods like GET, POST, PUT, and DELETE.",
    9: "Database indexing improves query performance by allowing the database engine to find rows without scanning an entire table.",
    10: "An inverted index maps each word to the list of documents containing it, forming the core data structure behind most search engines.",
    11: "Italian cuisine is known for its regional diversity, emphasizing fresh ingredients like tomatoes, olive oil, and fresh pasta.",
    12: "Baking bread requires understanding yeast fermentation, gluten development, and precise temperature control.",
    13: "Software engineering best practices include writing tests, code review, version control with git, and continuous integration pipelines.",
    14: "Python's popularity in software engineering comes partly from its extensive standard library and the readability of its syntax, which reduces long-term maintenance costs.",
    15: "Search engines rank documents using signals like term frequency, document frequency, and increasingly, semantic similarity from neural embeddings.",
}
JUDGMENTS = {
    "python programming language": {1: 3, 14: 2, 2: 1},
    "machine learning and neural networks": {6: 3, 5: 3, 7: 2, 2: 1},
    "web development frameworks": {4: 3, 3: 2, 8: 1},
    "search engine indexing": {10: 3, 15: 3, 9: 2},
}
PUBLISHED = {"tfidf": (0.650, 1.000, 0.910), "bm25": (0.650, 1.000, 0.964), "hybrid": (0.600, 0.917, 0.912)}


def test_means_equal_the_published_ones(spark):
    documents = spark.createDataFrame(list(DOCUMENTS.items()), "doc_id long, raw_text string").cache()
    built = build_index(documents).cached()
    candidates = documents.select("doc_id")
    vectors = semantic.embed(documents).cache()
    rows = []
    for query in JUDGMENTS:
        terms = terms_of(query)
        vector = spark.range(1).select(hash_embedding(F.lit(query)).alias("v")).first()["v"]
        found = {
            "tfidf": rank.tfidf_scores(built, terms, candidates).orderBy(rank.by_score(), "doc_id").limit(5),
            "bm25": rank.rank(rank.bm25_scores(built, terms, candidates), 5),
            "hybrid": semantic.hybrid_search(built, vectors, terms, vector, candidates, 5, 0.7),
        }
        rows += [(m, query, r["doc_id"], k) for m, f in found.items() for k, r in enumerate(f.collect(), 1)]
    ranked = spark.createDataFrame(rows, "method string, query string, doc_id long, rank int")
    qrels = spark.createDataFrame([(q, d, g) for q, x in JUDGMENTS.items() for d, g in x.items()], "query string, doc_id long, grade int")
    means = evaluate.compare(evaluate.metrics_at_k(ranked, qrels, 5, ("query", "method"))).collect()
    assert {r["method"]: (r["precision"], r["recall"], r["ndcg"]) for r in means} == {m: pytest.approx(v, abs=6e-4) for m, v in PUBLISHED.items()}
