import random

import pytest
from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.functions.porter import porter_stem, stem
from skerry.functions.vectors import cosine, hash_embedding, min_max, normalise
from skerry.operators.index import analyze


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_are_ascii_and_lowered_after_matching(spark):
    assert one(spark, T.tokenize(F.lit("Python 3.12 released in 2023"))) == ["python", "3", "12", "released", "in", "2023"]
    assert one(spark, T.tokenize(F.lit("Iechä Foo-bar Kİx"))) == ["iech", "foo", "bar", "x"]
    assert one(spark, T.tokenize(F.lit(None).cast("string"))) == []


def test_analyzer(spark):
    text = "The Quick Brown Foxes are Jumping over Lazy Dogs!"
    assert one(spark, analyze(F.lit(text))) == ["quick", "brown", "fox", "jump", "over", "lazi", "dog"]


@pytest.mark.parametrize(
    ("word", "expected"),
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("feed", "feed"), ("sing", "sing"), ("hopping", "hop"), ("sized", "size"), ("argument", "argument"), ("government", "govern"), ("relational", "relat"), ("electriciti", "electr"), ("adoption", "adopt"), ("sky", "sky"), ("by", "by"), ("happy", "happi")],
)
def test_stems(spark, word, expected):
    assert stem(word) == expected
    assert one(spark, porter_stem(F.lit(word))) == expected


def test_stem_expression_equals_python(spark):
    r = random.Random(1)
    ends = ["", "s", "ies", "sses", "eed", "ing", "ed", "ational", "iveness", "ement", "ion", "e", "ll", "y", "izing", "bled", "ated"]
    words = sorted({"".join(r.choice("abelsytinoz1y") for _ in range(r.randint(1, 7))) + r.choice(ends) for _ in range(3000)} | {"y" * n for n in range(1, 14)} | {"b" + "y" * n + "s" for n in range(1, 14)})
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", porter_stem(F.col("w")).alias("s")).collect()
    assert [(x["w"], x["s"]) for x in rows if x["s"] != stem(x["w"])] == []


def test_words_split_at_unicode_space(spark):
    text = "a\x1cb c　d​e  f\x85g"
    assert one(spark, T.words(F.lit(text))) == text.split()
    assert one(spark, T.is_blank(F.lit("  \n")))


def test_snippets(spark):
    words = [f"w{i}" for i in range(40)]
    get = lambda q, text=" ".join(words): one(spark, T.snippet(F.lit(text), q))
    assert get(["W20"]) == " ".join(words[8:32]) + "..."
    assert get(["zzz"]) == " ".join(words[:24]) + "..."
    assert get(["w0"], "w0 b") == "w0 b"
    assert get([], "a b") == "a b"


def test_positions_and_distances(spark):
    assert one(spark, T.find_all(F.lit("aaaa"), "aa")) == [0, 1, 2]
    assert one(spark, T.find_all(F.lit("abcXabc"), "abc")) == [0, 4]
    assert one(spark, T.find_all(F.lit("a"), "abc")) == [] == one(spark, T.find_all(F.lit("a"), ""))
    assert one(spark, T.edit_distance(F.lit("kitten"), F.lit("sitting"))) == 3
    values = F.array(*(F.lit(x) for x in (1, 2, 2, 2, 3, 4)))
    assert one(spark, T.lower_bound(values, F.lit(2))) == 1
    assert one(spark, T.upper_bound(values, F.lit(2))) == 4
    assert one(spark, T.binary_search(values, F.lit(9))) == -1


def test_sentences_and_highlight(spark):
    assert one(spark, T.sentences(F.lit("One. Two!  Three? four"))) == ["One.", "Two!", "Three?", "four"]
    parts = one(spark, T.highlight(F.lit("The Python python3"), ["python"]))
    assert [(p["text"], p["is_match"]) for p in parts] == [("The ", False), ("Python", True), (" ", False), ("python", True), ("3", False)]


def test_file_names(spark):
    for path, stem_, suffix in [("/a/my-report.txt", "my-report", ".txt"), ("x.tar.GZ", "x.tar", ".gz"), ("/a/.bashrc", ".bashrc", ".bashrc")]:
        assert one(spark, T.file_stem(F.lit(path))) == stem_
        assert one(spark, T.file_suffix(F.lit(path))) == suffix
    assert one(spark, T.preview(F.lit("a\nb"))) == "a b"


def test_vectors(spark):
    import hashlib
    import math

    array = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    assert one(spark, cosine(array(1, 0), array(1, 1))) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, cosine(array(0, 0), array(1, 1))) == 0.0
    assert one(spark, cosine(array(1, 2, 2), array(1))) == pytest.approx(1 / 3)
    assert one(spark, normalise(array(3, 4))) == [0.6, 0.8]
    assert one(spark, min_max(F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 0.5
    for dimension in (10, 48, 64):
        counts = [0.0] * dimension
        for w in "to be or not to be".split():
            counts[int(hashlib.md5(w.encode()).hexdigest(), 16) % dimension] += 1
        size = math.sqrt(sum(c * c for c in counts))
        assert one(spark, hash_embedding(F.lit("To be or NOT to be"), dimension)) == pytest.approx([c / size for c in counts])
    assert one(spark, hash_embedding(F.lit(" "), 4)) == [0.0] * 4
