"""The training-data operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import hashlib
import math
import operator
import os
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import skerry.llm.near_duplicates as near
import skerry.llm.repeated_spans as spans
from skerry.llm import bpe, common, components, html_blocks, media, packing, quality, topk, toxicity, url_rules
from skerry.llm.common import utf8
from skerry.llm.components import connected_components
from skerry.llm.suffix_array import suffix_array
from skerry.llm.words import shingles, split_words

public_tokenizers = pytest.importorskip("public_tokenizers")

CLASHES = {"k1": "x", "label": "x", "_skerry_logit": "x", "_skerry_id": "x", "n": "x", "part": "x", "rest": "x", "logit": "x", "score": "x", "id": "x", "removed": "x", "RANGES": "x", "_k1": "x", "host": "x", "site_logit": "x", "node": "x", "kept": "x"}


def frame(spark, rows, schema="doc_id long, text string"):
    """With columns whose names operators use inside."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()})


def prose(seed=1, n=60, words=120):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéñßst") for _ in range(r.randint(2, 9))) for _ in range(400)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, words))) + "." for _ in range(n)]


def letters(n, seed=8):
    r = random.Random(seed)
    return "".join(r.choice("abcdefghij ") for _ in range(n))


ODD = [None, "", " ", "x", "a" * 30_000, "wort " * 9_000, "\x1c\x85\xa0", "日本語 ½ ٣", "<|endoftext|>a", "Ünï CÖDE", "x", "x"]


@pytest.fixture(scope="module")
def texts():
    return ODD + prose()


@pytest.fixture(scope="module")
def documents(spark, texts):
    return frame(spark, [(i, t) for i, t in enumerate(texts)]).repartition(3).cache()


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# Packing


def check_packing(rows, texts, window):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    short = 0
    for rows_of in sequences.values():
        at = 0
        for r in sorted(rows_of, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        short += at < window
    assert short <= 1


@pytest.mark.parametrize("window", [1024, 64, 7])
def test_packing(documents, texts, window):
    check_packing(packing.pack(documents, window).collect(), texts, window)


def test_packing_edges(spark):
    assert packing.pack(frame(spark, []).limit(0)).count() == 0
    same = packing.pack(frame(spark, [(None, None), (3, "a"), (3, "a")]), 8).collect()
    assert sorted((r["doc_id"] is None, r["length"]) for r in same) == [(False, 2), (False, 2), (True, 1)]


@pytest.mark.parametrize("counts", [{700: 1000}, {1: 5}, {1023: 7, 1: 3}, {512: 9, 513: 4, 300: 100}, {}])
def test_packing_plan_places_all_once(counts):
    window = 1024
    histogram = np.zeros(window, np.int64)
    for n, c in counts.items():
        histogram[n] = c
    runs, sequences = packing.plan(histogram, window)
    ids = collections.Counter()
    filled = collections.Counter()
    for r in runs.itertuples():
        for k in range(r.lo, r.hi):
            ids[(r.rest, k)] += r.length
            filled[r.sequence + k - r.lo] += r.length
    assert ids == {(n, k): n for n, c in counts.items() for k in range(c)}
    assert len(filled) == sequences and sum(v < window for v in filled.values()) <= 1
    assert max(filled.values(), default=0) <= window


def test_all_combinations_are_enumerated():
    every = packing.combinations(np.arange(1, 1024), 1024)
    assert len(every) == len(set(every)) == 512 + sum(1 for a in range(1, 1023) for b in range(a, (1024 - a) // 2 + 1))


def test_least_squares_repeats():
    histogram = np.zeros(1024, np.int64)
    histogram[[300, 724, 500, 24]] = 100, 100, 50, 50
    patterns = packing.combinations(np.array([24, 300, 500, 724]), 1024)
    assert (300, 724) in patterns and (24, 500, 500) in patterns
    x = dict(zip(patterns, packing.solve(histogram, patterns), strict=True))
    assert min(x.values()) >= 0 and x[(300, 724)] == pytest.approx(100, rel=0.05)


# Top-k search


def brute_top(rows, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted((-min(max(sum(map(operator.mul, v, w)), -(2**63)), 2**63 - 1), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


@pytest.mark.parametrize(("dimensions", "block"), [(64, 4096), (5, 3), (1, 4096)])
def test_top_k(spark, dimensions, block):
    r = np.random.default_rng(5)
    data = [(i, (r.normal(size=dimensions) * r.choice([0.1, 1.0])).tolist()) for i in range(400)]
    data += [(400 + i, data[0][1]) for i in range(30)]  # ties
    bad = [(1000, None), (1100, [None] * dimensions), (1200, [float("nan")] * dimensions), (None, data[1][1]), (1300, []), (1400, [1.0] * (dimensions + 1)), (1600, [float("-inf")] * dimensions)]
    # Components whose products don't fit a long, or whose scaled values don't fit a double.
    data += [(1500 + i, [x] * dimensions) for i, x in enumerate((1e300, -1.7e308, 200_000.0, 3e9, -3e9))]
    data += [(1700, [200_000.0 if k % 2 else 1.0 for k in range(dimensions)]), (1800, [3e9 if k % 2 else -3e9 for k in range(dimensions)])]
    df = frame(spark, data + bad, "vec_id long, embedding array<double>").repartition(3)
    found = collections.defaultdict(list)
    for x in topk.top_k(df, df.where("vec_id % 100 = 0"), 10, block=block).collect():
        found[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    whole = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in data]
    wanted = brute_top([*whole, (1400, [1024] * (dimensions + 1))], [x for x in whole if x[0] % 100 == 0], 10)
    assert {q: [(i, s) for _, i, s in sorted(v)] for q, v in found.items()} == wanted
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_segment_bounds_hold():
    r = np.random.default_rng(1)
    a, b = r.integers(-900, 900, (20, 64)), r.integers(-900, 900, (30, 64))
    exact = a @ b.T
    last = None
    for s in topk.resolutions(64):
        (am, ad), (bm, bd) = topk.segment_statistics(a, s), topk.segment_statistics(b, s)
        bound = am @ bm.T + ad @ bd.T
        assert (bound >= exact - 1e-6).all()
        assert last is None or (bound <= last + 1e-6).all()
        last = bound


# Near duplicates


def shingle_set(text, size=5):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", low)]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(texts, percent=85):
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def variants(seed=2, groups=12, copies=14):
    r = random.Random(seed)
    out = []
    for base in prose(seed, groups, 300):
        w = base.split()
        for _ in range(r.randint(1, copies)):
            v = list(w)
            for _ in range(r.randint(0, max(1, len(v) // 60))):
                v[r.randrange(len(v))] = f"new{r.randrange(10_000)}"
            out.append(" ".join(v).upper() if r.random() < 0.1 else " ".join(v))
    r.shuffle(out)
    return out


def test_shingles_are_those_of_words():
    texts = ["a B  c\td e\x0bf", "", None, "one", "x y z", " lead and trail ", "é ü é ü é ü"]
    hashes, owner = shingles(*utf8(pa.array(texts)))
    names: dict = {}
    for i, t in enumerate(texts):
        own = hashes[owner == i]
        w = (t or "").lower().split()
        want = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
        assert len(own) == len(want)
        for h, s in zip(own.tolist(), want, strict=True):
            assert names.setdefault(s, h) == h
    assert len(set(names.values())) == len(names)
    starts, lengths, text = split_words(*utf8(pa.array(["ab", "cd e", ""])))
    assert (starts.tolist(), lengths.tolist(), text.tolist()) == ([0, 2, 5], [2, 2, 1], [0, 1, 1])


@pytest.mark.parametrize("region", [8, 2])
def test_near_duplicates(spark, monkeypatch, region):
    monkeypatch.setattr(near, "REGION", region)
    texts = ODD + variants()
    found = collected(near.near_duplicates(frame(spark, list(enumerate(texts))).repartition(5)))
    wanted = brute_components(texts)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == dict(enumerate(wanted))
    assert all(r["kept"] == (r["component_id"] == i) for i, r in found.items())


def under_boilerplate(seed=5, pairs=150, single=100, common=352, own=48, changed=28):
    """Texts of one long common passage and some words of their own; each of the first two by two is linked with the other alone."""
    r = random.Random(seed)
    passage = " ".join(f"c{i}" for i in range(common))
    out = []
    for k in range(pairs + single):
        words = [f"w{r.randrange(10**9)}" for _ in range(own)]
        out.append(f"{passage} {' '.join(words)}")
        if k < pairs:
            out.append(f"{passage} {' '.join(words[:-changed])} " + " ".join(f"v{r.randrange(10**9)}" for _ in range(changed)))
    return out


def test_near_duplicates_of_small_groups_under_boilerplate(spark):
    texts = under_boilerplate()
    found = collected(near.near_duplicates(frame(spark, list(enumerate(texts))).repartition(5)))
    assert [found[i]["component_id"] for i in range(len(texts))] == [i - i % 2 if i < 300 else i for i in range(len(texts))]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_in_a_crowd_of_near_copies(spark, percent):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3_000)]
    base = [r.choice(vocabulary) for _ in range(150)]
    texts = []
    for _ in range(1_500):
        words = list(base)
        for _ in range(r.randint(1, 4)):
            words[r.randrange(150)] = r.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [" ".join(r.choice(vocabulary) for _ in range(150)) for _ in range(300)]
    found = collected(near.near_duplicates(frame(spark, list(enumerate(texts))).repartition(4), 5, percent))
    assert [found[i]["component_id"] for i in range(len(texts))] == [c for _, c in brute_components(texts, percent)]


def test_near_duplicates_edges(spark):
    assert near.near_duplicates(frame(spark, []).limit(0)).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, None), (None, "only once")]
    found = near.near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in found) == [("7", "7", True), ("7", "7", True), ("9", "9", True), ("None", "7", False), ("None", "None", True)]


def test_drop_near_duplicates(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (3, "other words are here now"), (None, None)]
    df = frame(spark, rows)
    kept = near.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == [("1", "a b c d e f"), ("3", "other words are here now"), ("None", "None")]


def test_components(spark):
    r = random.Random(4)
    chain = [(i, i + 1) for i in range(200)] + [(300 + i, 300 + r.randrange(40)) for i in range(80)] + [(5, 5), (None, 3)]
    r.shuffle(chain)
    found = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(chain, "a long, b long").repartition(7)).collect()}
    assert all(found[i] == 0 for i in range(201))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("alone", [0, 30, 100_000])
def test_components_of_a_small_graph_need_two_tables(spark, monkeypatch, alone):
    r = random.Random(7)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(180)]
    root = list(range(400))
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    made = []
    write = components.materialise
    monkeypatch.setattr(components, "ALONE", alone, raising=False)
    monkeypatch.setattr(components, "materialise", lambda df, name, *more: made.append(name) or write(df, name, *more))
    found = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert found == {x: root[x] for a, b in edges if a != b for x in (a, b)}
    assert made == ["edges", "labels"] or alone < 100_000


def test_few_rows_are_few_files_without_checksums(spark):
    df = spark.range(0, 1000, 1, 64)
    for narrow in (False, True):
        out = common.materialise(df, "test", 1000, narrow)
        files = [f.removeprefix("file://") for f in out.inputFiles()]
        assert len(files) == 1 and out.count() == 1000
        assert os.listdir(os.path.dirname(files[0])) == [os.path.basename(files[0])]


# Suffix arrays and repeated spans


def test_suffix_array():
    r = random.Random(2)
    for _ in range(1500):
        n, a = r.randint(0, 40), r.choice([1, 2, 3, 20])
        t = [r.randint(0, a) for _ in range(n)]
        if r.random() < 0.4:
            t = (t[: r.randint(1, 7)] * 40)[:n]
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i, t=t: t[i:])


def brute_spans(texts, span):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + span] for b in data for i in range(len(b) - span + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def span_texts(seed=3):
    r = random.Random(seed)
    letters = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    base, out = letters(1500), [None, "", "x" * 399, "x" * 400, "ab c" * 300, "é" * 350, letters(900)]
    for _ in range(40):
        k = r.random()
        if k < 0.4:
            out.append(letters(r.randint(0, 600)) + base[r.randint(0, 600) : r.randint(700, 1500)] + letters(r.randint(0, 300)))
        elif k < 0.8:
            x = list(base)
            for _ in range(r.randint(0, 4)):
                x[r.randrange(1500)] = r.choice("XYZ")
            out.append("".join(x))
        else:
            out.append(letters(r.randint(0, 1500)))
    return out + [base, base]


@pytest.mark.parametrize(("span", "group", "often", "bound"), [(400, 1024, 64, 24 << 20), (400, 2, 2, 0), (150, 3, 3, 0), (150, 1024, 2, 24 << 20)])
def test_repeated_spans(spark, monkeypatch, span, group, often, bound):
    monkeypatch.setattr(spans, "GROUP", group)
    monkeypatch.setattr(spans, "HOT_LEAST", often)
    monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    texts = span_texts()
    found = collected(spans.removal_digests(frame(spark, list(enumerate(texts))).repartition(4), span))
    assert [tuple(found[i])[1:5] for i in range(len(texts))] == brute_spans(texts, span)


def test_groups_of_all_rounds_are_judged_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(spans, "GROUP", 2)
    passes = []
    judge = spans._judge
    monkeypatch.setattr(spans, "_judge", lambda span: passes.append(span) or judge(span))
    texts = span_texts()
    found = collected(spans.removal_digests(frame(spark, list(enumerate(texts))), 150))
    assert [tuple(found[i])[1:5] for i in range(len(texts))] == brute_spans(texts, 150)
    assert passes == [150]


def test_spans_in_a_very_long_text(spark):
    r = random.Random(9)
    long = "".join(r.choice("abcdefgh ") for _ in range(700_000))
    inner = long[300_000:300_450]
    found = collected(spans.removal_digests(frame(spark, [(1, long), (2, "x" + inner), (3, long[5_000:5_399])]), 400))
    assert [(found[i]["n_removed"], found[i]["n_spans"]) for i in (1, 2, 3)] == [(450, 1), (450, 1), (0, 0)]
    assert found[2]["text"] == "x"


def test_windows_are_marked_by_the_suffix_array(monkeypatch):
    r = random.Random(4)
    letters = lambda n: bytes(r.choice(b"abc") for _ in range(n))
    shared = letters(300)
    contexts = [letters(100) + shared[:220] + letters(50), shared, letters(20) + shared[100:] + letters(90)] + [letters(250) for _ in range(20)]
    contexts += [b"a" * 170, b"a" * 149, b"ab" * 90, b"-" * 400 + shared[:200], b"-" * 200 + shared[:130], *(shared[:k] + b"\0" * 90 + shared[k:] for k in (40, 41, 90))]
    seen = collections.Counter(c[i : i + 150] for c in contexts for i in range(len(c) - 149))
    wanted = [i + 150 <= len(c) and seen[c[i : i + 150]] > 1 for c in contexts for i in range(len(c))]
    assert spans.repeated_windows(contexts, 150).tolist() == wanted
    monkeypatch.setattr(spans, "suffix_array", lambda t: list(range(len(t))))
    assert spans.repeated_windows(contexts, 150).tolist() != wanted


def test_repeated_spans_edges(spark):
    assert spans.removal_digests(frame(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError, match="128"):
        spans.removal_digests(frame(spark, []), 100)
    long = letters(500)
    rows = [(1, long), (1, long), (None, "head " + long), (2, None), (3, "clean")]
    df = frame(spark, rows)
    left = spans.drop_repeated(df, 400)
    assert left.columns == df.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in left.collect()) == [("2", "None"), ("3", "clean"), ("None", "head ")]


def test_repeated_spans_without_copies_of_a_text(spark, monkeypatch):
    """As after near duplicates: no text stands twice, and the ranges are too many for a broadcast."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    shared, heads = letters(300), [letters(250, seed) for seed in (1, 2, 3)]
    df = frame(spark, [(i, f"{x} {shared}") for i, x in enumerate(heads)])
    left = collected(spans.drop_repeated(df, 200))
    assert [left[i]["text"] for i in range(3)] == heads


# Media


@pytest.mark.parametrize(("bound", "often"), [(24 << 20, 64), (0, 64), (0, 3)])
def test_media(spark, texts, monkeypatch, bound, often):
    monkeypatch.setattr(common, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(media, "OFTEN", often)
    shared = letters(9_000)
    texts = texts + [shared, shared + "tail", "head" + shared, shared, shared, *(shared + str(i) for i in range(5))]
    found = collected(media.media_columns(frame(spark, list(enumerate(texts))).repartition(4)))
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        b = (t or "").encode()
        payload = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        whole = media.wave_header(len(payload)) + payload
        assert (found[i]["n_bytes"], found[i]["payload_bytes"], found[i]["payload_sha256"], found[i]["tail_crc32"]) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (found[i]["media_bytes"], found[i]["media_sha256"], found[i]["feature"]) == (len(whole), hashlib.sha256(whole).hexdigest(), media.feature(payload))


def test_media_stores_shared_chunks_once(spark):
    shared = letters(30_000)
    stored, requests, copied = media.store(frame(spark, [(1, shared), (2, "head " + shared), (3, shared), (4, "z")]))
    owned = stored.agg(F.sum(F.octet_length("owned"))).first()[0]
    assert owned < 30_000 + 3 * media.MOST
    assert requests.count() > 10 and copied.count() == 2 and stored.count() == 3


def test_media_edges(spark):
    assert media.media_columns(frame(spark, []).limit(0)).count() == 0
    rows = media.media_columns(frame(spark, [(None, "x"), (None, "y"), (1, "x"), (1, "x")])).collect()
    assert len(rows) == 4 and len({r["media_sha256"] for r in rows}) == 2
    with pytest.raises(ValueError, match="digest"):
        media.rebuild(b"", [{"digest": b"0" * 16, "length": 1, "borrowed": False}], b"x", {})
    with pytest.raises(ValueError, match="head"):
        media.read_wave(b"0" * 50)


def test_cuts_follow_content():
    r = random.Random(3)
    text = bytes(r.randrange(97, 123) for _ in range(40_000))
    a, b = media.chunked([text, b"shift" + text])
    assert b"".join(a).startswith(text) and all(len(c) <= media.MOST for c in a)
    assert len(set(a) & set(b)) >= len(a) - 3


# HTML


def test_html_blocks():
    page = "<head><title>t</title></head><body><nav><a href=x>n</a></nav><article><h1>A &amp; b</h1><p>One\n two<p>Three <b>bold</b><br>x<ul><li>i1<li>i2</ul></article><!-- <p>c</p> --><script>var t='</p>'</script>"
    blocks = html_blocks.leaf_blocks(page)
    assert [b.text for b in blocks] == ["n", "A & b", "One two", "Three bold x", "i1", "i2"]
    assert blocks[0].linked == 1 and "article" in blocks[1].path.elements() and blocks[2].path.elements()[-1] == "p"
    assert html_blocks.leaf_blocks("") == [] == html_blocks.leaf_blocks("<p> <div class='x")[:0]


def test_field_on_held_out_pages():
    r = random.Random(11)
    model = html_blocks.fit_field([html_blocks.made_page(r) for _ in range(400)])
    r = random.Random(12)
    wrong = total = 0
    for _ in range(200):
        blocks, labels = html_blocks.made_page(r)
        total += len(labels)
        wrong += sum(a != b for a, b in zip(model.decode(blocks), labels, strict=True))
    assert wrong <= 0.01 * total


def test_viterbi_is_the_best_of_all_labellings():
    r = random.Random(5)
    body = html_blocks.Path().enter("body")
    blocks = [html_blocks.Block("x" * r.randint(1, 90), body.enter(r.choice(["p", "div ad"])), 0, 0) for _ in range(7)]
    names = {f for i, b in enumerate(blocks) for f in (*html_blocks.path_features(b.path), *html_blocks.text_features(b, i, 7))}
    model = html_blocks.Field({f: (r.gauss(0, 1), r.gauss(0, 1)) for f in sorted(names)}, ((0.3, -1.0), (0.2, 0.9)), ((0.1, -0.4), (0.0, 0.3)))

    def score(labels):
        total = 0.0
        for i, b in enumerate(blocks):
            total += sum(model.weights[f][labels[i]] for f in (*html_blocks.path_features(b.path), *html_blocks.text_features(b, i, 7)))
            if i:
                total += model.pairs[labels[i - 1]][labels[i]] + (model.same[labels[i - 1]][labels[i]] if b.path == blocks[i - 1].path else 0)
        return total

    best = max(([n >> k & 1 for k in range(7)] for n in range(128)), key=score)
    assert model.decode(blocks) == best


@pytest.mark.parametrize("make", [lambda n: "<b>x<p>y</p>" * n, lambda n: '<p class="x>text</p>' * n, lambda n: "<head>x" * n, lambda n: "<a<" * n, lambda n: "".join(f"<div class=c{i}>x" for i in range(n)), lambda n: "<table><tr><td>" * n, lambda n: "<i>" * n + "</b>x" * n])
def test_broken_pages_take_linear_time(make):
    page = make(8_000)
    began = time.perf_counter()
    html_blocks.leaf_blocks(page, {"in b": (0.0, 0.0)})
    assert time.perf_counter() - began < 1.5


def test_extraction_equals_brute_force(spark):
    """Blocks by the standard library's parser, labels by trying them all, over a made table."""
    from html.parser import HTMLParser

    class Leaves(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.parts, self.found, self.linked, self.breaks, self.where = [], [], [], 0, 0, None

        def finish(self):
            text = " ".join("".join(self.parts).split())
            if text:
                path = html_blocks.Path()
                for element in self.where:
                    path = path.enter(element)
                self.found.append((text, tuple(self.where), path, min(self.linked, len(text))))
            self.parts, self.linked = [], 0

        def handle_starttag(self, tag, attributes):
            if tag in html_blocks.BLOCKS:
                self.finish()
            self.open.append(" ".join([tag, *sorted({w for k, v in attributes if k in ("class", "id") for w in v.split("-")})]))

        def handle_endtag(self, tag):
            if tag in html_blocks.BLOCKS:
                self.finish()
            self.open.pop()

        def handle_data(self, data):
            if not self.parts and not data.strip():
                return
            if not self.parts:
                self.where = list(self.open)
            self.parts.append(data)
            self.linked += len(data.strip()) if any(x.split()[0] == "a" for x in self.open) else 0

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 9)))
    text = lambda: " ".join(word() for _ in range(r.randint(1, 30))) + r.choice([".", "", "&amp;", "?&quot;"])
    piece = lambda: r.choice([f"<p>{text()}</p>", f"<div class='ad-box'><p>{text()}</p></div>", f"<ul><li><a href='/x'>{word()}</a></li></ul>", f"<h2>{text()}</h2>", f"<p>{text()} <b>{text()}</b>\n {text()}</p>", f"<aside>{text()}</aside>"])
    pages = [(i, f"http://x/{i}", f"<html><body><nav><a href='/'>{word()}</a></nav><article>{''.join(piece() for _ in range(r.randint(0, 5)))}</article><footer>{text()}</footer></body></html>") for i in range(60)]
    table = frame(spark, pages, "page_id long, url string, html string")
    model = html_blocks.train(table, made_pages=40)
    found = collected(html_blocks.extract_text(table, made_pages=40), "page_id")
    n = 0
    for i, _, page in pages:
        parser = Leaves()
        parser.feed(page)
        parser.finish()
        blocks = [html_blocks.Block(text, path, linked, 0) for text, _, path, linked in parser.found]
        costs = [[sum(model.weights.get(f, (0.0, 0.0))[y] for f in (*html_blocks.path_features(b.path), *html_blocks.text_features(b, k, len(blocks)))) for y in (0, 1)] for k, b in enumerate(blocks)]
        same = [k > 0 and parser.found[k][1] == parser.found[k - 1][1] for k in range(len(blocks))]

        def total(labels, costs=costs, same=same):
            return sum(costs[k][y] + (model.pairs[labels[k - 1]][y] + same[k] * model.same[labels[k - 1]][y] if k else 0) for k, y in enumerate(labels))

        best = max(([m >> k & 1 for k in range(len(blocks))] for m in range(1 << len(blocks))), key=total)
        wanted = "\n".join(b.text for b, y in zip(blocks, best, strict=True) if y)
        assert found[i]["text"] == wanted and found[i]["n_chars"] == len(wanted)
        n += bool(wanted)
    assert n > 30


def test_formulas_in_the_article_stay(spark):
    page = "<body><article><p>Area is <math><mi>x</mi></math> wide, and <svg><text>lab</text></svg> stands here.</p></article></body>"
    (row,) = html_blocks.extract_text(frame(spark, [(1, "u", page)], "page_id long, url string, html string"), made_pages=200).collect()
    assert row["text"] == "Area is x wide, and lab stands here."


def test_extraction(spark):
    page = "<body><header><h1>Site</h1></header><article><h1>Title</h1><p>First&nbsp;text here.</p><p>Second, longer text of the article.</p></article><div class=comments><p>a comment</p></div><footer>f</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", page), (None, "u", page)]
    found = html_blocks.extract_text(frame(spark, rows, "page_id long, url string, html string"), made_pages=300).collect()
    text = "Title\nFirst text here.\nSecond, longer text of the article."
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in found) == [("1", text, len(text)), ("2", "", 0), ("3", "", 0), ("None", text, len(text)), ("None", text, len(text))]
    assert html_blocks.extract_text(frame(spark, rows, "page_id long, url string, html string").limit(0), made_pages=20).count() == 0


# Quality and toxicity


def labelled_documents(seed=6, n=400):
    r = random.Random(seed)
    good = prose(seed, n, 80)
    rows, labels = [], []
    for i, t in enumerate(good):
        bad, toxic = r.random() < 0.25, r.random() < 0.25
        if toxic:
            w = t.split()
            for _ in range(4):
                w.insert(r.randrange(len(w) + 1), r.choice(["vile", "rotten", "scumbag", "wretch"]))
            t = " ".join(w)
        if bad:
            t = " | ".join(w.upper() + "!!" for w in t.split())
        rows.append((i, t, f"host{i % 9}", "en"))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def judged(spark):
    rows, labels = labelled_documents()
    rows += [(900, None, "host1", None), (901, "", None, "en"), (901, "", None, "en"), (None, "a word", "rare", "xx")]
    return frame(spark, rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels + [(5000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality(spark, judged):
    documents, labels = judged
    found = quality.classify(documents, labels).collect()
    assert len(found) == documents.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    wrong = sum(r["keep"] != bool(truth[r["doc_id"]]) for r in found if truth.get(r["doc_id"]) is not None)
    assert wrong <= 4
    kept = quality.keep_good(documents, labels)
    assert kept.columns == documents.columns
    assert kept.count() == sum(r["keep"] for r in found)
    assert quality.classify(documents.limit(0), labels).count() == 0
    assert {round(r["p_document"], 6) for r in quality.classify(documents, labels.limit(0)).collect()} == {0.5}


def brute_quality(model, rows):
    """p_quality of rows (text, host, path): evidence one text at a time, posteriors by their formulas."""
    logits = [float(model.logit(quality.features(np.frombuffer(b := (text or "").encode(), np.uint8), np.array([0, len(b)])))[0]) for text, _, _ in rows]
    p = [1 / (1 + math.exp(-x)) for x in logits]
    mean = (sum(p) + 1) / (len(p) + 2)
    paths, hosts = collections.defaultdict(list), collections.defaultdict(list)
    for (_, host, path), x in zip(rows, p, strict=True):
        paths[host, path].append(x)
        hosts[host].append(x)

    def strength(groups, centre):
        between = sum(len(x) * (sum(x) / len(x) - centre(k)) ** 2 for k, x in groups.items())
        chance = sum((sum(v * (1 - v) for v in x) + sum(x) * (1 - sum(x) / len(x))) / len(x) for x in groups.values())
        return min(max(mean * (1 - mean) / max(1e-9, (between - chance) / len(p)) - 1, 20.0), 1e5)

    k_host = strength(hosts, lambda k: mean)
    at_host = {k: (sum(x) + k_host * mean) / (len(x) + k_host) for k, x in hosts.items()}
    k_path = strength(paths, lambda k: at_host[k[0]])
    site = {k: (sum(x) + k_path * at_host[k[0]]) / (len(x) + k_path) for k, x in paths.items()}
    odds = lambda q: math.log(q / (1 - q))
    return [1 / (1 + math.exp(-(x + odds(site[host, path]) - odds(mean)))) for (_, host, path), x in zip(rows, logits, strict=True)]


def test_quality_equals_brute_force(spark, judged, monkeypatch):
    documents, labels = judged
    rows = documents.select("doc_id", "text", "source", "lang").collect()
    p = brute_quality(quality.train(documents, labels), [tuple(r)[1:] for r in rows])
    wanted = sorted((str(r["doc_id"]), x) for r, x in zip(rows, p, strict=True))
    found = sorted((str(r["doc_id"]), r["p_quality"]) for r in quality.classify(documents, labels).collect())
    assert [a for a, _ in found] == [a for a, _ in wanted] and [b for _, b in found] == pytest.approx([b for _, b in wanted])
    kept = sorted(str(r["doc_id"]) for r in quality.keep_good(documents, labels).collect())
    assert kept == [a for a, b in wanted if b >= 0.5]
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)  # sites that are too many for a broadcast
    for n in (100_000, 100):
        monkeypatch.setattr(quality, "FREQUENT_SITES", n)
        assert sorted(str(r["doc_id"]) for r in quality.keep_good(documents, labels).collect()) == kept


def test_sparse_sites_shrink_to_the_global_mean(spark):
    rows = [("big", "a", 3.0)] * 300 + [("bad", "a", -3.0)] * 300 + [("tiny", "a", -3.0)]
    sites, centre = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, logit double"))
    found = {r["host"]: r["site_logit"] for r in sites.collect()}
    assert found["big"] > centre > found["bad"]
    assert found["bad"] < found["tiny"] < centre


def test_segments_are_ruzzo_tompa():
    r = random.Random(9)

    def brute(x):
        # The recursive definition: the best segment, then the same left and right of it.
        best = max(((sum(x[a:b]), -a, -(b - a)) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=(0, 0, 0))
        if best[0] <= 1e-9:
            return []
        a, b = -best[1], -best[1] - best[2]
        return [*brute(x[:a]), (a, b - 1, best[0]), *[(s + b, e + b, v) for s, e, v in brute(x[b:])]]

    for _ in range(200):
        x = [r.choice([-2.5, -1.0, -0.5, 1.25, 3.0]) + r.random() / 100 for _ in range(r.randint(0, 12))]
        got = toxicity.segments(x)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute(x)]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in brute(x)])


def test_passages_of_words_that_came_before_are_found():
    model = toxicity.Model({"vile": 3.0, "rotten": 3.0, "wretch": 3.0}, 1.0, 0.1, -2.0, 0.5)
    scores = toxicity.Scores(model.known)
    alone = " ".join(f"{w} {'so ' * 40}" for w in ["vile", "rotten", "wretch"] * 2).split()
    words = [*alone, "vile", "rotten", "wretch"]
    values, found = model.find(words, scores)
    assert found[-1] == (len(alone), len(alone) + 2, 9.0) and len(found) == 7
    # Wherever it stands, the dense passage counts whole, and repetitions of one word don't.
    assert max(s for *_, s in model.damped(words, values, found)[1]) == 9.0
    often = ["vile"] * 9
    assert model.damped(often, *model.find(often, scores)) == ([6.0], [(0, 1, 6.0)])


def brute_segments(x, first=0):
    """The recursive definition of all maximal segments: the best one, then the same left and right of it."""
    sums = np.concatenate([[0.0], np.cumsum(x)])
    low = np.minimum.accumulate(sums)
    b = int(np.argmax(np.round(sums - low, 9)))
    if sums[b] - low[b] <= 1e-9:
        return []
    a = int(np.flatnonzero(np.abs(sums[:b] - low[b]) < 1e-9)[-1])
    return [*brute_segments(x[:a], first), (first + a, first + b - 1, sums[b] - sums[a]), *brute_segments(x[b:], first + b)]


def test_passages_equal_brute_force(spark, judged):
    documents, labels = judged
    model = toxicity.train(documents, labels)
    assert any(v < -toxicity.GAP for v in model.known.values())
    extra = spark.createDataFrame([(2000, "scum " * 3 + "clean " * 300 + "vile rotten scumbag wretch " * 2), (2001, "vile " * 5_000)], "doc_id long, text string")
    rows = documents.select("doc_id", "text").union(extra)
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    scores = toxicity.Scores(model.known)
    n = 0
    for r in toxicity._scored(rows, [F.col("doc_id"), F.col("text")], model, True)[0].collect():
        words = list(toxicity.WORD.finditer((texts[r["doc_id"]] or "").lower()))
        wanted = brute_segments(np.array([scores[m[0]] for m in words]))
        assert [(p["start"], p["end"]) for p in r["passages"]] == [(words[a].start(), words[b].end()) for a, b, _ in wanted]
        assert [p["score"] for p in r["passages"]] == pytest.approx([s for *_, s in wanted])
        n += len(wanted)
    assert n > 100


def test_toxicity(spark, judged):
    documents, labels = judged
    found = toxicity.score(documents, labels).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found if r["doc_id"] is not None)
    assert sum(r["predicted"] != truth[r["doc_id"]] for r in held if r["doc_id"] in truth) <= 0.03 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in found:
        if r["predicted"] and r["doc_id"] is not None:
            p = max(r["passages"], key=lambda p: p["score"])
            assert any(w in texts[r["doc_id"]].lower()[p["start"] : p["end"]] for w in ("vile", "rotten", "scumbag", "wretch"))
    left = toxicity.keep_harmless(documents, labels)
    assert left.columns == documents.columns and left.count() == sum(not r["predicted"] for r in found)
    assert toxicity.score(documents.limit(0), labels).count() == 0
    assert {round(r["score"], 6) for r in toxicity.score(documents, labels.limit(0)).collect()} == {0.1}
    assert toxicity.keep_harmless(documents, labels.limit(0)).count() == documents.count() == quality.keep_good(documents, labels.limit(0)).count()


def test_labels_of_held_out_rows_dont_matter(spark, judged):
    documents, labels = judged
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((str(r["doc_id"]), r["score"]) for r in toxicity.score(documents, x).collect()) for x in (labels, other))
    assert [x[1] for x in a] == pytest.approx([x[1] for x in b])


# BPE


def test_bpe(documents, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found, digests = collected(bpe.encode_decode(documents)), collected(bpe.encode_decode_digests(documents))
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert (found[i]["n_tokens"], found[i]["ids"], found[i]["decoded"]) == (len(ids), ids, decoded)
        assert digests[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_bpe_edges(spark):
    rows = bpe.encode_decode(frame(spark, [(None, None), (1, "a"), (1, "a")])).collect()
    assert sorted((r["doc_id"] is None, r["n_tokens"]) for r in rows) == [(False, 1), (False, 1), (True, 0)]
    assert bpe.encode_decode(frame(spark, []).limit(0)).count() == 0


def test_pair_index_merges_ranks_in_order():
    a, b, c, ab, abc, aa = range(6)
    index = bpe.PairIndex({(a, b): (1, ab), (ab, c): (2, abc), (a, a): (0, aa)})
    assert index.encode([[a, b, c], [a, a, a, b], [c], [a, b, a, b, c], []][:4]) == [[abc], [aa, ab], [c], [ab, abc]]


# URL rules


def test_url_rules(spark):
    urls = {
        1: ("http://A.Example.ORG/es/x?y", "a.example.org", "/es/x", "example.org/es/", "block"),
        2: ("https://example.org/en/123#t", "example.org", "/en/123", "example.org/en/1", "block"),
        3: ("https://other.org/en/1", "other.org", "/en/1", "org/", "allow"),
        4: ("https://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
        5: ("https://x.com/DE/1", "x.com", "/DE/1", None, "allow"),
        6: ("https://spam-farm.example.net/en/", "spam-farm.example.net", "/en/", None, "block"),
        7: (None, "", "", None, "allow"),
        8: ("no scheme", "", "", None, "allow"),
        9: ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        10: ("https://org", "org", "", None, "allow"),
        11: ("https://org/", "org", "/", "org/", "allow"),
        12: ("a://b://c.com/fr/", "b:", "//c.com/fr/", None, "allow"),
        13: ("https://ads.net/x", "ads.net", "/x", None, "block"),
        14: ("https://bads.net/x", "bads.net", "/x", None, "allow"),
        15: ("https://x.ads12.net/x", "x.ads12.net", "/x", None, "block"),
        16: ("https://adserver7.q.net", "adserver7.q.net", "", None, "block"),
        17: ("https://ads12b.net/x", "ads12b.net", "/x", None, "allow"),
    }
    df = frame(spark, [(k, v[0]) for k, v in urls.items()], "page_id long, url string").drop("part")
    found = collected(url_rules.filter_urls(df), "page_id")
    assert {k: tuple(r)[1:] for k, r in found.items()} == {k: v[1:] for k, v in urls.items()}
    assert url_rules.filter_urls(df.limit(0)).count() == 0


def test_rules_are_fetched_by_their_rarest_token():
    rules = [url_rules.host_rule("example.org", "/es/", "block"), url_rules.host_rule("example.org", "/en/1", "block"), url_rules.pattern_rule("p", "block", "x", ())]
    assert rules[1].tokens == ("example", "org", "en")
    index, always = url_rules.build_index(rules, {"example": 5, "org": 9, "es": 2, "en": 7})
    assert {t: [r.name for r in v] for t, v in index.items()} == {"es": ["example.org/es/"], "example": ["example.org/en/1"]}
    assert [r.name for r in always] == ["p"]
    assert not url_rules.build_index(url_rules.HOST_RULES + url_rules.OWN_RULES, {})[1]  # none of the rules in force runs on all URLs


def test_math_is_finite():
    model = toxicity.Model({"bad": 3.0}, 1.0, 0.1, -2.0, 0.5)
    assert model.evidence([], 10) == 0.0
    assert math.isfinite(model.evidence([(0, 0, 3.0)] * 500, 1))
