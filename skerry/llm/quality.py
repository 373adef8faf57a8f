"""Quality classifier: logistic evidence of each document, combined with shrunken posteriors of its host and path."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, fresh, materialise, sized, slices, small_batches, text_key, utf8
from .words import LOWER, split_words, word_hashes

#: The classifier learns from at most so many labelled rows, those with the least hash of doc_id.
LABELLED_ROWS = 20_000
#: Sites with the most rows, so many at most, are looked up in a table that all tasks hold, where all sites are too many for one.
FREQUENT_SITES = 100_000

#: Classes of bytes whose shares of a text are features.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t", "line": b"\n\r", "stop": b".", "comma": b",", "mark": b"!?", "bar": b"|", "sign": b"#$%&*@^~+=<>_\\/", "other": b"\"'()-:;[]{}`"}
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _n, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes)] = _n


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each text: shares of byte classes, and how words repeat, run and vary."""
    n, kinds = len(offsets) - 1, len(CLASSES) + 1
    sizes = np.diff(offsets)
    shares = np.bincount(np.repeat(np.arange(n) * kinds, sizes) + _CLASS[data], minlength=n * kinds).reshape(n, kinds) / np.maximum(sizes, 1)[:, None]
    starts, lengths, text = split_words(data, offsets)
    hashes = word_hashes(LOWER[data], starts, lengths)
    words = np.bincount(text, minlength=n)
    least = np.maximum(words, 1)
    same = np.zeros(len(text), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((hashes, text))
    fresh = np.ones(len(text), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order][fresh], minlength=n)
    upper = (data[starts] >= 0x41) & (data[starts] <= 0x5A)
    second = np.minimum(starts + 1, max(len(data) - 1, 0))
    shout = upper & (lengths > 2) & (data[second] >= 0x41) & (data[second] <= 0x5A) if len(starts) else upper
    tail = data[starts + lengths - 1] if len(starts) else data[:0]
    signs = np.isin(_CLASS[tail], [list(CLASSES).index(k) for k in ("mark", "bar", "sign")])
    per_word = [np.bincount(text, x, n) / least for x in (lengths, same, upper, shout, signs)]
    per_word[0] = np.minimum(per_word[0], 40) / 10
    rest = [distinct / least, np.log1p(words) / 10, distinct / np.maximum(np.power(least, 0.85), 1), (words == 0).astype(float)]
    return np.column_stack([shares, np.sqrt(shares[:, [1, 7, 8, 9]]), *per_word, np.sqrt(per_word[1]), *rest])


@dataclass
class Model:
    """A logistic model over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[1:] + self.weights[0], -12, 12)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Model:
    """Penalised maximum likelihood by Newton steps; without rows of both labels, the base rate alone."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.concatenate([[np.log(rate / (1 - rate))], np.zeros(x.shape[1])]))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.column_stack([np.ones(len(x)), np.clip((x - mean) / scale, -8, 8)])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w)


def _text_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        x = features(*utf8(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])


def train(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """Fit on at most `rows` labelled documents. Labels: doc_id, quality; rows with nulls are left out, of several for an id the least counts, of several texts the one of least hash."""
    small_batches(documents)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("label"))
    known = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(rows))  # bounded by rows
    taken = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(known, "id")
    text = F.coalesce("text", F.lit(""))  # an id may stand in many rows
    taken = taken.groupBy("id").agg(F.first("label").alias("label"), F.min_by(text, F.struct(F.xxhash64(text), text)).alias("text"))
    found = taken.select("label", "text").mapInArrow(_text_features, "label int, x array<double>").toArrow()
    width = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    x = np.array(found.column("x").to_pylist(), float).reshape(found.num_rows, width)
    order = np.lexsort(x.T[:3]) if len(x) else slice(None)  # the order of rows, which differs from run to run, shall not matter
    return fit(x[order], found.column("label").to_numpy()[order].astype(float))


def _append_logit(model: Model, text_column: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            z = model.logit(features(*utf8(batch.column(batch.schema.get_field_index(text_column)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z)], [*batch.schema.names, name])

    return run


def _evidence(documents: DataFrame, columns: list[Column], model: Model, name: str, text: str = "text") -> DataFrame:
    """The chosen columns, of which one is the text, with one more of this name: the classifier's evidence for good quality."""
    chosen = documents.select(*columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields)
    return chosen.mapInArrow(_append_logit(model, text, name), f"{kinds}, `{name}` double")


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """Shrunken posteriors by grouped aggregation: (host, path, site_logit) and the global logit.

    Each document counts with its probability. A host's mean is drawn to the global mean, a path's to its host's, each
    with a strength (in documents) that the method of moments takes from how far sites differ beyond chance.
    Three aggregations with map-side sums; their size is that of the sites, not of the documents.
    """
    p = 1 / (1 + F.exp(-F.col("logit")))
    paths = materialise(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * (1 - p)).alias("v")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("v").alias("host_v"))
    totals = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    mean = (totals["s"] + 1) / (totals["n"] + 2) if totals["n"] else 0.5
    mean = min(max(mean, 1e-4), 1 - 1e-4)

    def strength(groups: DataFrame, n: str, s: str, v: str, centre: Column) -> float:
        rate = F.col(s) / F.col(n)
        x = groups.agg(F.sum(F.col(n) * (rate - centre) ** 2).alias("between"), F.sum((F.col(v) + F.col(s) * (1 - rate)) / F.col(n)).alias("chance"), F.sum(n).alias("n")).first()
        if not x["n"]:
            return 1e4
        spread = max(1e-9, (x["between"] - x["chance"]) / x["n"])
        return float(min(max(mean * (1 - mean) / spread - 1, 20.0), 1e5))

    k_host = strength(hosts, "host_n", "host_s", "host_v", F.lit(mean))
    host_mean = (F.col("host_s") + k_host * mean) / (F.col("host_n") + k_host)
    both = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"]).withColumn("host_mean", host_mean)
    k_path = strength(both, "n", "s", "v", F.col("host_mean"))
    post = (F.col("s") + k_path * F.col("host_mean")) / (F.col("n") + k_path)
    return both.select("host", "path", F.log(post / (1 - post)).alias("site_logit")), float(np.log(mean / (1 - mean)))


def _sites(documents: DataFrame, host: Column, path: Column, model: Model) -> tuple[DataFrame, DataFrame, float]:
    scored = _evidence(documents, [F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").cast("string").alias("text")], model, "logit")
    scored = materialise(scored.select("doc_id", "host", "path", "logit", *text_key("text")), "evidence")
    sites, centre = site_posteriors(scored)
    return scored, materialise(sites, "sites"), centre


def classify(documents: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """For every document: doc_id, host, path, p_document, p_quality, keep (p_quality >= threshold).

    Takes doc_id, text and the columns named host and path; others are not read. The texts are read once for all and
    their evidence stored; sites are aggregated from it and joined back, so no text is shuffled.
    A null text counts as empty; a null host or path is a site of its own. Repeated rows count and are returned each.
    An empty table gives an empty one; without labels every document gets the base rate one half.
    """
    model = train(documents, labels, labelled_rows)
    scored, sites, centre = _sites(documents, F.col(host), F.col(path), model)
    sites = sized(sites.withColumnsRenamed({"host": "site_host", "path": "site_path"}), 100)
    joined = scored.join(sites, scored["host"].eqNullSafe(sites["site_host"]) & scored["path"].eqNullSafe(sites["site_path"]), "left")
    p = 1 / (1 + F.exp(-(F.col("logit") + F.col("site_logit") - centre)))
    return joined.select("doc_id", "host", "path", (1 / (1 + F.exp(-F.col("logit")))).alias("p_document"), p.alias("p_quality"), (p >= threshold).alias("keep"))


def keep_good(documents: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """The documents, all their columns unchanged, whose p_quality as of classify() reaches the threshold.

    A few sites are broadcast, and texts are read once more without a shuffle. If sites are too many for that, rows are judged
    in the table of evidence, which has no texts, and verdicts come back by doc_id and text: those of the rejected rows, so most rows
    meet nothing. Rows that are alike in doc_id, text, host and path have one verdict.
    """
    model = train(documents, labels, labelled_rows)
    names = documents.columns
    scored, sites, centre = _sites(documents, F.col(f"`{host}`"), F.col(f"`{path}`"), model)
    site_host, site_path, site_logit, logit = fresh(names, "site_host", "site_path", "site_logit", "logit")
    sites = sites.withColumnsRenamed({"host": site_host, "path": site_path, "site_logit": site_logit})
    of_host, of_path = F.col(f"`{host}`").cast("string"), F.col(f"`{path}`").cast("string")
    if fits(sites, 100):
        rows = _evidence(documents, [F.col(f"`{c}`") for c in names], model, logit)
        rows = rows.join(F.broadcast(sites), of_host.eqNullSafe(F.col(site_host)) & of_path.eqNullSafe(F.col(site_path)), "left")
        own = F.col(f"`{logit}`") + F.col(f"`{site_logit}`") - centre
        return rows.where(1 / (1 + F.exp(-own)) >= threshold).select(*(F.col(f"`{c}`") for c in names))
    # Sites that many rows share go by a table that is bounded by its rows' number, the others by shuffle; no text does.
    counted = scored.groupBy("host", "path").agg(F.count("*").alias("n"))
    least = max(1, -(-scored.count() // FREQUENT_SITES))
    large = F.broadcast(counted.where(F.col("n") >= least).select("host", "path"))
    alike = lambda a, b: a["host"].eqNullSafe(b[site_host]) & a["path"].eqNullSafe(b[site_path])
    same = (sites[site_host].eqNullSafe(large["host"])) & (sites[site_path].eqNullSafe(large["path"]))
    often, rest = F.broadcast(sites.join(large, same, "left_semi")), sites.join(large, same, "left_anti")
    in_large = scored["host"].eqNullSafe(large["host"]) & scored["path"].eqNullSafe(large["path"])
    judged = scored.join(often, alike(scored, often)).select(*scored.columns, site_logit)
    judged = judged.union((few := scored.join(large, in_large, "left_anti")).join(rest, alike(few, rest)).select(*scored.columns, site_logit))
    bad = judged.where(1 / (1 + F.exp(-(F.col("logit") + F.col(site_logit) - centre))) < threshold)
    key = ["doc_id", "k1", "k2", "host", "path"]
    verdict = fresh(names, *key)
    bad = sized(materialise(bad.select(*(F.col(c).alias(n) for c, n in zip(key, verdict, strict=True))).distinct(), "rejected"), 80)
    k1, k2 = text_key("text")
    own = [F.col("doc_id").cast("long"), k1, k2, of_host, of_path]
    match = [a.eqNullSafe(bad[n]) for a, n in zip(own, verdict, strict=True)]
    return documents.join(bad, reduce(and_, match), "left_anti")
