"""Toxic passages: maximum-scoring segments over Dirichlet-smoothed token log-odds, judged by extreme-value statistics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, slices, small_batches

#: The token model learns from at most so many labelled rows, those with the least hash of doc_id.
LABELLED_ROWS = 30_000
#: Stems: a word that was seen too seldom borrows the odds of its first letters, longest stem first.
STEMS = (8, 7, 6, 5, 4, 3)
#: As evidence, a text counts a word at most so often, first in its best segments: repetitions are no further evidence.
PER_TEXT = 2
#: Weight, in occurrences, of the prior that a unit takes from its stem, and a stem from the base rate.
PRIOR = 2.0
#: What a token without evidence of its own takes off a segment.
GAP = 0.5
#: The share of toxic rows that is taken for granted, with the weight of one row, where labels of a kind are missing.
UNLABELLED = 0.1
#: Scores stay between these.
LOWEST, HIGHEST = -2.0, 8.0
#: Words of fewer occurrences have no negative score of their own.
HARMLESS = 10

#: Occurrences in toxic and clean texts of either half of the labelled rows.
COUNTS = ("toxic0", "clean0", "toxic1", "clean1")

WORD = re.compile(r"\w+")


def units(word: str) -> list[str]:
    """The word itself and its stems, marked by their length."""
    return [word, *(f"{n}>{word[:n]}" for n in STEMS if len(word) >= n)]


class Scores(dict):
    """word -> score; a word asked for the first time gets its own score, else its longest known stem's, else the gap's."""

    def __init__(self, known: dict[str, float]):
        super().__init__()
        self.known = known
        self.stems = {n: {u[2:]: s for u, s in known.items() if u.startswith(f"{n}>")} for n in STEMS}

    def __missing__(self, word: str) -> float:
        score = self.known.get(word)
        if score is None:
            score = next((table[word[:n]] for n, table in self.stems.items() if len(word) >= n and word[:n] in table), -GAP)
        if len(self) > 250_000:
            self.clear()
        self[word] = score
        return score


def segments(scores: Sequence[float] | np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa) of the tokens' scores, in one pass: (first token, last token, score)."""
    x = np.asarray(scores, float)
    sums = np.concatenate([[0.0], np.cumsum(x)])
    positive = np.flatnonzero(x > 0)
    # Kept candidates: first token, last token, sum before, sum after, the last candidate before it whose sum before is less.
    kept: list[tuple[int, int, float, float, int]] = []
    for n, left, right in zip(positive.tolist(), sums[positive].tolist(), sums[positive + 1].tolist(), strict=True):
        first = n
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= right:
                kept.append((first, n, left, right, j))
                break
            first, left = kept[j][0], kept[j][2]
            del kept[j:]
            j -= 1
    return [(a, b, right - left) for a, b, left, right, _ in kept]


@dataclass
class Model:
    """Scores of units above the gap or known to be harmless, the extreme-value parameters, and the final calibration."""

    known: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda
    size: float = 1.0  # K
    intercept: float = -2.0
    slope: float = 0.0

    def find(self, words: list[str], scores: Scores) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
        """The score of every word, and all maximal scoring segments over them."""
        values = np.fromiter(map(scores.__getitem__, words), float, len(words))
        return values, segments(values) if (values > 0).any() else []

    def damped(self, words: list[str], values: np.ndarray, found: list[tuple[int, int, float]]) -> tuple[list[float], list[tuple[int, int, float]]]:
        """Each segment's best score, and all segments of the text, where a word's places beyond PER_TEXT are no evidence.

        For the first, its places in the segment count; for the second, those in the whole text, the best segments' first.
        """

        def parts(a: int, b: int, times: Counter[str]) -> list[tuple[int, int, float]]:
            if a == b:
                times[words[a]] += 1
                return [(a, a, float(values[a]))] if times[words[a]] <= PER_TEXT else []
            own = values[a : b + 1].copy()
            for i in np.flatnonzero(own > 0).tolist():
                times[words[a + i]] += 1
                if times[words[a + i]] > PER_TEXT:
                    own[i] = -GAP
            return [(a + x, a + y, s) for x, y, s in segments(own)]

        own = [s if a == b else max(s for *_, s in parts(a, b, Counter())) for a, b, s in found]
        seen: Counter[str] = Counter()
        return own, [x for k in sorted(range(len(found)), key=lambda k: (-own[k], k)) for x in parts(*found[k][:2], seen)]

    def evidence(self, found: list[tuple[int, int, float]], tokens: int) -> float:
        """-log of the chance that the r highest segments of harmless text of so many tokens sum up as high, for the r where that is least.

        With T the normalised sum of r scores the chance is about exp(-T) T^(r-1) / (r! (r-1)!) (sum statistics of segments).
        """
        if not found:
            return 0.0
        each = np.sort([self.rate * s for _, _, s in found])[::-1] - np.log(max(self.size * tokens, 1e-3))
        r = np.arange(1, len(each) + 1)
        sums, factorials = np.cumsum(each), np.cumsum(np.log(r))
        usable = sums > r
        tails = sums - (r - 1) * np.log(np.where(usable, sums, 1)) + factorials + factorials - np.log(r)
        return float(max(np.where(usable, tails, 0).max(), np.logaddexp(0, each[0])))

    def probability(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-(self.intercept + self.slope * min(evidence, 25.0)))))


def token_places(text: str, words: list[str]) -> tuple[list[int], list[int]]:
    """Where each word of a text begins and ends, from the lengths of the words and of what stands between them."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    between = np.fromiter(map(len, WORD.split(text)), np.int64, len(words) + 1)
    ends = np.cumsum(lengths + between[:-1])
    return (ends - lengths).tolist(), ends.tolist()


def held_out(doc_id: Column) -> Column:
    """Whether CRC-32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        columns = list(zip(*counts.values(), strict=True)) or [()] * 4
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array(x, pa.int64()) for x in columns)], ["unit", *COUNTS])
        counts.clear()
        return out

    for batch in slices(batches, "text"):
        for text, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "fold")), strict=True):
            column = 2 * fold + (0 if label else 1)
            for word, n in Counter(WORD.findall(text.lower())).items():
                for unit in units(word):
                    counts.setdefault(unit, [0, 0, 0, 0])[column] += min(n, PER_TEXT)
        if len(counts) > 200_000:
            yield flush()
    yield flush()


def _log_odds(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Scores of units: posterior log-odds against the base rate, one standard error nearer to zero and at most -GAP if not clearly positive; priors go from stem to word."""
    base = (n_toxic + 1) / (n_toxic + n_clean + 2)
    counts = {u: (t, c) for u, t, c in rows}
    theta: dict[str, tuple[float, float]] = {}

    def parents(unit: str) -> list[str]:
        n, mark, stem = unit.partition(">")
        return [f"{k}>{stem[:k]}" for k in STEMS if k < int(n)] if mark else units(unit)[1:]

    for unit in sorted(counts, key=lambda u: (">" not in u, len(u), u)):  # stems first, short ones before long ones
        prior = next((theta[p][0] for p in parents(unit) if p in theta), base)
        t, c = counts[unit]
        mean = (t + PRIOR * prior) / (t + c + PRIOR)
        theta[unit] = mean, t + c + PRIOR
    known = {}
    for unit, (mean, weight) in theta.items():
        mean = min(max(mean, 1e-4), 1 - 1e-4)
        error = 1 / np.sqrt(weight * mean * (1 - mean) + 0.25)
        score = np.log(mean / (1 - mean)) - np.log(base / (1 - base))
        if score - error > 0.5:
            known[unit] = float(min(score - error, HIGHEST))
        else:
            known[unit] = float(min(max(score + error, LOWEST), -GAP))
    # A unit that scores like an unknown one is needed only where a stem above it would lend it a score; stems lend no negative ones.
    return {u: s for u, s in known.items() if s > 0 or (s < -GAP and ">" not in u) or any(known.get(p, -GAP) > 0 for p in parents(u))}


def _extremes(models: list[Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = [Scores(m.known) for m in models]
        for batch in slices(batches, "text"):
            n, all_found = [], []
            for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                words = WORD.findall(text.lower())
                n.append(len(words))
                values, found = models[1 - fold].find(words, scores[1 - fold])
                all_found.append([s for *_, s in models[1 - fold].damped(words, values, found)[1]])
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(n, pa.int64()), pa.array(all_found, pa.list_(pa.float64()))], ["label", "n", "scores"])

    return run


def _solve_rate(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive lambda with sum(share * exp(lambda * value)) = 1."""
    low, high = 0.0, 1.0
    total = lambda x: float((shares * np.exp(np.minimum(x * values, 600))).sum())
    while total(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 1 else (low, middle)
    return max(low, 0.05)


def train(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """Learn from at most `rows` labelled documents that aren't held out. Labels: doc_id, toxic; nulls are left out, of several for an id the greatest counts, of several texts the one of least hash."""
    small_batches(documents)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("label"))
    known = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(rows))  # bounded by rows
    taken = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(known, "id")
    # An id may stand in many rows: of its texts the one of least hash counts. Copies of a text are one piece of evidence.
    text = F.coalesce("text", F.lit(""))
    taken = taken.groupBy("id").agg(F.first("label").alias("label"), F.min_by(text, F.struct(F.xxhash64(text), text)).alias("text"))
    taken = materialise(taken.groupBy("text").agg(F.max("label").alias("label")).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")), "labelled", rows)
    totals = {x["label"]: x["count"] for x in taken.groupBy("label").count().collect()}
    toxic, clean = sum(n for k, n in totals.items() if k), totals.get(0, 0)
    if not toxic or not clean:
        rate = (toxic + UNLABELLED) / (toxic + clean + 1)
        return Model(intercept=float(np.log(rate / (1 - rate))))
    counts = taken.mapInArrow(_count_units, "unit string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("unit").agg(*(F.sum(c).alias(c) for c in COUNTS))
    counts = materialise(counts.withColumns({"toxic": F.col("toxic0") + F.col("toxic1"), "clean": F.col("clean0") + F.col("clean1")}), "units", rows)  # as many as the labelled rows make, whatever the input
    sums = counts.where(~F.col("unit").contains(">")).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS)).first()
    all_toxic, all_clean = max(sums["toxic0"] + sums["toxic1"], 1), max(sums["clean0"] + sums["clean1"], 1)
    # Units of toxic documents, words under their stems, and words that are often seen; the sample of rows bounds their number.
    suspect = counts.where((F.col("toxic") > PER_TEXT) & (F.col("toxic") * all_clean > 2 * F.col("clean") * all_toxic))
    stems = F.broadcast(suspect.where(F.col("unit").contains(">")).select(F.col("unit").alias("stem")))
    letters = F.regexp_replace("unit", "^[0-9]>", "")
    above = F.array(*(F.when(F.length(letters) >= n, F.concat(F.lit(f"{n}>"), letters.substr(1, n))) for n in STEMS))
    under = counts.withColumn("stem", F.explode(above)).join(stems, "stem", "left_semi").select(counts.columns)
    common = counts.where(~F.col("unit").contains(">") & (F.col("toxic") + F.col("clean") >= HARMLESS))
    table = suspect.union(under).union(common).distinct().toPandas().sort_values("unit")

    def known(t: str, c: str, n_toxic: int, n_clean: int) -> dict[str, float]:
        enough = table[table[t] + table[c] > 0]
        return _log_odds(list(zip(enough["unit"], enough[t], enough[c], strict=True)), n_toxic, n_clean)

    model = Model(known("toxic", "clean", all_toxic, all_clean))
    halves = [Model(known(f"toxic{k}", f"clean{k}", max(sums[f"toxic{k}"], 1), max(sums[f"clean{k}"], 1))) for k in (0, 1)]
    # The chance of each score in harmless text.
    seen = dict(zip(table["unit"], table["clean"], strict=True))
    scored = [(s, seen.get(u, 0) + 0.5) for u, s in model.known.items() if ">" not in u]
    values, shares = np.array([s for s, _ in scored] + [-GAP]), np.array([n / all_clean for _, n in scored] + [0.0])
    shares[-1] = max(1 - shares[:-1].sum(), 0.0)
    shares /= shares.sum()
    model.rate = _solve_rate(values, shares)
    # Each half is judged by the other half's odds, so that the calibration sees what new texts get.
    sample = taken.mapInArrow(_extremes(halves), "label int, n long, scores array<double>").toPandas()
    quiet = sample[sample.label == 0]
    top = quiet.scores.map(lambda x: max(x, default=0.0)).to_numpy(float)
    # Method of moments for the Gumbel law of the maximum: its mean is (ln(K n) + Euler's constant) / lambda.
    model.size = float(np.exp(np.clip((model.rate * top - np.log(np.maximum(quiet.n.to_numpy(float), 1))).mean() - 0.5772156649, -12, 0)))
    x = np.array([model.evidence([(0, 0, s) for s in found], n) for found, n in zip(sample.scores, sample.n, strict=True)])
    model.intercept, model.slope = _calibrate(x, (sample.label > 0).to_numpy(float))
    return model


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the evidence, slightly penalised so that separable labels stay finite."""
    order = np.lexsort((y, x))
    x, y = np.minimum(x[order], 25.0), y[order]
    w = np.array([np.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.5])
    z = np.column_stack([np.ones(len(x)), x])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z + np.diag([1e-6, 1.0]), z.T @ (y - p) - np.array([0, 1.0]) * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(w[0]), float(max(w[1], 0.01))


def _append(model: Model, text_column: str, passages: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model.known)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))
        for batch in slices(batches, text_column):
            out, spans = [], []
            for text in batch.column(batch.schema.get_field_index(text_column)).to_pylist():
                low = (text or "").lower()
                words = WORD.findall(low)
                values, found = model.find(words, scores)
                own, counted = model.damped(words, values, found)
                out.append(model.probability(model.evidence(counted, len(words))))
                if passages:
                    starts, ends = token_places(low, words) if found else ([], [])
                    chances = -np.expm1(-model.size * max(len(words), 1) * np.exp(-model.rate * np.array(own)))
                    spans.append([{"start": starts[a], "end": ends[b], "score": s, "p_value": p} for (a, b, s), p in zip(found, chances.tolist(), strict=True)])
            more = [pa.array(out, pa.float64())] + ([pa.array(spans, kind)] if passages else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names[: 1 + passages]])

    return run


def _scored(documents: DataFrame, columns: list[Column], model: Model, passages: bool, text: str = "text") -> tuple[DataFrame, str, str]:
    """The columns, of which one is the text, with the score and the passages, and the names of these two."""
    chosen = documents.select(*columns)
    names = fresh(chosen.columns, "score", "passages")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields)
    extra = f", `{names[1]}` array<struct<start:long,end:long,score:double,p_value:double>>" if passages else ""
    return chosen.mapInArrow(_append(model, text, passages, names), f"{kinds}, `{names[0]}` double{extra}"), *names


def score(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """For every document: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold), passages.

    Passages are all maximal scoring segments over the scores of all words of the text: character range in the lower-cased text,
    score, and the chance of one as high anywhere in a harmless text of this length, for which a passage's word counts PER_TEXT
    times at most. Scores are functions of the text alone; the model goes to the executors and its size is bounded by
    labelled_rows. Documents are scored where they lie, without a shuffle; a text is scanned whole, however long, in time linear in its length.
    A null or empty text has no passage and gets the score of no evidence. Repeated rows give repeated rows; a null doc_id isn't held out;
    an empty table gives an empty one; without labels of both kinds every document gets the labels' rate, UNLABELLED without any.
    Only doc_id and text are read.
    """
    model = train(documents, labels, labelled_rows)
    rows, own, passages = _scored(documents, [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")], model, True)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(own).alias("score"), (F.col(own) >= threshold).cast("int").alias("predicted"), F.col(passages).alias("passages"))


def keep_harmless(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """The documents, all their columns unchanged, whose score as of score() stays under the threshold."""
    model = train(documents, labels, labelled_rows)
    rows, own, _ = _scored(documents, [F.col(f"`{c}`") for c in documents.columns], model, False)
    return rows.where(F.col(f"`{own}`") < threshold).select(*(F.col(f"`{c}`") for c in documents.columns))
