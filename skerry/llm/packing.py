"""Packing of token sequences into fixed windows by non-negative least squares over shallow length combinations."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, small_batches, worker_cache

#: A text with these characters goes to the tokenizers library; for the others both libraries agree.
UNUSUAL = "[\x00-\x08\x0b-\x1f\x7f-\xa0Ԁ-\U0010ffff]"

TOKEN_SCHEMA = "first_full long, doc_id long, doc_tokens long, full_crc32 array<long>, rest int, rest_ids binary, part int, nth long"


def _encoder(name: str):
    """text -> numpy array of ids, as the tokenizers file named encodes it without special tokens added."""
    import base64
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    def exact() -> Tokenizer:  # some ten megabytes, loaded by workers that meet an unusual text
        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    ranks_file = public_tokenizers.path(name.replace(".json", ".tiktoken"))
    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    unusual = re.compile(UNUSUAL).search

    def encode(text: str) -> np.ndarray:
        if unusual(text) or "<|" in text:
            tokenizer = worker_cache(("exact", name), exact)
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def _tokenise(name: str, window: int, separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = worker_cache(("encode", name), lambda: _encoder(name))
        seen = np.zeros(window, np.int64)
        whole = (1 << 60) + (part << 36)  # whole windows are numbered apart from packed sequences
        for batch in slices(batches, "text"):
            out = {k: [] for k in ("first_full", "doc_id", "doc_tokens", "full_crc32", "rest", "rest_ids", "part", "nth")}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(separator)).astype("<u4")
                full, rest = divmod(len(ids), window)
                out["first_full"].append(whole)
                out["doc_id"].append(doc_id)
                out["doc_tokens"].append(len(ids))
                out["full_crc32"].append([zlib.crc32(ids[k * window : (k + 1) * window].tobytes()) for k in range(full)])
                out["rest"].append(rest)
                out["rest_ids"].append(zlib.compress(ids[full * window :].tobytes(), 1) if rest else b"")
                out["part"].append(part)
                out["nth"].append(int(seen[rest]))
                seen[rest] += 1
                whole += full
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("first_full", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("full_crc32", pa.list_(pa.int64())), ("rest", pa.int32()), ("rest_ids", pa.binary()), ("part", pa.int32()), ("nth", pa.int64())]))

    return run


def combinations(lengths: np.ndarray, window: int, depth: int = 3) -> list[tuple[int, ...]]:
    """All combinations of two and, at depth 3, three of these lengths that fill a window exactly, shallow ones first: about window^2 / 12 at most."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    found: list[tuple[int, ...]] = [(int(a), int(window - a)) for a in lengths if a <= window - a and there[window - a]]
    if depth >= 3:
        triples = []
        for a in lengths:
            b = lengths[(lengths >= a) & (window - a - lengths >= lengths)]
            b = b[there[window - a - b]]
            triples.append(np.column_stack([np.full(len(b), a), b, window - a - b]))
        found += [tuple(x) for some in triples for x in some.tolist()]
    return found


def solve(counts: np.ndarray, patterns: list[tuple[int, ...]], rounds: int = 300) -> np.ndarray:
    """Non-negative repeat counts of the patterns whose lengths add up to counts in least squares.

    Multiplicative updates: each keeps the repeats non-negative and never raises the squared error.
    """
    if not patterns:
        return np.zeros(0)
    rows = np.concatenate([np.asarray(p, np.int64) for p in patterns])
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    h = counts.astype(float)
    goal = np.bincount(cols, h[rows], len(patterns))
    x = goal / (np.bincount(cols, np.bincount(rows, minlength=len(h))[rows], len(patterns)) + 1e-9) / 2 + 1e-6
    for _ in range(rounds):
        fit = np.bincount(rows, x[cols], len(h))
        x *= goal / (np.bincount(cols, fit[rows], len(patterns)) + 1e-12)
    return x


def plan(counts: np.ndarray, window: int) -> tuple[pd.DataFrame, int]:
    """Where the counts[n] rests of length n go: (a table of runs, the number of sequences).

    A run: the rests of length `rest` numbered lo <= k < hi put their ids cut .. cut+length at `offset` of
    sequence `sequence + k - lo`. The table grows with the window, not with the number of documents.
    """
    runs: list[tuple[int, int, int, int, int, int, int]] = []
    sequences = 0
    #: For each length: the runs of pieces not placed yet, as (rest, lo, hi, cut).
    pools: dict[int, list[tuple[int, int, int, int]]] = {int(n): [(int(n), 0, int(c), 0)] for n, c in enumerate(counts) if n and c}
    left = {n: p[0][2] for n, p in pools.items()}

    def place(length: int, many: int, offset: int, keep: int | None = None) -> list[tuple[int, int, int, int]]:
        """Put many pieces of this length (or their first keep ids) into the sequences from `sequences` on; return what is cut off."""
        cut_off, done = [], 0
        while done < many:
            rest, lo, hi, cut = pools[length][-1]
            take = min(hi - lo, many - done)
            runs.append((rest, lo, lo + take, cut, length if keep is None else keep, sequences + done, offset))
            if keep is not None:
                cut_off.append((rest, lo, lo + take, cut + keep))
            done += take
            if lo + take == hi:
                pools[length].pop()
            else:
                pools[length][-1] = (rest, lo + take, hi, cut)
        left[length] -= many
        if not left[length]:
            del left[length], pools[length]
        return cut_off

    patterns = combinations(np.array(sorted(left), np.int64), window)
    repeats = np.floor(solve(counts[: window], patterns) + 0.5).astype(np.int64)
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] <= 0:
            break
        need = dict(zip(*np.unique(patterns[k], return_counts=True), strict=True))
        many = int(min([repeats[k], *(left.get(int(n), 0) // int(m) for n, m in need.items())]))
        if many > 0:
            offset = 0
            for n in patterns[k]:
                place(n, many, offset)
                offset += n
            sequences += many
    # The residuals: the longest first, then whatever fits best; the last piece of a full window is cut.
    while left:
        first = max(left)
        many, offset, put = left[first], first, [first]
        while offset < window and left:
            gap = window - offset
            supply = {n: c // (put.count(n) + 1) for n, c in left.items()}
            supply = {n: c for n, c in supply.items() if c}
            if not supply:
                break
            n = max((n for n in supply if n <= gap), default=min(supply))
            many = min(many, supply[n])
            put.append(n)
            offset += n
        back, offset = [], 0
        for n in put:
            keep = min(n, window - offset)
            cut_off = place(n, many, offset, None if keep == n else keep)
            back += [(n - keep, x) for x in cut_off]
            offset += keep
        sequences += many
        for n, x in back:
            pools.setdefault(n, []).append(x)
            left[n] = left.get(n, 0) + x[2] - x[1]
    table = pd.DataFrame(runs, columns=["rest", "lo", "hi", "cut", "length", "sequence", "offset"], dtype="int64")
    return table.sort_values(["rest", "lo"], kind="stable", ignore_index=True), sequences


def _emit(runs: pd.DataFrame, window: int):
    columns = [runs[c].to_numpy() for c in ("rest", "lo", "hi", "cut", "length", "sequence", "offset")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, lo, hi, cut, length, sequence, offset = columns
        by: dict[int, np.ndarray] = {}
        for n in np.unique(rest):
            by[int(n)] = np.flatnonzero(rest == n)
        edges = {n: np.unique(np.concatenate([lo[at], hi[at]])) for n, at in by.items()}
        #: For each length, the runs that hold the numbers of each interval between two edges.
        holders = {n: [at[(lo[at] <= e) & (hi[at] > e)] for e in edges[n]] for n, at in by.items()}
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}

            def put(*values, out=out):
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)

            for x in batch.to_pylist():
                full = len(x["full_crc32"])
                for k, crc in enumerate(x["full_crc32"]):
                    put(x["doc_id"], k * window, window, crc, x["doc_tokens"], x["first_full"] + k, 0)
                if n := x["rest"]:
                    ids = None
                    for r in holders[n][int(np.searchsorted(edges[n], x["k"], "right")) - 1]:
                        if ids is None:
                            ids = zlib.decompress(x["rest_ids"])
                        a, b = 4 * int(cut[r]), 4 * int(cut[r] + length[r])
                        put(x["doc_id"], full * window + int(cut[r]), int(length[r]), zlib.crc32(ids[a:b]), x["doc_tokens"], int(sequence[r]) + x["k"] - int(lo[r]), int(offset[r]))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in out]))

    return run


def pack(documents: DataFrame, window: int = 1024, tokenizer: str = "byte_bpe_50k.json", separator: int = 0) -> DataFrame:
    """Pack every document's ids (tokenizer's, then the separator) into sequences of at most window ids.

    Takes doc_id and text of documents; other columns, whatever their names, are not read. Each window-long stretch
    of a document is a sequence of its own. The rests (under window ids) are packed by a plan that is solved
    once on the driver over the histogram of rest lengths: combinations of two or three lengths that fill a window are
    enumerated, non-negative least squares gives their repeat counts, these are rounded and capped by what is there, and
    residuals are packed greedily, cutting the last piece of a window. Only the last sequence can be short.

    Numbers within a length come from counts by input partition and a prefix sum over partitions, so neither the driver
    nor any task sees more than its share, and copies of one text spread over all partitions.

    A null or empty text is the separator alone. Repeated rows are packed once each. A null doc_id stays null. An empty
    table gives an empty table. Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    small_batches(documents)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = materialise(rows.mapInArrow(_tokenise(tokenizer, window, separator), TOKEN_SCHEMA), "tokens")
    by_part = materialise(tokens.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.size("full_crc32")).alias("full")), "token_counts")
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = np.zeros(window + 1, np.int64)
    for x in by_part.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # at most one row for each length under the window
        counts[x["rest"]] = x["n"]
    runs, sequences = plan(counts[:window] * (np.arange(window) > 0), window)
    placed = tokens.join(bases, ["part", "rest"]).select("doc_id", "doc_tokens", "full_crc32", "first_full", "rest", "rest_ids", (F.col("base") + F.col("nth")).alias("k"))
    return placed.mapInArrow(_emit(runs, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
