"""Exact removal of byte strings that repeat across or within documents, judged by suffix arrays of aligned contexts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, fresh, inner_ranges, materialise, mix64, sized, slices, small_batches, text_key, utf8
from .suffix_array import suffix_array

#: Bytes of the grams whose least hash anchors a string.
GRAM = 32
#: Texts are hashed in slices of about so many bytes, each of which takes some hundred bytes of memory for a while.
SLICE = 1 << 18
#: Bytes of the grams that make phrase edges, and the longest phrase.
PHRASE_GRAM, LONGEST = 8, 64
#: A task builds one suffix array over groups of about so many bytes.
ARRAY_BYTES = 1 << 18
#: Contexts of a group that one suffix array takes; larger groups are split.
GROUP = 1024
#: Names that stand this often, and in one of HOT_KEYS places or more, are looked up in a table that all tasks hold; it has HOT_KEYS rows at most.
HOT_LEAST, HOT_KEYS = 64, 100_000

_RANDOM = np.random.Generator(np.random.PCG64(4))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION = np.uint64((1 << 30) - 1)


class Rolling:
    """Hashes of any stretches of some bytes, from sums of their prefixes modulo 2^64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.full(n + 1, _BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.back = np.full(n + 1, _INVERSE, np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers[:n], out=self.sums[1:])

    def at(self, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return mix64((self.sums[starts + length] - self.sums[starts]) * self.back[starts])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix64((self.sums[length:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


def least_positions(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each start of a window of hashes the position of its least one, the first of equal ones."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(hashes) > int(_POSITION):
        raise ValueError("a text of 1 GiB or more")
    m = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= window:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return (np.minimum(m[:n], m[window - width : window - width + n]) & _POSITION).astype(np.int64)


def anchor_runs(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[Rolling, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rolling hashes, anchor, first, last, text) of the runs of windows of span bytes that have the same anchor.

    A window's anchor is the gram of least hash in it, so equal windows have equal anchors at equal places.
    """
    rolling = Rolling(data)
    anchors = least_positions(rolling.all(GRAM), span - GRAM + 1)
    sizes = np.maximum(np.diff(offsets) - span + 1, 0)
    starts = np.repeat(offsets[:-1], sizes) + inner_ranges(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    own = anchors[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(starts)) - 1 if len(at) else at
    return rolling, own[at], starts[at], starts[last], text[at]


def side_hashes(rolling: Rolling, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, has left, right, has right): hashes of the halves of a window about its anchor, of which each window of a run holds one."""
    reach = (span - GRAM) // 2
    has_left, has_right = anchor - first >= reach, last > anchor - reach
    left, right = np.zeros(len(anchor), np.uint64), np.zeros(len(anchor), np.uint64)
    left[has_left] = rolling.at(anchor[has_left] - reach, reach + GRAM)
    right[has_right] = rolling.at(anchor[has_right], span - reach)
    return left, has_left, right ^ np.uint64(0x5555555555555555), has_right


def _digest(stretch: bytes) -> bytes:
    return hashlib.blake2b(stretch, digest_size=16).digest()


NAME = pa.struct([("a", pa.int64()), ("b", pa.int64())])


def _names(span: int):
    """For each text the names of its half-windows (a hash and 1 or 2) and of its contexts (128 bits), each at most twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            data, offsets = utf8(batch.column("text"))
            rolling, anchor, first, last, text = anchor_runs(data, offsets, span)
            left, has_left, right, has_right = side_hashes(rolling, anchor, first, last, span)
            whole = data.tobytes()
            digests = np.frombuffer(b"".join([_digest(whole[i:j]) for i, j in zip(first.tolist(), (last + span).tolist(), strict=True)]), "<i8").reshape(-1, 2)
            n_left, n_right = int(has_left.sum()), int(has_right.sum())
            a = np.concatenate([left[has_left].view(np.int64), right[has_right].view(np.int64), digests[:, 0]])
            b = np.concatenate([np.full(n_left, 1), np.full(n_right, 2), digests[:, 1]])
            owner = np.concatenate([text[has_left], text[has_right], text])
            order = np.lexsort((b, a, owner))
            same = np.zeros(len(order), bool)
            same[2:] = (a[order][2:] == a[order][:-2]) & (b[order][2:] == b[order][:-2]) & (owner[order][2:] == owner[order][:-2])
            order = order[~same]
            at = np.searchsorted(owner[order], np.arange(len(offsets)))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(a[order]), pa.array(b[order])], fields=list(NAME)))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), lists], ["k1", "k2", "names"])

    return run


KNOWN = "array<struct<a:long,b:long,first:boolean>>"


def _split_names(hot_a: np.ndarray, hot_b: np.ndarray, hot_first: np.ndarray):
    """Each text's names that are among the most frequent ones, and the others. first: whether the text is the one that shows a context's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("first", pa.bool_())])
        for batch in batches:
            lists = batch.column("names")
            flat = lists.flatten()
            a, b = (flat.field(k).to_numpy() for k in range(2))
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(counts)), counts)
            hot, first = np.zeros(len(a), bool), np.zeros(len(a), bool)
            k1 = batch.column("k1").to_numpy()
            place = np.searchsorted(hot_a, a)
            for _ in range(2 if len(hot_a) else 0):  # two names rarely have the same first half
                at = np.minimum(place, len(hot_a) - 1)
                found = (hot_a[at] == a) & (hot_b[at] == b)
                hot |= found
                first |= found & (hot_first[at] == k1[owner])
                place = place + 1

            def part(rows: np.ndarray, more: bool, a=a, b=b, first=first, owner=owner, counts=counts) -> pa.Array:
                at = pa.array(np.searchsorted(owner[rows], np.arange(len(counts) + 1)), pa.int32())
                columns = [pa.array(a[rows]), pa.array(b[rows]), *([pa.array(first[rows])] if more else [])]
                return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(columns, fields=list(kind)[: len(columns)]))

            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "copies")), part(np.flatnonzero(hot), True), part(np.flatnonzero(~hot), False)], ["k1", "k2", "copies", "hot", "cold"])

    return run


RANGES = "array<struct<lo:long,hi:long>>"
LEVEL = "key binary, k1 long, k2 long, first long, core int, width int, multiple boolean, context binary"


def _arrow(rows: list, kinds: str) -> pa.RecordBatch:
    types = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), RANGES: pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))}
    named = [x.split(" ") for x in kinds.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, (_, k) in zip(columns, named, strict=True)], [n for n, _ in named])


def _contexts(span: int):
    """Of each text: one row with the ranges of its contexts that stand elsewhere as a whole, and a row for each context that may share a window with others.

    The latter are contexts that stand once but have a repeated half, cut to the windows that hold such a half, and those that stand
    more than once, from one of their texts, as witnesses against the former.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            data, offsets = utf8(batch.column("text"))
            rolling, anchor, first, last, text = anchor_runs(data, offsets, span)
            left, has_left, right, has_right = side_hashes(rolling, anchor, first, last, span)
            reach = (span - GRAM) // 2
            known = batch.column("known")
            flat, counts = known.flatten(), known.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(counts)), counts)
            a, b, shows = flat.field(0).to_numpy(), flat.field(1).to_numpy(), flat.field(2).to_numpy(zero_copy_only=False)
            half = (b == 1) | (b == 2)
            pair = lambda t, h: mix64(h.view(np.uint64)) ^ (t.astype(np.uint64) * np.uint64(_BASE))
            wanted = pair(owner[half], a[half])
            from_left, from_right = has_left & np.isin(pair(text, left), wanted), has_right & np.isin(pair(text, right), wanted)
            repeated = {(t, x, y): z for t, x, y, z in zip(owner.tolist(), a.tolist(), b.tolist(), shows.tolist(), strict=True)}
            whole = data.tobytes()
            copies, k1, k2 = (batch.column(c).to_pylist() for c in ("copies", "k1", "k2"))
            base = offsets.tolist()
            settled: dict[int, list[tuple[int, int]]] = {}
            rows = []
            chosen = np.flatnonzero(from_left | from_right)
            for i, t, at, lo, hi, on_left, on_right in zip(chosen, *(x[chosen].tolist() for x in (text, anchor, first, last, from_left, from_right)), strict=False):
                name = (t, *np.frombuffer(_digest(whole[lo : hi + span]), "<i8").tolist())
                shown = repeated.get(name)
                if shown is not None:
                    if copies[t] == 1:
                        settled.setdefault(t, []).append((lo - base[t], hi + span - base[t]))
                    if not shown:
                        continue
                    repeated[name] = False
                elif not on_right:
                    hi = min(hi, at - reach)
                elif not on_left:
                    lo = max(lo, at - reach + 1)
                rows.append((_digest(whole[at : at + GRAM]), k1[t], k2[t], lo - base[t], at - lo, GRAM, shown is not None or copies[t] > 1, whole[lo : hi + span], None))
            rows += [(None, k1[t], k2[t], None, None, None, None, None, [{"lo": x, "hi": y} for x, y in merge(sorted(found))]) for t, found in settled.items()]
            yield _arrow(rows, f"{LEVEL}, ranges {RANGES}")

    return run


def _split(span: int):
    """Contexts of a large group, as two smaller ones each: windows that reach half of what lacks to a window, or more, to the left of the common core, and the others.

    The windows of either have a longer core in common, by which they are grouped anew; each window is in one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "context", SLICE):
            rows = []
            for k1, k2, first, core, width, multiple, context in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k1", "k2", "first", "core", "width", "multiple", "context")), strict=True):
                more = span - width
                half, last = -(-more // 2), len(context) - span
                for lo, hi, start, size in ((0, min(last, core - half), core - half, width + half), (max(0, core - half + 1), last, core, width + more - half + 1)):
                    if lo <= hi:
                        rows.append((_digest(context[start : start + size]), k1, k2, first + lo, start - lo, size, multiple, context[lo : hi + span]))
            yield _arrow(rows, LEVEL)

    return run


def share(data: np.ndarray, a: np.ndarray, b: np.ndarray, span: int) -> np.ndarray:
    """Whether the suffixes at a[i] and b[i] have their first span bytes in common; eight bytes at a time while they agree."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view("<u8").ravel()
    left = np.arange(len(a))
    for at in (*range(0, span - 7, 8), span - 8):
        left = left[words[a[left] + at] == words[b[left] + at]]
    out = np.zeros(len(a), bool)
    out[left] = True
    return out


def phrase_edges(rolling: Rolling, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges that the PHRASE_GRAM bytes before them make, all edges) of concatenated contexts, at which they are cut into phrases.

    Whether a place is an edge depends on bytes before it alone: on the gram that ends there, and, where LONGEST bytes have no such
    edge, every place is one. So equal stretches are cut alike from the first edge on that their own bytes make, up to their end.
    """
    n = int(offsets[-1])
    start = np.repeat(offsets[:-1], np.diff(offsets))
    place = np.arange(n)
    made = np.zeros(n, bool)
    grams = rolling.all(PHRASE_GRAM)
    made[PHRASE_GRAM:] = (grams[: n - PHRASE_GRAM] & np.uint64(7)) == 0
    made &= place - start >= PHRASE_GRAM
    before = np.maximum.accumulate(np.where(made, place, -1))
    every = made | ((place - before >= LONGEST) & (place - start >= LONGEST + PHRASE_GRAM))
    every[offsets[:-1]] = True
    return np.flatnonzero(made), np.flatnonzero(every)


def repeated_windows(contexts: list[bytes], span: int) -> np.ndarray:
    """Which places of the concatenated contexts begin a window (of span bytes, within its context) that begins elsewhere too.

    The suffixes that begin at phrase edges are sorted, phrases by their bytes. A window is a head, up to an edge that its bytes
    make, and the beginning of the suffix at that edge. Of windows with one head, equal ones have equal phrases and a common beginning
    of the phrase in which they end, so they are neighbours in the order of their suffixes: those are marked that have span bytes
    in common with a neighbour, by comparing the bytes.
    """
    whole = b"".join(contexts)
    data = np.frombuffer(whole, np.uint8)
    lengths = np.array([len(c) for c in contexts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    out = np.zeros(len(data), bool)
    starts = np.flatnonzero(inner_ranges(lengths) + span <= np.repeat(lengths, lengths))
    if len(starts) < 2:
        return out
    rolling = Rolling(data)
    made, edges = phrase_edges(rolling, offsets)
    bounds = [*edges.tolist(), len(data)]
    phrases = [whole[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    rank = {x: k for k, x in enumerate(sorted(set(phrases)))}
    order = suffix_array([rank[x] for x in phrases])
    place = np.empty(len(edges), np.int64)
    place[np.array(order, np.int64)] = np.arange(len(edges))
    latest = starts + LONGEST + PHRASE_GRAM
    first = np.append(made, len(data))[np.searchsorted(made, starts + PHRASE_GRAM)]
    edge = np.minimum(first, latest)
    head = rolling.at(starts, edge - starts) + (edge - starts).astype(np.uint64)
    sorted_by = np.lexsort((place[np.searchsorted(edges, edge)], head))
    starts = starts[sorted_by]
    same = share(data, starts[:-1], starts[1:], span)
    out[starts[:-1][same]] = True
    out[starts[1:][same]] = True
    return out


def _ranges(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the runs of true values."""
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _judge(span: int):
    """Repeated windows of whole groups of contexts, which come sorted by key, as byte ranges of their texts."""
    kinds = f"k1 long, k2 long, ranges {RANGES}"

    def judged(held: list[tuple]) -> pa.RecordBatch:
        marked = repeated_windows([x[-1] for x in held], span)
        rows, start = [], 0
        for _, k1, k2, first, multiple, context in held:
            if not multiple:
                found = [{"lo": first + int(a), "hi": first + int(b) + span} for a, b in zip(*_ranges(marked[start : start + len(context)]), strict=True)]
                if found:
                    rows.append((k1, k2, found))
            start += len(context)
        return _arrow(rows, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "k1", "k2", "first", "multiple", "context")), strict=True):
                if group and row[0] != group[0][0]:
                    if len(group) > 1 and not all(x[4] for x in group):
                        held += group
                        size += sum(len(x[5]) for x in group)
                    group = []
                    if size >= ARRAY_BYTES:
                        yield judged(held)
                        held, size = [], 0
                group.append(row)
        if len(group) > 1 and not all(x[4] for x in group):
            held += group
        if held:
            yield judged(held)

    return run


def repeated_ranges(documents: DataFrame, span: int = 400) -> tuple[DataFrame, DataFrame]:
    """((k1, k2, ranges), (k1, k2, copies)): for each text the byte ranges covered by strings of span bytes that stand elsewhere too; the texts of several rows.

    1. Every window of span bytes is anchored at its 32-byte gram of least hash; runs of windows with one anchor share a context.
       Two half-windows about the anchor and the whole context are named and counted. A window can only repeat if one of its
       halves does; a context that stands twice is repeated as a whole. The most frequent names, HOT_KEYS at most, go to all
       tasks; of the others none is frequent, and a join brings them back to their texts.
    2. Other contexts with a repeated half are gathered by their anchor's gram, with one of each repeated context as a witness.
       Groups of more than GROUP contexts are split by longer common cores until they are small, or one window is left.
    3. A suffix array over the phrases of each group's contexts has equal windows as neighbours.
    Text copies are one text with a count. No step holds more of a group in one task than GROUP contexts.
    """
    if span < 128:
        raise ValueError("span must be 128 bytes at least")
    small_batches(documents)
    rows = documents.select(*text_key("text"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= span)
    names = rows.mapInArrow(_names(span), "k1 long, k2 long, names array<struct<a:long,b:long>>")
    texts = materialise(names.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("names").alias("names")), "names")
    n_texts = texts.count()
    each = texts.select("k1", F.explode("names").alias("name")).select("k1", "name.*")
    often = materialise(each.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("k1").alias("shown")).where("n > 1"), "often")
    total = texts.agg(F.coalesce(F.sum(F.size("names")), F.lit(0))).first()[0]
    least = max(HOT_LEAST, -(-total // HOT_KEYS))  # no more than HOT_KEYS names can be that frequent
    hot = often.where(F.col("n") >= least).select("a", "b", "shown").toPandas().sort_values(["a", "b"])
    both = texts.mapInArrow(_split_names(*(hot[c].to_numpy(np.int64) for c in ("a", "b", "shown"))), f"k1 long, k2 long, copies long, hot {KNOWN}, cold array<struct<a:long,b:long>>")
    both = materialise(both, "split")
    cold = both.select("k1", "k2", "copies", F.explode("cold").alias("name")).select("k1", "k2", "copies", "name.*").join(often.where(F.col("n") < least).select("a", "b", "shown"), ["a", "b"])
    cold = cold.groupBy("k1", "k2", "copies").agg(F.collect_list(F.struct("a", "b", (F.col("k1") == F.col("shown")).alias("first"))).alias("known"))
    known = both.where(F.size("hot") > 0).select("k1", "k2", "copies", F.col("hot").alias("known")).union(cold)
    known = materialise(known.groupBy("k1", "k2", "copies").agg(F.flatten(F.collect_list("known")).alias("known")), "known", n_texts)
    # One row of each text; texts without a repeated half stay out of the shuffle while the others' keys are few enough to broadcast.
    some = rows.join(F.broadcast(known.select("k1", "k2")), ["k1", "k2"], "left_semi") if fits(known, 24) else rows
    chosen = some.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(known.hint("shuffle_merge"), ["k1", "k2"])
    found = materialise(chosen.mapInArrow(_contexts(span), f"{LEVEL}, ranges {RANGES}"), "contexts")
    parts = found.where("ranges IS NOT NULL").select("k1", "k2", "ranges")
    level = found.where("context IS NOT NULL").drop("ranges")
    small = []
    while True:
        n = level.count()
        large = materialise(level.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("key"), "large", n // GROUP)
        if large.isEmpty():
            break
        large = sized(large, 40)
        small.append(level.join(large, "key", "left_anti").select(level.columns))
        crowded = level.join(large, "key", "left_semi").select(level.columns)
        # A core as long as a window is the window: it stands as often as the group has contexts.
        one = F.array(F.struct(F.col("first").alias("lo"), (F.col("first") + span).alias("hi")))
        parts = parts.union(crowded.where((F.col("width") >= span) & ~F.col("multiple")).select("k1", "k2", one.alias("ranges")))
        level = materialise(crowded.where(F.col("width") < span).mapInArrow(_split(span), LEVEL), "level")
    # Groups of different rounds have cores of different bytes, so different keys; all are judged in one pass.
    whole = reduce(DataFrame.union, small, level)
    parts = parts.union(whole.repartition("key").sortWithinPartitions("key").mapInArrow(_judge(span), f"k1 long, k2 long, ranges {RANGES}"))
    several = texts.where("copies > 1").select("k1", "k2", "copies")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(1 << 62).alias("hi")))
    gathered = parts.groupBy("k1", "k2").agg(F.sort_array(F.flatten(F.collect_list("ranges"))).alias("ranges"))
    merged = gathered.mapInArrow(_merged, f"k1 long, k2 long, ranges {RANGES}")
    merged = merged.join(sized(several.select("k1", "k2"), 24), ["k1", "k2"], "left_anti")
    return materialise(merged.union(several.select("k1", "k2", everything.alias("ranges"))), "ranges", n_texts), several


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges with those that overlap or touch joined."""
    out: list[tuple[int, int]] = []
    for lo, hi in ranges:
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    for batch in batches:
        lists = [[{"lo": a, "hi": b} for a, b in merge([(x["lo"], x["hi"]) for x in ranges])] for ranges in batch.column("ranges").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(lists, kind)], ["k1", "k2", "ranges"])


def cut(text: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """(the bytes outside the ranges, the number of maximal runs inside)."""
    kept, runs, at = [], 0, 0
    end = -1
    for lo, hi in ranges:
        hi = min(hi, len(text))
        if lo > end or end < 0:
            runs += 1
        if lo > at:
            kept.append(text[at:lo])
        at, end = max(at, hi), max(end, hi)
    kept.append(text[at:])
    return b"".join(kept), runs


def _removed(digests: bool, names: list[str], ranges_name: str, gone_name: str = "removed"):
    """Rows with text and ranges, as digests of what remains or as the columns names with text cut and the number of bytes removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            column = batch.column(batch.schema.get_field_index("text"))
            data, offsets = utf8(column)
            whole = data.tobytes()
            texts, hashes, removed, runs = [], [], [], []
            for a, b, ranges in zip(offsets[:-1], offsets[1:], batch.column(batch.schema.get_field_index(ranges_name)).to_pylist(), strict=True):
                kept, n = cut(whole[a:b], [(x["lo"], x["hi"]) for x in ranges]) if ranges else (whole[a:b], 0)
                texts.append(kept.decode("utf-8", "ignore") if digests or n else None)
                if digests:
                    hashes.append(hashlib.sha256(kept).hexdigest())
                removed.append(int(b - a) - len(kept))
                runs.append(n)
            gone = pa.array(removed, pa.int64())
            if digests:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), gone, pa.array(runs, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])
            else:
                new = pc.if_else(pc.greater(gone, 0), pa.array(texts, column.type), column)
                yield pa.RecordBatch.from_arrays([*(new if c == "text" else batch.column(i) for i, c in enumerate(names)), gone], [*names, gone_name])

    return run


def _with_ranges(documents: DataFrame, columns: list[Column], span: int) -> tuple[DataFrame, str]:
    """The columns and each row's ranges, and the name of the latter.

    Few ranges are broadcast. Else both sides are shuffled by text, but for the rows of texts that stand too often to go to one task: a
    table of HOT_KEYS texts at most says which these are, and they go wholly, so nothing is looked up for them.
    """
    ranges, several = repeated_ranges(documents, span)
    k1, k2, name, often = fresh([c for c in documents.columns], "k1", "k2", "ranges", "often")
    ranges = ranges.withColumnsRenamed({"k1": k1, "k2": k2, "ranges": name})
    keys = [x.alias(n) for x, n in zip(text_key("text"), (k1, k2), strict=True)]
    rows = documents.select(*columns, *keys)
    if fits(ranges, 160):
        return rows.join(F.broadcast(ranges), [k1, k2], "left").drop(k1, k2), name
    least = max(HOT_LEAST, -(-several.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] // HOT_KEYS))  # none stands twice after near duplicates
    frequent = several.where(F.col("copies") >= least).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.lit(True).alias(often))
    rows = rows.join(F.broadcast(frequent), [k1, k2], "left")
    spread = rows.withColumn(k1, F.when(F.col(often), F.xxhash64("doc_id")).otherwise(F.col(k1)))
    everything = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.lit(1 << 62).alias("hi")))
    ranges = ranges.join(F.broadcast(frequent), [k1, k2], "left_anti")
    joined = spread.join(ranges, [k1, k2], "left")
    return joined.withColumn(name, F.when(F.col(often), everything).otherwise(F.col(name))).drop(k1, k2, often), name


def removal_digests(documents: DataFrame, span: int = 400) -> DataFrame:
    """For every document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the remaining bytes, and these as text.

    Each byte goes that is covered by a string of span bytes which also starts anywhere else, in the same document or
    another; strings never cross documents and are judged on the input. A null text is empty; texts under span bytes stay whole;
    repeated rows are copies of each other, so texts of span bytes or more go wholly; an empty table gives an empty one. Texts
    are read whole, however long (up to 1 GiB); one longer than a slice is a slice of its own. Only doc_id and text are read.
    text is for reading: bytes of characters that were cut apart are left out of it, not of kept_sha256.
    """
    rows, name = _with_ranges(documents.select("doc_id", "text"), [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")], span)
    return rows.mapInArrow(_removed(True, [], name), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def drop_repeated(documents: DataFrame, span: int = 400, drop_empty: bool = True) -> DataFrame:
    """The documents with the repeated bytes removed from text, all other columns unchanged; those that lose all are dropped.

    A character of which only some bytes are covered goes as a whole. A text without repeated bytes stays as it is, null included.
    Repeated rows are copies, as in removal_digests(); an empty table gives an empty one.
    """
    names = documents.columns
    rows, name = _with_ranges(documents, [F.col(f"`{c}`") for c in names], span)
    (gone,) = fresh(names, "removed")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    rows = rows.select(*(F.col(f"`{c}`") for c in names), name).mapInArrow(_removed(False, names, name, gone), f"{kinds}, `{gone}` long")
    if drop_empty:
        rows = rows.where((F.col(gone) == 0) | (F.col("text") != ""))
    return rows.drop(gone)
