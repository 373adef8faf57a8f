"""Near-duplicate documents: an LSH forest over MinHash signatures proposes pairs, full shingle sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW_FILES, fresh, materialise, mix64, sized, slices, small_batches, text_key, utf8
from .components import connected_components
from .words import shingles

#: Hash functions of a signature, the trees over it, and the hashes that separate the first levels of two trees.
HASHES, TREES = 64, 16
STRIDE = HASHES // TREES
#: Levels of a tree: two of 32 bits, four of 16.
LEVELS = 6
#: A region of a tree this small has all its pairs proposed; larger ones are split one level deeper.
REGION = 8
#: In regions that no level splits, and between regions, so many next neighbours in the order are proposed.
NEIGHBOURS = 3
#: Pairs whose signatures agree in a share that is by more than this under the threshold are not looked at: four standard deviations or more.
MARGIN = 0.2
#: Nodes that fewer trees than this hold in a small first-level region are crowded: the exact join looks for their links too.
SAFE_TREES = 10
#: The exact join orders shingles by their frequency in a sample of about so many crowded nodes. The order decides its cost, not its result.
SAMPLE, FREQUENT = 10_000, 500_000
#: Rows of one shingle that meet in a task of the exact join.
TOGETHER = 1024
#: So many texts are gathered by few tasks.
FEW_TEXTS = 50_000
#: The exact join's pairs are confirmed in rounds: so many a node in the first, four times as many in each next one, until none is left.
FIRST_ROUND = 16

_RANDOM = np.random.Generator(np.random.PCG64(3))
_FACTORS = _RANDOM.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending, as one array with offsets."""
    hashes, owner = shingles(data, offsets, size)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.searchsorted(owner[fresh], np.arange(len(offsets)))


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash signatures (uint32) of non-empty sets that begin at starts."""
    out = np.empty((len(starts), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(((hashes * _FACTORS[k] + _SHIFTS[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, at = shingle_sets(*utf8(batch.column("text")), size)
            counts = np.diff(at)
            some = counts > 0
            nodes, signed = [None] * len(counts), [None] * len(counts)
            if some.any():
                starts = at[:-1][some]
                first, second = (np.add.reduceat(mix64(hashes ^ np.uint64(c)), starts) + counts[some].astype(np.uint64) for c in (0, 0xA5A5A5A55A5A5A5A))
                names = np.column_stack([first, second]).astype("<u8")
                for i, name, signature in zip(np.flatnonzero(some), names, signatures(hashes, starts).astype("<u4"), strict=True):
                    nodes[i], signed[i] = name.tobytes(), signature.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(signed, pa.binary())], ["doc_id", "k1", "k2", "n_shingles", "node", "signature"])

    return run


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node and tree: the tree's own order of the signature as two sortable integers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(batch.num_rows, HASHES).astype(np.uint64)
        for tree in range(TREES):
            level = [signature[:, (STRIDE * tree + k) % HASHES] for k in range(LEVELS)]
            high = (level[0] << np.uint64(32)) | level[1]
            low = np.zeros(len(high), np.uint64)
            for k in range(2, LEVELS):
                low = (low << np.uint64(16)) | (level[k] & np.uint64(0xFFFF))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(high), tree, np.int32)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), batch.column("node")], ["tree", "high", "low", "node"])


def common_levels(tree: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each row of a sorted tree, how many levels it has in common with the row before."""
    out = np.zeros(len(tree), np.int64)
    if len(tree) > 1:
        same = tree[1:] == tree[:-1]
        h, w = (high[1:] ^ high[:-1]).view(np.uint64), (low[1:] ^ low[:-1]).view(np.uint64)
        for k in range(LEVELS):
            shift = np.uint64(32 - 32 * k) if k < 2 else np.uint64(16 * (LEVELS - 1 - k))
            same &= ((h if k < 2 else w) >> shift) == 0
            out[1:] += same
    return out


def propose(tree: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers: all within regions of at most REGION rows, at the depth where a region is that small, and next neighbours."""
    n, common = len(tree), common_levels(tree, high, low)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    open_rows = np.ones(n, bool)  # rows whose regions are still too large
    for depth in range(1, LEVELS + 1):
        region = np.cumsum(common < depth) - 1
        small = np.bincount(region, minlength=1)[region] <= REGION
        for step in range(1, REGION):
            take = np.flatnonzero((region[step:] == region[:-step]) & small[step:] & open_rows[step:]) if n > step else np.zeros(0, np.int64)
            if not len(take):
                break
            pairs.append((take, take + step))
        open_rows &= ~small
    for step in range(1, NEIGHBOURS + 1):
        if n > step:
            take = np.flatnonzero(open_rows[step:] & (region[step:] == region[:-step]))
            pairs.append((take, take + step))
    near = np.flatnonzero((common[1:] >= 1)) if n > 1 else np.zeros(0, np.int64)
    pairs.append((near, near + 1))
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def crowded_rows(tree: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether each row of a sorted stretch is in a first-level region of more than REGION rows, or in one that may go on in another stretch."""
    region = np.cumsum(common_levels(tree, high, low) < 1) - 1
    return (np.bincount(region)[region] > REGION) | (region == 0) | (region == region[-1])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proposed pairs of a sorted stretch of the forest, its first and last rows for the seams to the next stretches, and for its crowded nodes the number of their rows."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    table = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return
    tree, high, low = (table.column(c).to_numpy() for c in ("tree", "high", "low"))
    nodes = np.array(table.column("node").to_pylist(), dtype=object)
    a, b = propose(tree, high, low)
    seen = set()
    left, right = [], []
    for x, y in zip(nodes[a], nodes[b], strict=True):
        pair = (x, y) if x < y else (y, x)
        if x != y and pair not in seen:
            seen.add(pair)
            left.append(pair[0])
            right.append(pair[1])
    n, seam = len(nodes), 2 * NEIGHBOURS
    edge = [(part - 1, i) for i in range(min(seam, n))] + [(part, i) for i in range(max(0, n - seam), n)]
    at = [i for _, i in edge]
    crowded, times = np.unique(nodes[crowded_rows(tree, high, low)], return_counts=True)
    kinds = {"a": pa.binary(), "b": pa.binary(), "seam": pa.int64(), "tree": pa.int32(), "high": pa.int64(), "low": pa.int64(), "node": pa.binary(), "crowded": pa.int64()}
    parts = [{"a": left, "b": right}, {"seam": [x for x, _ in edge], **{c: [x[i].item() for i in at] for c, x in (("tree", tree), ("high", high), ("low", low))}, "node": list(nodes[at])}, {"node": list(crowded), "crowded": times.tolist()}]
    for part_rows in parts:
        size = len(next(iter(part_rows.values())))
        yield pa.RecordBatch.from_arrays([pa.array(part_rows.get(c, [None] * size), kind) for c, kind in kinds.items()], list(kinds))


def _seam(rows):
    import pandas as pd

    rows = rows.sort_values(["tree", "high", "low", "node"]).drop_duplicates()
    a, b = propose(*(rows[c].to_numpy(np.int64) for c in ("tree", "high", "low")))
    nodes = rows["node"].map(bytes).to_numpy(object)
    pairs = {(min(x, y), max(x, y)) for x, y in zip(nodes[a], nodes[b], strict=True) if x != y}
    return pd.DataFrame(sorted(pairs), columns=["a", "b"])


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, HASHES) for c in ("sketch_a", "sketch_b"))
                yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(1) >= percent / 100 - MARGIN))

    return run


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "text_a", 1 << 20), "text_b", 1 << 20):
            sets = [shingle_sets(*utf8(batch.column(c)), size) for c in ("text_a", "text_b")]
            linked = []
            for i in range(batch.num_rows):
                x, y = (hashes[at[i] : at[i + 1]] for hashes, at in sets)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    return run


def _first_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(batch.num_rows, HASHES)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in (signature & np.uint32(0xFF)).astype(np.uint8)], pa.binary())], ["node", "sketch"])


def _sampled(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(*utf8(batch.column("text")), size)[0].view(np.int64))], ["shingle"])

    return run


def prefixes(hashes: np.ndarray, at: np.ndarray, percent: int, frequent: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle, how many shingles of the set are left from it on) of each set's rarest shingles.

    All sets have their shingles in one order, rare ones first. If two sets are linked, the first shingle in this order that
    both have leaves at least their common number of shingles in either, so it is among these rows of both.
    """
    counts = np.diff(at)
    owner = np.repeat(np.arange(len(counts)), counts)
    seen = np.zeros(len(hashes), np.int64)
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        seen = np.where(frequent[place] == hashes, times[place], 0)
    order = np.lexsort((hashes, seen, owner))
    left = at[1:][owner] - np.arange(len(hashes))
    take = 100 * left >= percent * counts[owner]
    return owner[take], hashes[order][take], left[take]


def _prefix_rows(size: int, percent: int, frequent: np.ndarray, times: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, at = shingle_sets(*utf8(batch.column("text")), size)
            owner, shingle, left = prefixes(hashes, at, percent, frequent, times)
            yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), batch.column("node").take(pa.array(owner)), pa.array(np.diff(at)[owner].astype(np.int32)), pa.array(left.astype(np.int32))], ["shingle", "node", "n", "left"])

    return run


def _texts(rows: DataFrame, nodes: DataFrame, wanted: DataFrame, rows_wanted: int | None = None) -> DataFrame:
    """node, text: a text of each wanted node; rows_wanted bounds their number, where a bound is known."""
    wanted = materialise(wanted.join(nodes, "node").select("node", F.col("key.k1").alias("k1"), F.col("key.k2").alias("k2")), "wanted", rows_wanted)
    texts = rows.select("k1", "k2", "text").join(sized(wanted, 100), ["k1", "k2"]).groupBy("node").agg(F.first("text").alias("text"))
    return materialise(texts.coalesce(FEW_FILES) if wanted.count() <= FEW_TEXTS else texts, "texts")


def _exact_pairs(texts: DataFrame, labels: DataFrame, size: int, percent: int) -> DataFrame:
    """Every pair (a, b) of the nodes of texts, of different components, that may be linked; best bounds their common shingles."""
    sample = texts.where(F.pmod(F.xxhash64("node"), F.lit(max(1, texts.count() // SAMPLE))) == 0).select("text")
    often = sample.mapInArrow(_sampled(size), "shingle long").groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
    often = often.orderBy(F.desc("times"), "shingle").limit(FREQUENT).toPandas()
    frequent = often["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(frequent)
    places = materialise(texts.mapInArrow(_prefix_rows(size, percent, frequent[order], often["times"].to_numpy(np.int64)[order]), "shingle long, node binary, n int, left int"), "prefixes")
    of = texts.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    sizes = of.groupBy("component").agg(F.count("*").alias("members"))
    of = materialise(of.join(sizes, "component").select("node", F.xxhash64("component").alias("of"), "members"), "components", texts.count(), True)
    places = places.join(sized(of, 80), "node")
    # Within a component nothing is left to find; of each shingle's rows only those outside its largest component meet all others.
    shared = places.groupBy("shingle").agg(F.min("of").alias("least"), F.max("of").alias("most"), F.max(F.struct("members", "of"))["of"].alias("main"), F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    shared = materialise(shared.where("least <> most").select("shingle", "main", "parts"), "shared")
    places = materialise(places.drop("members").join(sized(shared, 48), "shingle"), "places")
    light = places.where("of <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    light = light.select("shingle", "part", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"), F.col("of").alias("of_a"))
    every = places.select("shingle", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.col("node").alias("b"), "n", "left", "of", (F.col("of") == F.col("main")).alias("in_main"))
    common = F.least("left_a", "left").cast("long")
    fits = (F.col("of_a") != F.col("of")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & (common * (100 + percent) >= (F.col("n_a") + F.col("n")).cast("long") * percent)
    return materialise(light.join(every, ["shingle", "part"]).where(fits).groupBy("a", "b").agg(F.max(common).alias("best")), "exact")


def _confirmed(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, sketch: DataFrame, size: int, percent: int, most: int | None = None) -> DataFrame:
    """The pairs (a, b) of nodes that are linked: sifted by their signatures, then decided on the full sets of a text of each. most bounds the pairs, where a bound is known."""
    for side in "ab":
        pairs = pairs.join(sketch.withColumnsRenamed({"node": side, "sketch": f"sketch_{side}"}), side)
    likely = materialise(pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_likely(percent), "a binary, b binary"), "likely", most, True)
    most = likely.count()
    texts = _texts(rows, nodes, likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct(), 2 * most)
    for side in "ab":
        likely = likely.join(texts.withColumnsRenamed({"node": side, "text": f"text_{side}"}), side)
    return materialise(likely.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(size, percent), "a binary, b binary"), "links", most)


def _linked(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, k1, k2 (the text's key), n_shingles, node and component_id of every row."""
    spark = small_batches(documents)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key("text"), F.col("text").cast("string").alias("text"))
    sketched = materialise(rows.mapInArrow(_sketch(size), "doc_id long, k1 long, k2 long, n_shingles long, node binary, signature binary"), "sketches")
    # Equal sets are one node; its text is any of theirs, so the least key.
    nodes = sketched.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("k1", "k2")).alias("key"), F.first("signature").alias("signature"))
    nodes = materialise(nodes, "nodes", sketched.count(), True)
    n_nodes = nodes.count()
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_nodes * TREES // 400_000)
    forest = nodes.select("node", "signature").mapInArrow(_tree_rows, "tree int, high long, low long, node binary")
    forest = forest.repartitionByRange(many, "tree", "high", "low", "node").sortWithinPartitions("tree", "high", "low", "node")
    proposed = materialise(forest.mapInArrow(_candidates, "a binary, b binary, seam long, tree int, high long, low long, node binary, crowded long"), "candidates")
    seams = proposed.where("seam IS NOT NULL").select("seam", "tree", "high", "low", "node").groupBy("seam").applyInPandas(lambda x: _seam(x.drop(columns="seam")), "a binary, b binary")
    pairs = proposed.where("a IS NOT NULL").select("a", "b").union(seams).distinct()
    sketch = nodes.select("node", "signature").mapInArrow(_first_bytes, "node binary, sketch binary")
    links = _confirmed(rows, nodes, pairs, sketch, size, percent)
    labels = connected_components(links, links.count())
    # What crowded regions hide from the forest: a join that misses no link of the nodes in them.
    crowded = proposed.where("crowded IS NOT NULL").groupBy("node").agg(F.sum("crowded").alias("crowded")).where(F.col("crowded") > TREES - SAFE_TREES).select("node")
    crowded = materialise(crowded, "crowded", n_nodes, True)
    if not crowded.isEmpty():
        untried, most = _exact_pairs(_texts(rows, nodes, crowded, crowded.count()), labels, size, percent), FIRST_ROUND
        while left := untried.count():
            ranked = materialise(untried.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("best"), "b"))), "ranked", left, True)
            new = _confirmed(rows, nodes, ranked.where(F.col("rank") <= most).select("a", "b"), sketch, size, percent, left)
            if found := new.count():
                labels = connected_components(new.union(labels.select(F.col("component").alias("a"), F.col("node").alias("b"))), found + labels.count())
            untried = ranked.where(F.col("rank") > most).drop("rank")
            for side in "ab":
                untried = untried.join(labels.withColumnsRenamed({"node": side, "component": f"of_{side}"}), side, "left")
            apart = F.coalesce("of_a", "a") != F.coalesce("of_b", "b")
            untried, most = materialise(untried.where(apart).select("a", "b", "best"), "untried", left, True), 4 * most
    joined = nodes.select("node", "doc_id").join(labels, "node")
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = joined.join(least, "component").select("node", "component_id")
    final = nodes.select("node", "doc_id").join(linked, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    return sketched.drop("signature").join(final, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 85) -> DataFrame:
    """For every document: doc_id, n_shingles, component_id, kept.

    Two documents are linked if percent or more of 100 of their joint distinct shingles (size words) are common to both.
    Texts with the same shingle set are one node from the start, so a group of copies costs one row however large.
    Each of the forest's trees holds the nodes sorted by its own order of the MinHash signature, dealt out by ranges
    of that order, so that a crowded region spreads over tasks. Neighbours by longest common prefix are proposed: all pairs
    of a region of few nodes, at whatever depth it becomes that small, and next neighbours where even the deepest level is
    crowded. Signatures sift the pairs, full sets confirm the links, and components follow by contraction. Nodes that crowded
    regions hold in most trees are then joined on their rarest shingles, which leaves out no pair that can be linked; those pairs that
    are still of different components are tried, in rounds, until none is left.

    A null or empty text, or one of separators only, has no shingles and is linked with nothing. component_id is the
    least doc_id of the component; null ids don't count, and where all are null it is null and kept is true. Repeated
    rows are copies of each other and all carry their doc_id's verdict. Only doc_id and text are read.
    """
    found = _linked(documents, size, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def drop_near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all their columns unchanged, without those that near_duplicates() doesn't keep.

    Rows repeated with the same doc_id and text stay once; rows without a doc_id stay unless a row with one is in their component.
    """
    found = _linked(documents, size, percent)
    key = fresh(documents.columns, "id", "k1", "k2")
    names = dict(zip(["doc_id", "k1", "k2"], key, strict=True))
    fates = found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())).groupBy("doc_id", "k1", "k2").agg(F.min("kept").alias("kept"), F.count("*").alias("copies"))
    fates = materialise(fates.where("NOT kept OR copies > 1").select(*(F.col(c).alias(n) for c, n in names.items()), "kept"), "fates")
    rows = documents.withColumns(dict(zip(key, (F.col("doc_id").cast("long"), *text_key("text")), strict=True)))

    def same(other: DataFrame):
        return reduce(and_, (rows[c].eqNullSafe(other[c]) for c in key))

    changed = sized(fates.select(*key), 48)
    out = rows.join(changed, same(changed), "left_anti")
    twins = fates.where("kept").select(*key)
    if not twins.isEmpty():
        twins = sized(twins, 48)
        out = out.union(rows.join(twins, same(twins), "left_semi").dropDuplicates(key))
    return out.drop(*key)
