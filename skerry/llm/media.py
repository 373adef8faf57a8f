"""Media columns: payloads cut by content, chunks stored once by digest, media rebuilt from ordered chunk lists and verified."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits, materialise, sized, slices, small_batches, text_key, utf8

#: Payloads are filled up with spaces to a positive multiple of so many bytes.
FRAME = 192
#: Sizes of chunks: least, most, and the bits of the rolling hash that are zero at a cut.
LEAST, MOST, CUT_BITS = 256, 4096, 10
RATE = 8000
#: Keys that are joined by broadcast, since they stand OFTEN or more: so many at most, and so many where their bytes are a chunk's.
FREQUENT, FREQUENT_CHUNKS, OFTEN = 50_000, 4096, 64

_GEAR = np.random.Generator(np.random.PCG64(5)).integers(0, 2**32, 256, dtype=np.uint32)
_MASK = np.uint32(((1 << CUT_BITS) - 1) << (32 - CUT_BITS))

CHUNK = pa.struct([("digest", pa.binary()), ("length", pa.int32())])
RECIPE = "array<struct<digest:binary,length:int,borrowed:boolean>>"


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = 2*h[i-1] + gear[data[i]] modulo 2^32, so the hash of the last 32 bytes; by doubling the window five times."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        further = h.copy()
        further[step:] += h[:-step] << np.uint32(step)
        h = further
    return h


def cuts(candidates: np.ndarray, size: int) -> list[int]:
    """The ends of the chunks of a payload: the first candidate at least LEAST bytes on, else MOST bytes on."""
    out, start, at = [], 0, 0
    while size - start > LEAST:
        at = int(np.searchsorted(candidates, start + LEAST))
        end = min(int(candidates[at]) if at < len(candidates) else size, start + MOST, size)
        out.append(end)
        start = end
    if start < size:
        out.append(size)
    return out


def payload_of(text: bytes) -> bytes:
    """The text's bytes with spaces after them up to a positive multiple of FRAME."""
    return text + b" " * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def chunked(texts: list[bytes]) -> list[list[bytes]]:
    """The payload of each text, cut."""
    payloads = [payload_of(t) for t in texts]
    data = np.frombuffer(b"".join(payloads), np.uint8)
    ends = np.flatnonzero((gear_hashes(data) & _MASK) == 0) + 1
    out, base = [], 0
    for p in payloads:
        own = ends[np.searchsorted(ends, base, "right") : np.searchsorted(ends, base + len(p), "right")] - base
        edges = cuts(own, len(p))
        out.append([p[a:b] for a, b in zip([0, *edges], edges, strict=False)])
        base += len(p)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def wave_header(size: int) -> bytes:
    """The head of a RIFF file of 8-bit mono samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", size)


def read_wave(media: bytes) -> bytes:
    """The samples of such a file, its head checked."""
    size = len(media) - 44
    if media[:44] != wave_header(size):
        raise ValueError("a stored medium has a wrong head")
    return media[44:]


def feature(samples: bytes) -> str:
    """least:most:mean:root mean square about the middle:crossings of the mean, of 8-bit samples."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    mean = x.mean()
    above = x > mean
    return f"{x.min()}:{x.max()}:{mean:.4f}:{np.sqrt(np.square(x - 128).mean()):.4f}:{int((above[1:] != above[:-1]).sum())}"


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    data, at = utf8(batch.column("text"))
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        lists = [[{"digest": digest(c), "length": len(c)} for c in chunks] for chunks in chunked(_texts(batch))]
        yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "k1", "k2"]).columns, pa.array(lists, pa.list_(CHUNK))], ["doc_id", "k1", "k2", "chunks"])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the chunks that a medium owns, one after another, with its ordered chunk list."""
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("length", pa.int32()), ("borrowed", pa.bool_())]))
    for batch in slices(batches, "text"):
        texts = _texts(batch)
        owned, recipes = [], []
        for chunks, borrowed in zip(chunked(texts), batch.column("borrowed").to_pylist(), strict=True):
            away = set(borrowed or ())
            owned.append(b"".join(c for i, c in enumerate(chunks) if i not in away))
            recipes.append([{"digest": digest(c), "length": len(c), "borrowed": i in away} for i, c in enumerate(chunks)])
        sizes = [len(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [*batch.select(["doc_id", "k1", "k2"]).columns, pa.array(sizes, pa.int64()), pa.array([wave_header(len(payload_of(t))) for t in texts], pa.binary()), pa.array(recipes, kind), pa.array(owned, pa.binary()), pa.array([any(c["borrowed"] for c in r) for r in recipes])],
            ["doc_id", "k1", "k2", "n_bytes", "head", "recipe", "owned", "partly"],
        )


def _lent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, chunks = [], []
        for recipe, owned, wanted in zip(*(batch.column(c).to_pylist() for c in ("recipe", "owned", "wanted")), strict=True):
            at, wanted = 0, set(wanted)
            for c in recipe:
                if not c["borrowed"]:
                    if c["digest"] in wanted:
                        wanted.discard(c["digest"])
                        digests.append(c["digest"])
                        chunks.append(owned[at : at + c["length"]])
                    at += c["length"]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(chunks, pa.binary())], ["digest", "chunk"])


RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def rebuild(head: bytes, recipe: list[dict], owned: bytes, fetched: dict[bytes, bytes]) -> bytes:
    """A stored medium from its chunk list; every chunk must have the digest that the list has for it."""
    parts, at = [head], 0
    for c in recipe:
        if c["borrowed"]:
            chunk = fetched[c["digest"]]
        else:
            chunk = owned[at : at + c["length"]]
            at += c["length"]
        if digest(chunk) != c["digest"]:
            raise ValueError("a stored chunk doesn't have its digest")
        parts.append(chunk)
    return b"".join(parts)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in RESULT.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in RESULT.split(", ")]
    for batch in slices(batches, "owned"):
        out: list[tuple] = []
        fetched = batch.column("fetched").to_pylist() if "fetched" in batch.schema.names else [None] * batch.num_rows
        for n_bytes, head, recipe, owned, got in zip(*(batch.column(c).to_pylist() for c in ("n_bytes", "head", "recipe", "owned")), fetched, strict=True):
            media = rebuild(head, recipe, owned, {x["digest"]: x["chunk"] for x in got or ()})
            payload = read_wave(media)
            out.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        columns = [pa.array(list(x), kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], kind) for kind in kinds]
        yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "k1", "k2"]).columns, *columns], ["doc_id", "k1", "k2", *names])


def store(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write the media of all documents: (media, requests, copied rows).

    media: a row for each medium (equal texts are one), with the ordered list of its chunks and the bytes of those that it owns.
    Of equal chunks the one whose (text key, place) is least owns the bytes; requests (k1, k2, digest, o1, o2) tell who
    borrows what from whom. Only digests are shuffled to find that out; texts are read a second time to store them, joined
    with the lists of borrowed places, which go by broadcast while they are small and else by shuffle, a text once however many
    rows have it. copied rows: (doc_id, k1, k2, copies) of texts that occur in several rows.
    Digests and texts that stand too often to meet in one task are joined by broadcast; there are FREQUENT of them at most.
    """
    small_batches(documents)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key("text"), F.col("text").cast("string").alias("text"))
    listed = materialise(rows.mapInArrow(_digests, "doc_id long, k1 long, k2 long, chunks array<struct<digest:binary,length:int>>"), "digests")
    texts = materialise(listed.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("chunks").alias("chunks")), "texts")
    copies = texts.where("copies > 1").select("k1", "k2", "copies")
    places = texts.select("k1", "k2", F.posexplode("chunks").alias("place", "chunk")).select("k1", "k2", "place", F.col("chunk.digest").alias("digest"))
    owner = places.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("owner")).where("n > 1")
    owner = materialise(owner, "owners")
    borrowed = _frequent_first(places, owner, ["digest"], "n").drop("n").where(F.struct("k1", "k2", "place") != F.col("owner"))
    borrowed = materialise(borrowed, "borrowed")
    away = borrowed.groupBy("k1", "k2").agg(F.collect_list("place").alias("borrowed"))
    special = materialise(copies.join(away, ["k1", "k2"], "full").select("k1", "k2", F.coalesce("copies", F.lit(1)).alias("copies"), "borrowed"), "special")
    if fits(special, 120):
        known = rows.join(F.broadcast(special), ["k1", "k2"], "left")
        single = known.where(F.coalesce("copies", F.lit(1)) == 1).select("doc_id", "k1", "k2", "borrowed", "text")
        several = known.where("copies > 1").groupBy("k1", "k2").agg(F.first("borrowed").alias("borrowed"), F.first("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "k1", "k2", "borrowed", "text")
        each = single.union(several)
    else:
        one = rows.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))  # combined before the shuffle
        each = one.join(special, ["k1", "k2"], "left").select(F.when(F.coalesce("copies", F.lit(1)) == 1, F.col("doc_id")).alias("doc_id"), "k1", "k2", "borrowed", "text")
    schema = f"doc_id long, k1 long, k2 long, n_bytes long, head binary, recipe {RECIPE}, owned binary, partly boolean"
    media = materialise(each.mapInArrow(_store, schema), "media")
    requests = borrowed.select("k1", "k2", "digest", F.col("owner.k1").alias("o1"), F.col("owner.k2").alias("o2")).distinct()
    return media, requests, _frequent_first(listed.select("doc_id", "k1", "k2"), copies, ["k1", "k2"], "copies")


def _frequent_first(rows: DataFrame, table: DataFrame, keys: list[str], times: str) -> DataFrame:
    """The inner join of rows with a table that has each key once, with the number of rows that have it.

    Keys of so many rows that there can be FREQUENT of them at most are joined by broadcast, so that no task gets all rows of one; the
    others by shuffle. A table that fits is broadcast whole.
    """
    if fits(table, 100):
        return rows.join(F.broadcast(table), keys)
    least = max(OFTEN, -(-(table.agg(F.sum(times)).first()[0] or 0) // FREQUENT))
    often = F.broadcast(table.where(F.col(times) >= least))
    rest = rows.join(F.broadcast(table.where(F.col(times) >= least).select(*keys)), keys, "left_anti")
    return rows.join(often, keys).unionByName(rest.join(table.where(F.col(times) < least), keys))


def media_columns(documents: DataFrame) -> DataFrame:
    """Store the texts of all documents as 8-bit samples in chunks, read them back, and describe what was read.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes), media_bytes, media_sha256, feature.
    A payload is the text in UTF-8 (null: empty) with spaces up to a positive multiple of 192 bytes. Media that own all
    their chunks are read where they lie; only borrowed chunks are fetched by joins on their digests. A chunk that
    lost its digest raises an error. Equal texts give equal values; repeated rows are returned each; an empty table gives an empty one;
    a text is cut and stored whole, however long. Only doc_id and text are read.
    """
    media, requests, copied = store(documents)
    schema = f"doc_id long, k1 long, k2 long, {RESULT}"
    columns = ["doc_id", "k1", "k2", "n_bytes", "head", "recipe", "owned"]
    whole = media.where("NOT partly").select(*columns).mapInArrow(_read, schema)
    wanted = requests.select(F.col("o1").alias("k1"), F.col("o2").alias("k2"), "digest").distinct().groupBy("k1", "k2").agg(F.collect_list("digest").alias("wanted"))
    lent = media.select("k1", "k2", "recipe", "owned").join(sized(materialise(wanted, "wanted"), 120), ["k1", "k2"]).select("recipe", "owned", "wanted").mapInArrow(_lent, "digest binary, chunk binary")
    # Chunks of many borrowers, FREQUENT_CHUNKS of at most MOST bytes, go to all tasks; of the others none is in many requests.
    asked = materialise(requests, "requests")
    lent = materialise(lent.join(asked.groupBy("digest").agg(F.count("*").alias("n")), "digest"), "lent")
    least = max(OFTEN, -(-asked.count() // FREQUENT_CHUNKS))
    often, rest = lent.where(F.col("n") >= least).select("digest", "chunk"), lent.where(F.col("n") < least).select("digest", "chunk")
    cold = asked.join(F.broadcast(often.select("digest")), "digest", "left_anti").join(rest, "digest")
    brought = asked.join(F.broadcast(often), "digest").unionByName(cold)
    fetched = brought.groupBy("k1", "k2").agg(F.collect_list(F.struct("digest", "chunk")).alias("fetched"))
    partly = media.where("partly").join(fetched, ["k1", "k2"]).select(*columns, "fetched").mapInArrow(_read, schema)
    found = materialise(whole.union(partly), "found")
    several = found.where("doc_id IS NULL").drop("doc_id").join(copied.groupBy("k1", "k2").agg(F.first("copies").alias("copies")), ["k1", "k2"])
    # A row whose doc_id is null, but whose text is no copy, is in neither part of the join.
    single = found.join(sized(materialise(copied.select("k1", "k2").distinct(), "copied"), 24), ["k1", "k2"], "left_anti").select(*found.columns)
    return single.union(_frequent_first(copied.drop("copies"), several, ["k1", "k2"], "copies").select(*found.columns)).drop("k1", "k2")
