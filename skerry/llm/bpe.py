"""Byte-pair encoding with a pair occurrence index over the distinct words of a stretch of a partition, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, worker_cache

#: Characters whose normal form, lower case and class need the library's own tables.
UNUSUAL = "[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ſ]"
#: The vocabulary's word pattern, for lower-cased texts without unusual characters.
PLAIN_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\\sa-z0-9ß-öø-ſ]+"

#: The bytes, about, of the distinct words whose ids a worker keeps; beyond them it forgets all and begins anew.
KEPT_BYTES = 96 << 20
#: What a kept word takes besides its characters and its ids.
ENTRY_BYTES = 170


class PairIndex:
    """All words of a batch as one sequence of symbols, and for each pair of neighbours all the places where it stands."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        self.merges = merges  # pair -> (rank, merged symbol)

    def encode(self, words: Iterable[list[int]]) -> list[list[int]]:
        """The symbols of each word after all merges: active ranks in ascending order, places from left to right."""
        symbols: list[int] = []
        after: list[int] = []
        before: list[int] = []
        starts: list[int] = []
        for word in words:
            n = len(symbols)
            starts.append(n)
            symbols += word
            after += range(n + 1, n + len(word))
            after.append(-1)
            before.append(-1)
            before += range(n, n + len(word) - 1)
        merges, places = self.merges, {}
        for at, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)):
            if after[at] >= 0 and (a, b) in merges:
                places.setdefault((a, b), []).append(at)
        active = [(merges[pair][0], pair) for pair in places]
        heapq.heapify(active)
        while active:
            _, pair = heapq.heappop(active)
            a, b = pair
            merged = merges[pair][1]
            for at in sorted(places.pop(pair)):
                right = after[at]
                if right < 0 or symbols[at] != a or symbols[right] != b:
                    continue  # an earlier merge took one of the two
                symbols[at], symbols[right] = merged, -1
                after[at] = far = after[right]
                if far >= 0:
                    before[far] = at
                    if (new := (merged, symbols[far])) in merges:
                        if new not in places:
                            places[new] = []
                            heapq.heappush(active, (merges[new][0], new))
                        places[new].append(at)
                left = before[at]
                if left >= 0 and (new := (symbols[left], merged)) in merges:
                    if new not in places:
                        places[new] = []
                        heapq.heappush(active, (merges[new][0], new))
                    places[new].append(left)
        out = []
        for at in starts:
            word = []
            while at >= 0:
                word.append(symbols[at])
                at = after[at]
            out.append(word)
        return out


class Codec:
    """Encodes and decodes with a tokenizers file of the kind "BPE with word ends, lower case, white space dropped"."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocabulary: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"]["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges.setdefault((self.vocabulary[a], self.vocabulary[b]), (rank, self.vocabulary[a + b]))
        self.index = PairIndex(merges)
        self.strings = {i: s for s, i in self.vocabulary.items()} | {i: s for s, i in self.added.items()}
        self.shown = self._shown_bytes()
        self.unusual, self.plain_words = re.compile(UNUSUAL).search, re.compile(PLAIN_WORDS).findall
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.kept: dict[str, bytes] = {}
        self.kept_bytes = 0

    @staticmethod
    def _shown_bytes() -> list[str]:
        """The printable character that stands for each byte: itself where printable, else the next free one from U+0100 on."""
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = iter(range(0x100, 0x200))
        return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]

    def words(self, text: str) -> list[str]:
        """The words of a text, each as the characters that stand for its bytes, or as itself where all are plain."""
        if not self.unusual(text):
            return self.plain_words(text.lower())
        return ["\0" + w for w, _ in self.split(self.normalise(text))]

    def symbols(self, word: str) -> list[int]:
        """The single-byte symbols of a word, the last with the word end."""
        shown = word[1:] if word[0] == "\0" else "".join(self.shown[b] for b in word.encode())
        return [self.vocabulary[c] for c in shown[:-1]] + [self.vocabulary[shown[-1] + self.suffix]]

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that are not kept yet, all in one index."""
        if self.kept_bytes > KEPT_BYTES:
            self.kept.clear()
            self.kept_bytes = 0
        new = [w for w in words if w not in self.kept]
        for word, ids in zip(new, self.index.encode(map(self.symbols, new)), strict=True):
            self.kept[word] = found = np.array(ids, "<u4").tobytes()
            self.kept_bytes += ENTRY_BYTES + len(word) + len(found)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        pieces: list[list[int | list[str]]] = []
        distinct: set[str] = set()
        for text in texts:
            row: list[int | list[str]] = []
            for part in self.special.split(text) if self.special and "<|" in text else [text]:
                if part in self.added:
                    row.append(self.added[part])
                else:
                    row.append(words := self.words(part))
                    distinct.update(words)
            pieces.append(row)
        self.learn(distinct)
        kept = self.kept
        return [b"".join(b"".join(map(kept.__getitem__, x)) if isinstance(x, list) else int(x).to_bytes(4, "little") for x in row) for row in pieces]

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with single spaces between them, as a tokenizers file without a decoder gives them."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _codec(name: str) -> Codec:
    import public_tokenizers

    return worker_cache(("bpe", name), lambda: Codec(public_tokenizers.path(name)))


def _run(name: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for batch in slices(batches, "text", 4 << 20):
            encoded = codec.encode([x or "" for x in batch.column("text").to_pylist()])
            if digests:
                last = [pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()), pa.array([hashlib.sha256(codec.decode(x).encode("utf-8", "replace")).hexdigest() for x in encoded], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                last = [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in encoded], pa.list_(pa.int32())), pa.array([codec.decode(x) for x in encoded], pa.string())]
                names = ["doc_id", "n_tokens", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in encoded], pa.int64()), *last], names)

    return run


def _input(documents: DataFrame) -> DataFrame:
    small_batches(documents)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_decode(documents: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every document.

    Takes doc_id and text; other columns are not read. Each row stands alone, so there is no shuffle: a task cuts its
    rows into slices of some megabytes, builds the pair occurrence index over the distinct words of a slice that it
    doesn't know yet, and joins the ids of the words. A null or empty text has no ids and decodes to the empty text.
    Strings of special tokens in a text are those tokens, as in the library. Repeated rows give repeated rows; an empty table gives
    an empty one. A text is encoded whole, however long; the ids of words that a worker keeps take KEPT_BYTES and a slice at most.
    """
    return _input(documents).mapInArrow(_run(tokenizer, False), "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_decode_digests(documents: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """As encode_decode, with SHA-256 digests of the ids (little-endian unsigned 32 bit) and of the decoded text (UTF-8)."""
    return _input(documents).mapInArrow(_run(tokenizer, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
