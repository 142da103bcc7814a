"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary gives the id of a pre-token that is itself a
vocabulary entry.  Tier two, for the others: bytes in a linked list, and a heap of the neighbouring
pairs that the vocabulary can merge; the lowest rank merges first, then the leftmost.  Results per
distinct pre-token are remembered in a table of bounded size.

Null texts count as empty (no ids).  Texts of any length are encoded whole; a pre-token of n bytes
costs n log n.  Repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
import sys
from array import array
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import id_text, python_stage, table

#: Pre-tokens, and chunks of them, that a worker remembers before it starts afresh.
MEMO = 500_000


class PerfectHash:
    """Keys -> values by hash and displace: one slot a key, no empty slots, keys kept for the check."""

    def __init__(self, items: list[tuple[bytes, int]]):
        import xxhash

        self.hash, n = xxhash.xxh3_64_intdigest, max(1, len(items))
        self.n = self.m = n  # a bucket a key: most buckets hold one key or two, so few displacements are tried
        self.shift, buckets = [0] * self.m, [[] for _ in range(self.m)]
        for key, value in items:
            h = self.hash(key)
            buckets[(h >> 40) % self.m].append((h, key, value))
        self.keys, self.values = [None] * n, [0] * n
        free = n
        order = sorted(range(self.m), key=lambda b: -len(buckets[b]))
        for b in order:
            if len(buckets[b]) < 2:
                break
            d = 0
            while True:
                spots = [self._spot(h, d) for h, _, _ in buckets[b]]
                if len(set(spots)) == len(spots) and all(self.keys[s] is None for s in spots):
                    break
                d += 1
            self.shift[b] = d
            for s, (_, key, value) in zip(spots, buckets[b]):
                self.keys[s], self.values[s] = key, value
                free -= 1
        spare = iter([s for s in range(n) if self.keys[s] is None])
        for b in order:
            if len(buckets[b]) == 1:  # a bucket of one takes any spare slot, named directly
                s = next(spare)
                self.shift[b] = -1 - s
                _, self.keys[s], self.values[s] = buckets[b][0]

    def _spot(self, h: int, d: int) -> int:
        return ((h & 0xFFFFF) + d * ((h >> 20) & 0xFFFFF | 1) + (d * d >> 1)) % self.n

    def get(self, key: bytes) -> int:
        """The key's value, -1 if it is none of the keys."""
        h = self.hash(key)
        d = self.shift[(h >> 40) % self.m]
        s = -1 - d if d < 0 else self._spot(h, d)
        return self.values[s] if self.keys[s] == key else -1


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece by merges of ascending rank."""
    n, rank = len(piece), ranks.get
    if n == 1:
        return [ranks[piece]]
    # a node is the offset where its bytes begin; end[i] is where they stop, pair[i] the rank of its merge with the next node
    before, end = list(range(-1, n - 1)), list(range(1, n + 1))
    pair = [rank(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]
    shift = n.bit_length()
    low = (1 << shift) - 1
    heap = [r << shift | i for i, r in enumerate(pair) if r >= 0]  # by rank, then from the left
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        i = top & low
        if pair[i] != top >> shift:
            continue  # one of the two has merged since
        mid = end[i]
        end[i] = stop = end[mid]
        pair[mid] = -1
        if stop < n:
            before[stop] = i
            pair[i] = r = rank(piece[i : end[stop]], -1)
            if r >= 0:
                heapq.heappush(heap, r << shift | i)
        else:
            pair[i] = -1
        if (p := before[i]) >= 0:
            pair[p] = r = rank(piece[p:stop], -1)
            if r >= 0:
                heapq.heappush(heap, r << shift | p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec(dict):
    """Ids of a space with the characters up to the next single space, filled on a miss.

    In the public pattern a space between two other characters begins a match, so a text may be cut
    there and its parts be split and remembered alone.  Other patterns split the whole text.
    """

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            items = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]
        self.vocab = PerfectHash(items)
        self.bytes_of = [b""] * (1 + max(i for _, i in items))
        for key, i in items:
            self.bytes_of[i] = key
        self.ranks = dict(items)
        self.split = regex.compile(pattern).findall
        # text where a single space between two other characters always begins a match
        self.cut = re.compile(r"(?<=\S) (?=\S)").split if pattern == public_pattern() else lambda text: [text]
        self.tokens: dict[str, tuple[int, ...]] = {}

    def token(self, token: str) -> tuple[int, ...]:
        if (ids := self.tokens.get(token)) is None:
            piece = token.encode()
            whole = self.vocab.get(piece)
            ids = (whole,) if whole >= 0 else tuple(merge_bytes(piece, self.ranks))
            if len(self.tokens) >= MEMO:
                self.tokens.clear()
            if len(token) <= 64:
                self.tokens[token] = ids
        return ids

    def chunk(self, chunk: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.token, self.split(chunk))))

    def __missing__(self, chunk: str):
        # a space and ASCII letters are one match of the public pattern
        ids = self.token(" " + chunk) if chunk.isascii() and chunk.isalpha() else self.chunk(" " + chunk)
        if len(self) >= MEMO:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> array:
        first, *rest = self.cut(text)
        return array("I", chain(self.chunk(first), chain.from_iterable(map(self.__getitem__, rest))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def packed(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def _encode(batches, path, pattern, decode):
    import pyarrow as pa

    own = codec(path, pattern)
    for batch in batches:
        ids = [own.encode(t) for t in batch.column("text").to_pylist()]
        cols = {"doc_id": batch.column("doc_id"), "ids": pa.array([packed(x) for x in ids], pa.binary())}
        if decode:
            cols["decoded"] = pa.array([own.decode(x) for x in ids], pa.binary())
        yield pa.RecordBatch.from_pydict(cols)


def _decode(batches, path, pattern):
    import pyarrow as pa

    own = codec(path, pattern)
    for batch in batches:
        out = []
        for raw in batch.column("ids").to_pylist():
            ids = array("I", raw or b"")
            if sys.byteorder == "big":
                ids.byteswap()
            out.append(own.decode(ids))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": pa.array(out, pa.binary())})


def _vocabulary(path, pattern):
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit, packed); with ``decoded`` also their bytes."""
    rows = id_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    return python_stage(rows, "tessera.llm.bpe:_encode", f"doc_id {kind}, ids binary" + ", decoded binary" * decoded, *_vocabulary(path, pattern), decoded)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the bytes that packed ids stand for."""
    kind = dict(encoded.dtypes)["doc_id"]
    return python_stage(encoded.select("doc_id", "ids"), "tessera.llm.bpe:_decode", f"doc_id {kind}, decoded binary", *_vocabulary(path, pattern))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"), decoded=True))
