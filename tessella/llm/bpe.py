"""Byte-level BPE encoding and decoding.

A pre-token that is in the vocabulary as a whole is resolved by a minimal perfect hash over the vocabulary; any other
is merged with a heap of candidate pairs over linked bytes, lowest rank first and leftmost among equals. The work is a
map over Arrow batches: no shuffle, and a lost executor costs only its own partitions. The vocabulary (a file of fixed
size) is what is broadcast. Each worker process keeps a bounded cache of pre-tokens it has resolved.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded each; texts of any length are
encoded whole; other columns are passed through, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm._common import portions, table, values

#: Distinct pre-tokens in each of the two generations that a worker process remembers, and the longest one it does.
CACHE_ENTRIES, CACHE_CHARS = 230_000, 48


class PerfectHash:
    """Minimal perfect hash (hash and displace): n keys in n slots; the stored key tells strangers apart.

    A displacement of d >= 0 is mixed into the hashes of a bucket's keys; d < 0 names the slot of a lone key.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = len(keys)
        self.n, self.m = n, max(1, n // 3)
        self.keys: list[bytes | None] = [None] * n
        self.values = array("i", [-1]) * n
        self.shift = array("q", [0]) * self.m
        buckets: list[list[int]] = [[] for _ in range(self.m)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets[h % self.m].append(i)
        free = n
        for b in sorted(range(self.m), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if not own:
                break
            if len(own) == 1:
                free -= 1
                while self.keys[free] is not None:
                    free -= 1
                slots = [free]
                self.shift[b] = -free - 1
            else:
                d = 0
                while True:
                    slots = [self._slot(hashes[i], d) for i in own]
                    if len({*slots}) == len(own) and all(self.keys[s] is None for s in slots):
                        break
                    d += 1
                self.shift[b] = d
            for i, s in zip(own, slots, strict=True):
                self.keys[s], self.values[s] = keys[i], values[i]

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ d * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 24) % self.n

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.m]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[s] if self.keys[s] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece by merging linked bytes; the heap yields the lowest rank first, leftmost among equals."""
    n = len(piece)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    alive = bytearray(b"\1") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        if not alive[i] or (mid := after[i]) >= n or after[mid] != end:
            continue
        alive[mid] = 0
        after[i], before[end] = end, i
        if end < n and (r := ranks.get(piece[i : after[end]])) is not None:
            heappush(heap, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heappush(heap, (r, p, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec(dict):
    """Maps a pre-token to its ids in decimal, joined by commas; resolves and remembers what it does not hold."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.older: dict[str, str] = {}
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.whole = PerfectHash(list(ranks), list(ranks.values()))
        self.bytes_of = {str(i): b for b, i in ranks.items()}

    def __missing__(self, piece: str) -> str:
        ids = self.older.pop(piece, None)
        if ids is None:
            raw = piece.encode()
            found = self.whole.get(raw)
            ids = str(found) if found >= 0 else ",".join(map(str, merge(raw, self.ranks)))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> str:
        return ",".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


_codecs: dict[str, Codec] = {}


def _codec(key: str, ranks, pattern: str) -> Codec:
    """One codec for each vocabulary and worker process."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks.value, pattern)
    return _codecs[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, text: str = "text", ids: bool = True) -> DataFrame:
    """docs' columns in a struct `row`, and of each text: n_tokens, ids_sha256, decoded_sha256 and token_ids.

    vocabulary: path of a rank file, read on the driver. ids: False leaves token_ids null, for digests alone.
    decoded_sha256 is of the bytes that decoding the ids gives.
    """
    ranks = load_ranks(vocabulary)
    key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[text].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared, pattern)
        for batch in (x for whole in batches for x in portions(whole, 1)):
            counts, digests, decoded, lists = [], [], [], []
            for x in values(batch.column(1)):
                joined = codec.encode(x or "")
                counts.append(joined.count(",") + 1 if joined else 0)
                digests.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(joined)).hexdigest())
                lists.append((array("i", map(int, joined.split(","))) if joined else []) if ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)]
                + [pa.array(lists, pa.list_(pa.int32()))],
                names=["row", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"],
            )

    schema = packed.select("row").schema.add("n_tokens", "long").add("ids_sha256", "string")
    return packed.mapInArrow(run, schema.add("decoded_sha256", "string").add("token_ids", T.ArrayType(T.IntegerType())))


def decode(tokens: DataFrame, vocabulary: str, *, token_ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """tokens with a binary column of the bytes that the ids stand for; null ids give null, unknown ids an error."""
    of = {i: b for b, i in load_ranks(vocabulary).items()}
    shared = tokens.sparkSession.sparkContext.broadcast(of)
    packed = tokens.select(F.struct("*").alias("row"), F.col(token_ids).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            raw = [None if x is None else b"".join(map(of.__getitem__, x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["row", into])

    out = packed.mapInArrow(run, packed.select("row").schema.add(into, "binary"))
    return out.select("row.*", into)


def vocabulary() -> tuple[str, str]:
    """The default vocabulary's path and split pattern, those of the installed public files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, *vocabulary(), ids=False)
    return out.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
