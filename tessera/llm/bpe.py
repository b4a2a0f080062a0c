"""Byte-level BPE encoding and decoding with a public rank file, in two tiers.

A minimal perfect hash resolves the pre-tokens that are vocabulary entries as they stand; all others are merged with a
heap of candidate pairs over a doubly linked list of bytes. Ids travel as packed little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_or_empty

#: Distinct pre-tokens that a task remembers before it starts anew; speed only.
MEMO = 400_000
_M64 = (1 << 64) - 1
_MIX = 0x9E3779B97F4A7C15


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _mixed(h, seed):
    """A slot source from a 64-bit hash and a seed, for numpy arrays of uint64."""
    with np.errstate(over="ignore"):
        x = (h ^ (seed * np.uint64(_MIX))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash by hashing and displacing: n keys go to n slots; a bucket's seed makes its keys land on free slots."""

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // 4)
        h = self._hash(keys)
        if len(np.unique(h)) < self.n:
            raise ValueError("repeated keys, or two keys share a 64-bit hash")
        order = np.argsort(h % np.uint64(self.buckets), kind="stable")
        of = (h % np.uint64(self.buckets))[order].astype(np.int64)
        starts, ends = np.searchsorted(of, np.arange(self.buckets)), np.searchsorted(of, np.arange(self.buckets), side="right")
        self.seed = np.zeros(self.buckets, np.uint64)
        free = np.ones(self.n, bool)
        self.key_at = np.zeros(self.n, np.int64)
        tries = np.arange(1, 513, dtype=np.uint64)
        for b in np.argsort(starts - ends, kind="stable"):
            own = order[starts[b] : ends[b]]
            if not len(own):
                break
            base = np.uint64(0)
            while True:
                slots = (_mixed(h[own][None, :], (base + tries)[:, None]) % np.uint64(self.n)).astype(np.int64)
                good = free[slots].all(axis=1)
                if len(own) > 1:
                    s = np.sort(slots, axis=1)
                    good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    self.seed[b] = base + tries[k]
                    free[slots[k]] = False
                    self.key_at[slots[k]] = own
                    break
                base += np.uint64(len(tries))

    @staticmethod
    def _hash(keys) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))

    def __call__(self, keys: list[bytes]) -> np.ndarray:
        """For each key the index of the only stored key that it can be; the caller compares."""
        if not self.n:
            return np.full(len(keys), -1, np.int64)
        h = self._hash(keys)
        return self.key_at[(_mixed(h, self.seed[(h % np.uint64(self.buckets)).astype(np.int64)]) % np.uint64(self.n)).astype(np.int64)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: of the neighbours whose joint bytes are an entry, the lowest rank merges first, leftmost on ties."""
    n = len(piece)
    get, push, pop = ranks.get, heapq.heappush, heapq.heappop
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # a symbol is named by its first byte; end is also the next one's name
    pair = [get(piece[i : i + 2], -1) for i in range(n)]  # the rank of a symbol joined with the next one
    pair[n - 1] = -1
    heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
    heapq.heapify(heap)
    while heap:
        r, i = divmod(pop(heap), n)
        if pair[i] != r:
            continue  # one of the two has changed since
        j = end[i]
        stop = end[i] = end[j]
        pair[j] = pair[i] = -1
        if stop < n:
            prev[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                pair[i] = r
                push(heap, r * n + i)
        if (p := prev[i]) >= 0:
            if (r := get(piece[p:stop])) is not None:
                pair[p] = r
                push(heap, r * n + p)
            else:
                pair[p] = -1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Tokenizer:
    """The two tiers over one rank file; goes to the tasks as a broadcast of the vocabulary's fixed size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the rank file lacks single bytes: {missing[:5]}")
        self.ranks, self.pattern = ranks, pattern
        self.tokens = list(ranks)
        self.ids = list(ranks.values())
        self.hash = PerfectHash(self.tokens)
        self.memo: dict[str, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def _learn(self, new: list[str]) -> None:
        if len(self.memo) > MEMO:
            self.memo.clear()
        raw = [t.encode() for t in new]
        for text, piece, k in zip(new, raw, self.hash(raw).tolist(), strict=True):
            got = [self.ids[k]] if self.tokens[k] == piece else merge(piece, self.ranks)
            self.memo[text] = struct.pack(f"<{len(got)}I", *got)

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        split = regex.compile(self.pattern).findall
        for text in texts:
            pieces = split(text)
            if new := set(pieces).difference(self.memo):
                if len(self.memo) > MEMO:
                    new = set(pieces)
                self._learn(list(new))
            yield b"".join(map(self.memo.__getitem__, pieces))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids (packed little-endian uint32) and n_tokens of each whole text, as tiktoken's encode_ordinary gives them.

    path: a tiktoken rank file, read on the driver. Null and empty texts give no ids; null ids and repeated rows pass
    through; other columns are ignored; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Tokenizer(read_ranks(path), pattern))

    def run(batches):
        for b in slices(batches):
            ids = list(shared.value.encode_batch(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids binary, n_tokens long")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds the column decoded (bytes) to a table with ids as encode() packs them; null ids decode to no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast({i: t for t, i in read_ranks(path).items()})

    def run(batches):
        for b in slices(batches):
            texts = [b"".join(map(shared.value.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], [*b.schema.names, "decoded"])

    kept = encoded.drop("decoded")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())]))
