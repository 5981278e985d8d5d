"""Byte-level BPE with given ranks: two-tier encoding, and decoding.

Tier 1: a minimal perfect hash over the vocabulary (:class:`PerfectHash`) resolves a
pre-token that is a token as a whole.  Tier 2: any other pre-token is merged with a
heap of ranked pairs over a doubly linked list of its bytes, O(n log n) in its length.
Both tiers run once per distinct pre-token of a task; a bounded memo holds results.

Ranks are read on the driver and broadcast (a vocabulary's size, about 1 MB).
Defined results: null text encodes to no ids and decodes to no bytes; special-token
strings are ordinary text; any length; other columns are handed on.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import append_arrow
from .pretokens import splitter

MEMO = 450_000  # distinct pre-tokens in each of two memos, the one in use and the one before


def _place(first: int, step: int, shift: int, n: int) -> int:
    """Slot of a key under a bucket's displacement; mixed, as n may share factors with the step."""
    x = (first + shift * step) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 29)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) % n


class PerfectHash:
    """Minimal perfect hash by displacement: keys fall into buckets; a bucket's number shifts its keys onto free slots.

    Buckets are placed from the fullest down; buckets of one key name their slot outright, which fills the table exactly.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        slots = np.full(n, -1, dtype=np.int64)
        parts = [self._parts(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, (bucket, _, _) in enumerate(parts):
            members[bucket].append(i)
        taken = bytearray(n)
        free_at = 0
        for bucket in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            mine = members[bucket]
            if not mine:
                break
            if len(mine) == 1:
                while taken[free_at]:
                    free_at += 1
                self.shift[bucket] = -1 - free_at
                places = [free_at]
            else:
                shift = 0
                while True:
                    places = [_place(parts[i][1], parts[i][2], shift, n) for i in mine]
                    if len({*places}) == len(places) and not any(taken[p] for p in places):
                        break
                    shift += 1
                self.shift[bucket] = shift
            for i, p in zip(mine, places, strict=True):
                taken[p], slots[p] = 1, i
        self.shift = self.shift.tolist()
        self.keys = [keys[i] for i in slots]
        self.order = slots.tolist()

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        import xxhash

        h = xxhash.xxh3_128_intdigest(key)
        return (h >> 96) % self.buckets, (h & 0xFFFFFFFFFFFF), (h >> 48 & 0xFFFFFFFFFFF) | 1

    def get(self, key: bytes) -> int:
        """The key's index in the list given, or -1."""
        bucket, first, step = self._parts(key)
        shift = self.shift[bucket]
        slot = -1 - shift if shift < 0 else _place(first, step, shift, self.n)
        return self.order[slot] if self.keys[slot] == key else -1


class Codec:
    """Encoder and decoder for tokens given in the order of their ids (ranks)."""

    def __init__(self, tokens: list[bytes], pattern: str, ids: list[int] | None = None):

        self.pattern, self.tokens = pattern, tokens
        self.ids = ids if ids is not None else list(range(len(tokens)))
        self.whole = PerfectHash(tokens)
        self.rank = dict(zip(tokens, self.ids, strict=True))
        self.bytes_of = dict(zip(self.ids, tokens, strict=True))
        self.find = splitter(pattern)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.before: dict[str, tuple[int, ...]] = {}  # the memo filled last

    def __reduce__(self):
        return Codec, (self.tokens, self.pattern, self.ids)

    def merge(self, piece: bytes) -> list[int]:
        """Tier 2: repeatedly merge the adjacent pair of the lowest rank, leftmost first.

        Parts are [start, end) of the piece, linked by their starts: ``stop[i]`` is where the part at i ends and the next
        begins, 0 once it has been merged away; ``left[j]`` is where the part before j starts.
        """
        get, n, push, pop = self.rank.get, len(piece), heapq.heappush, heapq.heappop
        stop, left = [*range(1, n + 1)], [*range(-1, n)]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = pop(heap)
            middle = stop[i]
            if not middle or middle >= n or stop[middle] != end:
                continue  # one of the pair has been merged since
            stop[i], stop[middle], left[end] = end, 0, i
            if end < n and (r := get(piece[i : stop[end]])) is not None:
                push(heap, (r, i, stop[end]))
            if i and (r := get(piece[left[i] : end])) is not None:
                push(heap, (r, left[i], end))
        out, i = [], 0
        while i < n:
            out.append(self.rank[piece[i : stop[i]]])
            i = stop[i]
        return out

    def pretoken(self, text: str) -> tuple[int, ...]:
        piece = text.encode()
        at = self.whole.get(piece)
        return (self.ids[at],) if at >= 0 else tuple(self.merge(piece))

    def encode(self, text: str) -> list[int]:
        memo, out = self.memo, []
        pieces = self.find(text)
        for new in {*pieces}.difference(memo):
            memo[new] = self.before.pop(new, None) or self.pretoken(new)
        for ids in map(memo.__getitem__, pieces):
            out += ids
        if len(memo) > MEMO:
            self.before, self.memo = memo, {}
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load(path: str, pattern: str) -> Codec:
    """A codec from a file of lines ``base64(token) rank``."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in lines if line.strip()))
    return Codec([t for _, t in pairs], pattern, [r for r, _ in pairs])


def share(spark: SparkSession, codec: Codec):
    """Broadcast of what a codec is built from: the vocabulary."""
    return spark.sparkContext.broadcast((codec.tokens, codec.pattern, codec.ids))


def encode(docs: DataFrame, shared, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with array<int> ``out_col``; null text gives an empty array."""

    def work():
        import pyarrow as pa

        codec = _codec(shared)

        def apply(column):
            ids = [np.array(codec.encode(t), dtype=np.int32) if t else np.empty(0, np.int32) for t in column.to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))]

        return apply

    return append_arrow(docs, text_col, [T.StructField(out_col, T.ArrayType(T.IntegerType()))], work)


def decode(coded: DataFrame, shared, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``coded`` with binary ``out_col``: the tokens' bytes joined; null ids give no bytes."""

    def work():
        import pyarrow as pa

        codec = _codec(shared)
        return lambda column: [pa.array([codec.decode(x) if x else b"" for x in column.to_pylist()], pa.binary())]

    return append_arrow(coded, ids_col, [T.StructField(out_col, T.BinaryType())], work)


_codecs: dict = {}


def _codec(shared) -> Codec:
    """One codec a worker process and broadcast."""
    key = id(shared.value)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = (shared.value, Codec(*shared.value))
    return _codecs[key][1]
