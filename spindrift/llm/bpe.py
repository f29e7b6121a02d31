"""Byte-level BPE encoding and decoding.

Pre-tokens are the matches of the tokenizer's pattern. Tier one: a minimal perfect hash over the vocabulary says whether a
whole pre-token is a token, and which; most are, in ordinary text. Tier two, for the rest: the pre-token's bytes form a linked
list, and a heap of adjacent pairs ordered by (rank, position) drives the merges, so that a long pre-token costs n log n.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import common

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens that a Python worker keeps with their ids; beyond that it begins anew, with the same results.
CACHE = 400_000

_codecs: dict = {}


class PerfectHash:
    """Minimal perfect hash (hash, displace and compare) from a fixed set of byte strings to 0..n-1."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n = len(keys)
        self.n, self.buckets = n, max(1, -(-n // per_bucket))
        code = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        bucket = (code % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(size) - size
        self.shift = [0] * self.buckets
        taken, slot_of = bytearray(n), [0] * n
        code_list, order = code.tolist(), order.tolist()
        for b in np.argsort(-size, kind="stable").tolist():
            own = order[first[b] : first[b] + size[b]]
            if len(own) < 2:
                break
            d = 0
            while True:
                slots = [self._slot(code_list[k], d) for k in own]
                if not any(taken[s] for s in slots) and len(set(slots)) == len(slots):
                    break
                d += 1
            for k, s in zip(own, slots, strict=True):
                taken[s], slot_of[k] = 1, s
            self.shift[b] = d
        free = (s for s in range(n) if not taken[s])  # a bucket of one key names its slot outright
        for b in np.flatnonzero(size == 1).tolist():
            k = order[first[b]]
            slot_of[k] = next(free)
            self.shift[b] = -1 - slot_of[k]
        self.key_at: list[bytes] = [b""] * n
        self.number_at: list[int] = [0] * n
        for k, s in enumerate(slot_of):
            self.key_at[s], self.number_at[s] = keys[k], k

    def _slot(self, code: int, displacement: int) -> int:
        if displacement < 0:
            return -1 - displacement
        mixed = (code ^ (displacement * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        mixed = (mixed ^ (mixed >> 29)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (mixed ^ (mixed >> 32)) % self.n

    def find(self, key: bytes) -> int:
        """Number of the key, or -1 if it isn't one."""
        code = xxhash.xxh64_intdigest(key)
        slot = self._slot(code, self.shift[code % self.buckets])
        return self.number_at[slot] if self.key_at[slot] == key else -1


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.id_of = [ranks[k] for k in keys]
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.bytes_of[v] = k
        self.cache: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token by merging: always the adjacent pair of lowest rank, the leftmost first."""
        n, ranks = len(word), self.ranks
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(word[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            j = after[i]
            if end[i] == 0 or j >= n or end[j] != stop:  # a part of the pair has been merged meanwhile
                continue
            end[i], end[j] = stop, 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(word[i : end[k]])
                if rank is not None:
                    heappush(heap, (rank, i, end[k]))
            h = before[i]
            if h >= 0:
                rank = ranks.get(word[h:stop])
                if rank is not None:
                    heappush(heap, (rank, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = after[i]
        return out

    def word(self, token: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        raw = token.encode()
        found = self.hash.find(raw)
        return self.id_of[found].to_bytes(4, "little") if found >= 0 else np.array(self.merge(raw), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        cache = self.cache
        words = self.pattern.findall(text)
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            out = []
            for w in words:
                got = cache.get(w)
                if got is None:
                    if len(cache) >= CACHE:
                        cache.clear()
                    got = self.word(w)
                    if len(w) < 64:
                        cache[w] = got
                out.append(got)
            return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids."""
        parts = self.bytes_of
        return b"".join([parts[i] for i in memoryview(ids).cast("I")]) if ids else b""


def codec(path: str | None = None) -> Codec:
    """This Python worker's codec of a rank file."""
    path = path or public_tokenizers.path(RANKS)
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ranks: str | None = None, decoded: bool = False) -> DataFrame:
    """``keep``, ``n_tokens`` and ``ids`` (binary: little-endian unsigned 32-bit) of every text; ``decoded`` adds their bytes.

    A null text is empty: no ids. Texts of any length are encoded whole. Repeated rows stay, an empty table gives no rows, and a
    kept column with the name of a result gives way to it.
    """
    keep = common.others(keep, "n_tokens", "ids", "decoded")
    docs = common.of_texts(docs).select(*keep, docs[text_col].alias("__text"))
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids", "binary")
    if decoded:
        schema = schema.add("decoded", "binary")

    def run(batches):
        own = codec(ranks)
        for batch in common.sliced(batches, "__text"):
            ids = [own.encode(t) if t else b"" for t in batch.column("__text").to_pylist()]
            columns = [*(batch.column(k) for k in keep), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([own.decode(i) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(coded: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), ranks: str | None = None) -> DataFrame:
    """``keep`` and ``decoded`` (binary) of every row's ids (binary, as ``encode`` gives them); null ids give empty bytes."""
    keep = common.others(keep, "decoded")
    coded = coded.select(*keep, coded[ids_col].alias("__ids"))
    schema = coded.select(*keep).schema.add("decoded", "binary")

    def run(batches):
        own = codec(ranks)
        for batch in common.sliced(batches, "__ids"):
            found = pa.array([own.decode(i) if i else b"" for i in batch.column("__ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), found], names=schema.names)

    return coded.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: ids and decoded bytes of every document, as digests."""
    coded = encode(common.table(spark, sf_dir, "documents"), decoded=True)
    return coded.selectExpr("doc_id", "n_tokens", "sha2(ids, 256) as ids_sha256", "sha2(decoded, 256) as decoded_sha256")
