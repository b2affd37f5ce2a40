"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a
vocabulary entry as it stands costs one probe and one comparison of bytes.  Tier
two merges the bytes of any other pre-token: a linked list of pieces and a heap
of adjacent pairs by (rank, position), so a pre-token of n bytes takes
O(n log n) steps however long it is.

Encoding is per document and needs no shuffle.  The vocabulary is a parameter
(a file of ranks); its tables have a fixed size, set by the vocabulary alone, and
are shipped once per executor as a broadcast.

Defined results: a null text counts as empty; an empty text has no ids, and both
digests are those of the empty string.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_map, strings

_M = (1 << 64) - 1
#: Entries of the memo of a task, of pre-tokens already encoded; it is emptied when full.
MEMO = 1 << 19


def _slot(h: int, d: int, n: int) -> int:
    """The slot of hash ``h`` under displacement ``d``."""
    x = (h ^ (d * 0x9E3779B97F4A7C15)) & _M
    x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & _M
    return (x ^ (x >> 32)) % n


class PerfectHash:
    """A minimal perfect hash: n keys on slots 0 to n - 1, by hash and displace.

    Buckets of about two keys are placed from the largest down.  A bucket of one
    key takes any free slot, which is stored as a negative displacement.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) != n:
            raise ValueError("repeated keys, or two keys with one 64-bit hash")
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        self.shift = [0] * self.buckets
        self.key_at = [-1] * n
        free = set(range(n))
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            group = groups[b]
            if len(group) == 1:
                slot = free.pop()
                self.shift[b] = -1 - slot
                self.key_at[slot] = group[0]
            elif group:
                d = 0
                while True:
                    slots = {_slot(hashes[i], d, n) for i in group}
                    if len(slots) == len(group) and slots <= free:
                        break
                    d += 1
                self.shift[b] = d
                free -= slots
                for i in group:
                    self.key_at[_slot(hashes[i], d, n)] = i

    def probe(self, key: bytes) -> int:
        """The index of the only key that can equal ``key``."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return self.key_at[-1 - d if d < 0 else _slot(h, d, self.n)]


class Probes(dict):
    """Answers of the perfect hash for pieces met before: their ranks, or -1."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: bytes) -> int:
        r = self.codec.lookup(piece)
        self[piece] = r = -1 if r is None else r
        return r


class Codec:
    """Encoder and decoder of one vocabulary of (bytes, rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.words = list(ranks)
        self.rank = [ranks[w] for w in self.words]
        self.pattern = pattern
        self.index = PerfectHash(self.words)
        self.bytes_of = {r: w for w, r in ranks.items()}
        self._warm()

    def _warm(self) -> None:
        self._find = regex.compile(self.pattern).findall
        self._memo: dict[str, bytes] = {}
        self._seen = Probes(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_find", "_memo", "_seen")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._warm()

    def lookup(self, piece: bytes) -> int | None:
        """The rank of a piece that is in the vocabulary: tier one."""
        i = self.index.probe(piece)
        return self.rank[i] if self.words[i] == piece else None

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a piece outside the vocabulary: tier two."""
        n, rank = len(piece), self._seen
        if len(rank) > MEMO:
            rank.clear()
        ends = list(range(1, n + 1))  # the piece from i ends at ends[i]; -1 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank[piece[i : i + 2]]) >= 0]
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            _, i, mid, end = pop(heap)
            if ends[i] != mid or ends[mid] != end:
                continue  # one of the two pieces has changed since
            ends[mid] = -1
            ends[i] = end
            if end < n:
                before[end] = i
                after = ends[end]
                if (r := rank[piece[i:after]]) >= 0:
                    push(heap, (r, i, end, after))
            if (left := before[i]) >= 0 and (r := rank[piece[left:end]]) >= 0:
                push(heap, (r, left, i, end))
        out, i = [], 0
        while i < n:
            if (r := rank[piece[i : ends[i]]]) < 0:
                raise ValueError(f"the vocabulary lacks byte {piece[i]}")
            out.append(r)
            i = ends[i]
        return out

    def _packed(self, tokens: list[str]) -> list[bytes]:
        """The ids of each pre-token as packed int32."""
        memo = self._memo
        try:
            return [memo[t] for t in tokens]
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for t in tokens:
                if t not in memo:
                    raw = t.encode("utf-8", "surrogatepass")
                    whole = self.lookup(raw)
                    memo[t] = np.array([whole] if whole is not None else self.merge(raw), np.int32).tobytes()
            return [memo[t] for t in tokens]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        return np.frombuffer(b"".join(self._packed(self._find(text))), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: on each line a base64 piece and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def broadcast_codec(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """The codec of a vocabulary file that the driver can read, for all executors."""
    return spark.sparkContext.broadcast(Codec(read_ranks(path), pattern))


def encode_documents(documents: DataFrame, codec: Broadcast, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``ids``, the ids of each text."""
    source = documents.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [codec.value.encode(x) for x in strings(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["__id", "ids"])

    out = arrow_map(source, "__text", run, f"__id {dict(source.dtypes)['__id']}, ids array<int>", 1 << 20)
    return out.withColumnRenamed("__id", id_column)


def decode_ids(encoded: DataFrame, codec: Broadcast, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``id_column`` and ``decoded``, the bytes that the ids stand for."""
    source = encoded.select(F.col(id_column).alias("__id"), F.col(ids_column).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [codec.value.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=["__id", "decoded"])

    out = source.mapInArrow(run, f"__id {dict(source.dtypes)['__id']}, decoded binary")
    return out.withColumnRenamed("__id", id_column)


def encode_digests(documents: DataFrame, codec: Broadcast, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document the number of ids, their digest and that of what they decode to.

    Encoding and decoding run in one pass, so ids never leave the task.
    """
    source = documents.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, of_ids, of_bytes = [], [], []
        for text in strings(batch.column(1)):
            ids = codec.value.encode(text).tolist()
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(codec.value.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
            names=["__id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = f"__id {dict(source.dtypes)['__id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(source, "__text", run, schema).withColumnRenamed("__id", id_column)
