"""Alignment of two tokenizers of the same texts.

A whole Arrow batch is one sequence of bytes with the offsets of its documents.  The ends
of A's and of B's tokens are counted once each by ``bincount``; groups are cut where both
occur, and every end of either closes the overlap of one A token with one B token: a link.
Prefix sums over the batch, read at the documents' offsets, give each document's numbers.

How many documents hold a pair of ids linked is counted by Spark over all documents.
Documents with their distinct pairs are written once to the shared folder.  Counts of two
and more go back to them as a table sorted by pair, in a broadcast of at most MOST_PAIRS
pairs; a larger table is joined by pair instead.  A pair that is not in it has a count of
one.  The highest count of each A id has as many rows as its vocabulary.

Defined results: texts that are null, empty, or hold U+2581 (which B reads as a space, so
that its bytes differ) have no tokens: zeros and an empty string.  Repeated rows and ids
are documents of their own; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import chunks, staged, strings, unstage
from gridloom.llm.merges import ChunkTable, Merges, ragged
from gridloom.llm.pieces import MARKER, PieceCodec, read_pieces
from gridloom.operators.relational import join_spread

#: Bytes of text that a task aligns at once.
BATCH = 2 << 20
#: Pairs of ids that are broadcast with their counts: 12 bytes each, 48 MB.
MOST_PAIRS = 1 << 22


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteCodec:
    """Encoder of a byte-level BPE vocabulary, with the merges of its file; the strings of special tokens are plain text."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, value = model["vocab"], byte_alphabet()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(vocabulary.values()) + 1
        rows = [(vocabulary[a], vocabulary[b], r, vocabulary[a + b]) for r, (a, b) in enumerate(pairs)]
        self.merges = Merges(*np.array(rows, np.int64).T, self.size)
        self.byte_ids = np.zeros(256, np.int32)
        for c, v in value.items():
            self.byte_ids[v] = vocabulary[c]
        self.pattern = pattern
        self.token_bytes = np.zeros(self.size, np.int64)
        for token, i in vocabulary.items():
            self.token_bytes[i] = len(token)
        self.warm()

    def warm(self) -> None:
        self.table = ChunkTable(self.segment)
        self.find = regex.compile(self.pattern).findall

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "find")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.warm()

    def segment(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of pre-tokens."""
        known = chunks.to_pylist()
        offsets = np.zeros(len(known) + 1, np.int64)
        np.cumsum([len(x) for x in known], out=offsets[1:])
        return self.merges.apply(self.byte_ids[np.frombuffer(b"".join(known), np.uint8)], offsets)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of all texts, and where those of each begin."""
        tokens: list[str] = []
        many = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            tokens += self.find(text)
            many[i + 1] = len(tokens)
        slots = self.table.slots(pa.array(tokens, pa.large_string()).cast(pa.large_binary()))
        ends = np.zeros(len(slots) + 1, np.int64)
        np.cumsum(self.table.counts[slots], out=ends[1:])
        return self.table.spread(slots), ends[many]


class Aligner:
    """Both encoders, and the alignment of a batch."""

    def __init__(self, a: ByteCodec, b: PieceCodec):
        self.a, self.b = a, b
        self.b_bytes = np.array([len(s) for s in b.surfaces], np.int64)
        most = max(a.size, b.size)
        self.digits = np.frombuffer("".join(f"{i:<6}" for i in range(most)).encode(), np.uint8).reshape(most, 6)  # room for a separator
        self.n_digits = np.array([len(str(i)) for i in range(most)], np.int64)
        if most > 99_999:
            raise ValueError("ids of more than five digits")

    def batch(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        """Of each text n_a, n_b, n_groups, n_links and groups_sha256, and its distinct ``pairs`` with how often each is linked."""
        valid = np.array([bool(t) and MARKER not in t for t in texts], bool)
        n = len(texts)
        spaced = [" " + t for t, ok in zip(texts, valid, strict=True) if ok]
        size = np.array([len(t.encode()) for t in spaced], np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        a, a_first = self.a.encode(spaced)
        pieces, first = self.b.chunks([t[1:] for t in spaced])
        slots = self.b.table.slots(pieces)
        b = self.b.table.spread(slots)
        b_first = np.concatenate([[0], np.cumsum(self.b.table.counts[slots])]).astype(np.int64)[first]

        a_ends, b_ends = np.cumsum(self.a.token_bytes[a]), np.cumsum(self.b_bytes[b])
        at_a, at_b = (np.bincount(e, minlength=offsets[-1] + 1)[: offsets[-1] + 1] for e in (a_ends, b_ends))
        for ends, marks in ((a_ends, at_a), (b_ends, at_b)):  # tokens end where documents do
            if len(ends) and (ends[-1] != offsets[-1] or not marks[offsets[1:]].all()):
                raise ValueError("tokens do not add up to the text")
        both, either = (at_a & at_b).astype(bool), (at_a | at_b).astype(bool)
        done_a, done_b, done_both, done_either = (np.cumsum(x) for x in (at_a, at_b, both, either))
        at = np.flatnonzero(either)
        left, right = done_a[at] - at_a[at], done_b[at] - at_b[at]  # the tokens that overlap up to here
        stride = np.int64(self.b.size)
        pair = a[left].astype(np.int64) * stride + b[right]
        document = np.repeat(np.arange(len(size)), np.diff(done_either[offsets]))
        span = np.int64(self.a.size) * stride
        if (len(size) + 1) * int(span) >= 1 << 63:
            raise ValueError("too many documents in a batch")
        keys, times = np.unique(document * span + pair, return_counts=True)

        out = {"n_a": np.diff(a_first), "n_b": np.diff(b_first), "n_groups": np.diff(done_both[offsets]), "n_links": np.diff(done_either[offsets])}
        out = {c: self._placed(v, valid) for c, v in out.items()}
        out["groups_sha256"] = [""] * n
        for i, digest in zip(np.flatnonzero(valid).tolist(), self._groups(a, b, a_ends, b_ends, both, done_both, offsets), strict=True):
            out["groups_sha256"][i] = digest
        out["pairs"], out["times"] = keys % span, times
        out["n_pairs"] = self._placed(np.diff(np.searchsorted(keys // span, np.arange(len(size) + 1))), valid)
        return out

    @staticmethod
    def _placed(values: np.ndarray, valid: np.ndarray) -> np.ndarray:
        out = np.zeros(len(valid), np.int64)
        out[valid] = values
        return out

    def _groups(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, both: np.ndarray, done_both: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The digest of the groups of every document, written as a1,a2|b1;a3|b2,b3."""
        a_group, b_group = done_both[a_ends] - both[a_ends], done_both[b_ends] - both[b_ends]
        groups = int(done_both[-1]) if len(done_both) else 0
        of_a, of_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        b_before = np.cumsum(of_b) - of_b  # B's tokens of the groups before
        a_through = np.cumsum(of_a)  # A's tokens up to and with the group
        order_a, order_b = np.arange(len(a)) + b_before[a_group], np.arange(len(b)) + a_through[b_group]
        ids = np.zeros(len(a) + len(b), np.int32)
        ids[order_a], ids[order_b] = a, b
        follow = np.zeros(len(ids), np.uint8)
        follow[order_a] = np.where(both[a_ends], ord("|"), ord(","))
        follow[order_b] = np.where(both[b_ends], ord(";"), ord(","))
        text = self.digits[ids]  # indexing makes a copy
        width = self.n_digits[ids]
        text[np.arange(len(ids)), width] = follow
        flat = text[np.arange(6) <= width[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(width + 1)])
        # the tokens of the documents before are those that end by where this one begins
        tokens = np.cumsum(np.bincount(a_ends, minlength=len(both)) + np.bincount(b_ends, minlength=len(both)))[offsets]
        at = ends[tokens].tolist()
        return [hashlib.sha256(flat[i : j - 1]).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)]


def broadcast_aligner(spark: SparkSession, a_path: str, b_path: str, pattern: str = public_tokenizers.PATTERN) -> Broadcast:
    """The aligner of a byte-level vocabulary (json) and a piece model that the driver can read."""
    return spark.sparkContext.broadcast(Aligner(ByteCodec(a_path, pattern), PieceCodec(read_pieces(b_path))))


def _aligned(documents: DataFrame, aligner: Broadcast, id_column: str, text_column: str) -> DataFrame:
    """(row, id, counts, digest, pairs, times): the alignment of every document; ``row`` numbers them by task."""
    source = documents.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text"))
    kind = "int" if aligner.value.a.size * aligner.value.b.size < 1 << 31 else "bigint"
    item = pa.int32() if kind == "int" else pa.int64()
    numbers = ("n_a", "n_b", "n_groups", "n_links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in chunks(whole, "__text", BATCH):
                found = aligner.value.batch(strings(batch.column(1)))
                ends = pa.array(np.concatenate([[0], np.cumsum(found["n_pairs"])]), pa.int32())
                pairs, times = (pa.ListArray.from_arrays(ends, pa.array(found[c], t)) for c, t in (("pairs", item), ("times", pa.int32())))
                columns = [pa.array(np.arange(row, row + batch.num_rows)), batch.column(0), *[pa.array(found[c], pa.int64()) for c in numbers], pa.array(found["groups_sha256"], pa.string()), pairs, times]
                row += batch.num_rows
                yield pa.RecordBatch.from_arrays(columns, names=["__row", "__id", *numbers, "groups_sha256", "__pairs", "__times"])

    return source.mapInArrow(run, f"__row long, __id {dict(source.dtypes)['__id']}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, __pairs array<{kind}>, __times array<int>")


def _packed(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The pairs and counts of a table of bounded size, sorted by pair."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.asarray(batch.column(0), np.int64).tobytes(), np.asarray(batch.column(1), np.int32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in data], names=["k", "n"])

    rows = counts.select(F.col("pair").cast("long"), F.col("held").cast("int")).mapInArrow(pack, "k binary, n binary").collect()
    keys = np.frombuffer(b"".join(r["k"] for r in rows), np.int64)
    order = np.argsort(keys)
    return keys[order], np.frombuffer(b"".join(r["n"] for r in rows), np.int32)[order]


def align(documents: DataFrame, aligner: Broadcast, id_column: str = "doc_id", text_column: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Per document n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    spark, size_a, stride = documents.sparkSession, aligner.value.a.size, aligner.value.b.size
    rows = staged(_aligned(documents, aligner, id_column, text_column), compression="zstd")
    held = staged(rows.select(F.explode("__pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("held")).where("held > 1"))
    kept = ["__id", "n_a", "n_b", "n_groups", "n_links"]
    if held.count() > most_pairs:
        out = _joined(rows, held, kept, stride)
    else:
        keys, counts = _packed(held)
        highest = np.ones(size_a, np.int32)  # of an A id none of whose pairs is in two documents
        np.maximum.at(highest, keys // stride, counts)
        out = _looked_up(rows, spark.sparkContext.broadcast((keys, counts, highest)), kept, stride)
    unstage(held)
    return out.withColumnRenamed("__id", id_column)


def _looked_up(rows: DataFrame, table: Broadcast, kept: list[str], stride: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, highest = table.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                pairs, times = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
                pair, n = np.asarray(pairs.flatten(), np.int64), np.asarray(times.flatten(), np.int64)
                ends = np.concatenate([[0], np.cumsum(np.diff(np.asarray(pairs.offsets)))])
                if len(keys):
                    place = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                    count = np.where(keys[place] == pair, counts[place], 1).astype(np.int64)
                else:
                    count = np.ones(len(pair), np.int64)
                best, total = (np.concatenate([[0], np.cumsum(x)])[ends] for x in (n * (count == highest[pair // stride]), n * count))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(np.diff(best)), pa.array(np.diff(total))], names=[*batch.schema.names[:-2], "n_best", "count_sum"])

    kinds = dict(rows.dtypes)
    columns = [*kept, "groups_sha256"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", n_best long, count_sum long"
    return rows.select(*columns, "__pairs", "__times").mapInArrow(run, schema).select(*kept, "n_best", "count_sum", "groups_sha256")


def _joined(rows: DataFrame, held: DataFrame, kept: list[str], stride: int) -> DataFrame:
    """The same by joins: for more pairs than a broadcast may hold."""
    of_a = F.floor(F.col("pair") / stride).cast("long")
    highest = held.groupBy(of_a.alias("a")).agg(F.max("held").alias("highest"))  # at most as many rows as A has ids
    links = staged(rows.select("__row", F.explode(F.arrays_zip("__pairs", "__times")).alias("l")).select("__row", F.col("l.__pairs").alias("pair"), F.col("l.__times").alias("times")))
    counted = join_spread(links, held, ["pair"], "left").select("__row", "times", of_a.alias("a"), F.coalesce("held", F.lit(1)).alias("held"))
    counted = counted.join(F.broadcast(highest), "a", "left")
    best = F.when(F.col("held") == F.coalesce("highest", F.lit(1)), F.col("times")).otherwise(0)
    sums = counted.groupBy("__row").agg(F.sum(best).alias("n_best"), F.sum(F.col("times") * F.col("held")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return staged(rows.select("__row", *kept, "groups_sha256").join(sums, "__row", "left").select(*kept, zero("n_best"), zero("count_sum"), "groups_sha256"))
