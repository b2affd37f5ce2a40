"""SentencePiece BPE encoding and decoding through a table of distinct chunks.

A chunk is a marked word: a run of whitespace markers and what follows up to the next
marker.  Where no piece of the vocabulary has a marker behind another character, merges
cannot leave a chunk, so each distinct chunk is segmented once and its ids are joined
back by position.  With a vocabulary that has such pieces, a text is one chunk.

Chunks are found on the bytes of a whole Arrow batch.  There is no shuffle: the table
belongs to a task and is bounded.  The vocabulary is a parameter, shipped once per
executor; its size does not grow with the data.

Defined results: a null text counts as empty; an empty text has no ids, and both digests
are those of the empty string.  U+2581 in a text is the marker itself and decodes to a
space, as in the library.  Characters outside the vocabulary become the pieces of their
bytes.  Repeated rows and ids give a row each; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_map, strings
from gridloom.llm.merges import ChunkTable, Merges

MARKER = "▁"
#: Bytes of text that a task encodes at once.
BATCH = 2 << 20


class PieceCodec:
    """Encoder and decoder of a BPE model with byte fallback and without normalisation.

    ``pieces`` lists (piece, score, kind) by id; kinds are normal, byte, control and unknown.
    """

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.size = len(pieces)
        normal = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == "normal"}
        self.local = not any(MARKER in p.lstrip(MARKER) for p in normal)
        self.byte_ids = np.full(256, -1, np.int32)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == "byte":
                self.byte_ids[int(p[1:-1], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary lacks pieces for some bytes")
        self.value_of_byte = {int(i): v for v, i in enumerate(self.byte_ids)}
        self.surfaces = [b"" if kind == "control" else b" \xe2\x81\x87 " if kind == "unknown" else p.replace(MARKER, " ").encode() for p, _, kind in pieces]
        for i, v in self.value_of_byte.items():
            self.surfaces[i] = bytes([v])
        score = {p: pieces[i][1] for p, i in normal.items()}
        rank = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rows = [(normal[p[:k]], normal[p[k:]], rank[score[p]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        self.merges = Merges(*np.array(rows or np.zeros((0, 4)), np.int64).T, self.size)
        ones = sorted((ord(p.replace(MARKER, " ")), i) for p, i in normal.items() if len(p) == 1)
        self.characters, self.ids_of = (np.array(x, np.int64) for x in zip(*ones, strict=True))
        self.warm()

    def warm(self) -> None:
        self.table = ChunkTable(self.segment)
        self._age, self._written, self._read = 0, [], []

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("table", "_age", "_written", "_read")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.warm()

    def segment(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of chunks, whose markers are written as spaces."""
        known = chunks.to_pylist()
        points = np.frombuffer(b"".join(known).decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        data = np.frombuffer(b"".join(known), np.uint8)
        chars = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
        ends = np.zeros(len(known) + 1, np.int64)
        np.cumsum([len(x) for x in known], out=ends[1:])
        at = np.minimum(np.searchsorted(self.characters, points), len(self.characters) - 1)
        symbols = np.where(self.characters[at] == points, self.ids_of[at], self.size).astype(np.int32)
        ids, offsets = self.merges.apply(symbols, chars[ends])
        lost = ids == self.size
        if not lost.any():
            return ids, offsets
        raw = [chr(c).encode() for c in points[symbols == self.size].tolist()]  # both are in the order of the text
        width = np.ones(len(ids), np.int64)
        width[lost] = [len(x) for x in raw]
        out = np.repeat(ids, width)
        out[np.repeat(lost, width)] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        moved = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(width, out=moved[1:])
        return out, moved[offsets]

    def chunks(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(chunks, first): the chunks of all texts, and where those of each text begin; markers are written as spaces."""
        raw = [(" " + t.replace(MARKER, " ")).encode() if t else b"" for t in texts]
        text_ends = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(x) for x in raw], out=text_ends[1:])
        joined = b"".join(raw)
        if not joined:
            return pa.array([], pa.binary()), np.zeros(len(texts) + 1, np.int64)
        marks = np.frombuffer(joined, np.uint8) == 0x20
        begins = np.zeros(len(joined), bool)
        if self.local:
            begins[1:] = marks[1:] & ~marks[:-1]
        begins[text_ends[:-1][np.diff(text_ends) > 0]] = True
        starts = np.flatnonzero(begins)
        offsets = np.append(starts, len(joined)).astype(np.int64)
        array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined)])
        return array, np.searchsorted(starts, text_ends)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts."""
        chunks, first = self.chunks(texts)
        slots = self.table.slots(chunks)
        ends = np.zeros(len(slots) + 1, np.int64)
        np.cumsum(self.table.counts[slots], out=ends[1:])
        return np.split(self.table.spread(slots), ends[first[1:-1]])

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: one marker in front is dropped, bytes that are no UTF-8 become U+FFFD each."""
        out, run, bare = [], bytearray(), True
        for i in ids:
            if i in self.value_of_byte:
                run.append(self.value_of_byte[i])
                continue
            out.append(_lenient(run))
            bare = bare and not any(out)
            run.clear()
            piece = self.surfaces[i].decode()
            if bare and piece.startswith(" ") and self.surfaces[i] != b" \xe2\x81\x87 ":
                piece, bare = piece[1:], False
            out.append(piece)
        out.append(_lenient(run))
        return "".join(out)

    def _render(self) -> None:
        """Write and read the ids of the chunks that are new in the table."""
        at = len(self._written)
        if at < len(self.table.counts):
            begin = self.table.starts[at]
            ids = self.table.ids[begin:].tolist()
            written, read = [str(i).encode() for i in ids], [self.surfaces[i] for i in ids]
            starts = self.table.starts[at:] - begin
            for a, b in zip(starts.tolist(), (starts + self.table.counts[at:]).tolist(), strict=True):
                self._written.append(b",".join(written[a:b]))
                self._read.append(b"".join(read[a:b]))

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """(number of ids, digest of the ids, digest of the decoded text) of texts."""
        chunks, first = self.chunks(texts)
        slots = self.table.slots(chunks)
        if self._age != self.table.age:
            self._age, self._written, self._read = self.table.age, [], []
        self._render()
        counts = np.zeros(len(slots) + 1, np.int64)
        np.cumsum(self.table.counts[slots], out=counts[1:])
        written, read, of_ids, of_text = self._written, self._read, [], []
        listed = slots.tolist()
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            mine = listed[a:b]
            of_ids.append(hashlib.sha256(b",".join([written[s] for s in mine])).hexdigest())
            of_text.append(hashlib.sha256(b"".join([read[s] for s in mine])[1:]).hexdigest())
        return np.diff(counts[first]).tolist(), of_ids, of_text


def _lenient(run: bytearray) -> str:
    """Bytes as UTF-8, each one that fits into no character as U+FFFD."""
    out, at = [], 0
    while at < len(run):
        for n in (4, 3, 2, 1):
            try:
                out.append(bytes(run[at : at + n]).decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def read_pieces(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id of a model file; an error unless it is a BPE model that leaves text as it is."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    t, n = model.trainer_spec, model.normalizer_spec
    plain = n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not n.precompiled_charsmap
    if t.model_type != t.BPE or not t.byte_fallback or not plain or t.treat_whitespace_as_suffix:
        raise ValueError("not a BPE model with byte fallback and without normalisation")
    p = SentencePieceProcessor(model_file=path)
    if any(p.is_unused(i) for i in range(p.get_piece_size())) or any(x.type == x.USER_DEFINED for x in model.pieces):
        raise ValueError("unused and user-defined pieces are not supported")
    kind = lambda i: "unknown" if p.is_unknown(i) else "control" if p.is_control(i) else "byte" if p.is_byte(i) else "normal"
    return [(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.get_piece_size())]


def broadcast_codec(spark: SparkSession, path: str) -> Broadcast:
    """The codec of a model file that the driver can read, for all executors."""
    return spark.sparkContext.broadcast(PieceCodec(read_pieces(path)))


def encode_documents(documents: DataFrame, codec: Broadcast, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and ``ids``, the ids of each text."""
    source = documents.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [x.tolist() for x in codec.value.encode(strings(batch.column(1)))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["__id", "ids"])

    return arrow_map(source, "__text", run, f"__id {dict(source.dtypes)['__id']}, ids array<int>", BATCH).withColumnRenamed("__id", id_column)


def decode_ids(encoded: DataFrame, codec: Broadcast, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``id_column`` and ``decoded``, the text that the ids stand for; null ids count as none."""
    source = encoded.select(F.col(id_column).alias("__id"), F.col(ids_column).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = [codec.value.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], names=["__id", "decoded"])

    return source.mapInArrow(run, f"__id {dict(source.dtypes)['__id']}, decoded string").withColumnRenamed("__id", id_column)


def encode_digests(documents: DataFrame, codec: Broadcast, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document the number of ids, their digest and that of the text they decode to, in one pass."""
    source = documents.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, of_ids, of_text = codec.value.digests(strings(batch.column(1)))
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["__id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"__id {dict(source.dtypes)['__id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(source, "__text", run, schema, BATCH).withColumnRenamed("__id", id_column)
