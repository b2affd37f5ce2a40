"""Count-min sketches of 64-bit hashes, built in partitions and merged by Spark.

A sketch has ``ROWS`` rows of 2**bits saturating counters.  Each partition counts
its own hashes and emits only cells that are not zero, by blocks of cells; the
blocks are dealt over tasks, which add them up one after another in memory of one
block.  Merged counts never fall below the true ones (up to saturation), so a
filter on them keeps whatever it should keep.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 2
#: Cells of a block, as a power of two, and hashes that a partition gathers before it emits.
BLOCK_BITS = 17
FLUSH = 1 << 21
_SPREAD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_SCHEMA = pa.schema([("block", pa.int32()), ("cells", pa.binary())])


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch."""
    return ((hashes * _SPREAD[row]) >> np.uint64(64 - bits)).astype(np.int64)


def _packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted cells and their counts, as compressed differences."""
    return zstandard.compress(np.diff(ids, prepend=0).astype(np.uint32).tobytes() + counts.astype(np.uint16).tobytes(), 1)


def partition_sketch(hashes: np.ndarray, rows: int, bits: int, most: int) -> pa.RecordBatch:
    """The blocks of the sketch of some hashes."""
    block_bits = min(bits, BLOCK_BITS)
    blocks, out = [], []
    for row in range(rows):
        ids, counts = np.unique(cells(hashes, row, bits), return_counts=True)
        counts = np.minimum(counts, most)
        edges = np.searchsorted(ids, np.arange((1 << bits - block_bits) + 1) << block_bits)
        for b in np.flatnonzero(np.diff(edges)):
            part = slice(edges[b], edges[b + 1])
            blocks.append(row << (bits - block_bits) | int(b))
            out.append(_packed(ids[part] - (int(b) << block_bits), counts[part]))
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(out, pa.binary())], schema=_SCHEMA)


def merged_sketch(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, most: int, finish: Callable[[np.ndarray], np.ndarray], rows: int = ROWS) -> list[np.ndarray]:
    """The rows of the merged sketch of ``hashes_of`` every batch of ``df``.

    Counters stop at ``most``; ``finish`` makes of a block's counters what is
    kept of them.  The result has a size set by ``rows`` and ``bits`` alone.
    """
    block_bits = min(bits, BLOCK_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for h in hashes_of(batch):
                held.append(h)
                size += len(h)
                if size >= FLUSH:
                    yield partition_sketch(np.concatenate(held), rows, bits, most)
                    held, size = [], 0
        if size:
            yield partition_sketch(np.concatenate(held), rows, bits, most)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = -1, np.zeros(1 << block_bits, np.uint32)
        open_zip = zstandard.ZstdDecompressor()
        done: tuple[list, list] = ([], [])
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != now:
                    if now >= 0:
                        done[0].append(now)
                        done[1].append(finish(total).tobytes())
                    now, total = block, np.zeros(1 << block_bits, np.uint32)
                raw = open_zip.decompress(packed.as_py())
                n = len(raw) // 6
                at = np.cumsum(np.frombuffer(raw, np.uint32, n)).astype(np.int64)
                total[at] = np.minimum(total[at] + np.frombuffer(raw, np.uint16, n, 4 * n), most)
        if now >= 0:
            done[0].append(now)
            done[1].append(finish(total).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int32()), pa.array(done[1], pa.binary())], schema=_SCHEMA)

    parts = df.mapInArrow(count, "block int, cells binary").repartition("block").sortWithinPartitions("block")
    empty = finish(np.zeros(1 << block_bits, np.uint32))
    out = [[empty] * (1 << bits - block_bits) for _ in range(rows)]
    for r in parts.mapInArrow(add, "block int, cells binary").collect():  # one row a block
        row, b = divmod(r["block"], 1 << bits - block_bits)
        out[row][b] = np.frombuffer(r["cells"], empty.dtype)
    return [np.concatenate(x) for x in out]


def at_least_two(counts: np.ndarray) -> np.ndarray:
    """One bit a cell: whether it counted two or more."""
    return np.packbits(counts >= 2, bitorder="little")


def levels(counts: np.ndarray) -> np.ndarray:
    """Four bits a cell: the power of two that its count reaches, 0 for none or one."""
    level = np.minimum(np.log2(np.maximum(counts, 1)), 15).astype(np.uint8)
    return level[::2] | level[1::2] << 4


def level_of(packed: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """The level of each hash in a sketch of one row."""
    c = cells(hashes, 0, bits)
    return packed[c >> 1] >> ((c & 1) << 2).astype(np.uint8) & 15


def at_least_one(counts: np.ndarray) -> np.ndarray:
    """One bit a cell: whether it counted anything."""
    return np.packbits(counts >= 1, bitorder="little")


def marked(bitmaps: list[np.ndarray], hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bits of each hash are set in all rows."""
    out = np.ones(len(hashes), bool)
    for row, bitmap in enumerate(bitmaps):
        c = cells(hashes, row, bits)
        out &= (bitmap[c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
    return out


def bits_for(expected: int, most: int) -> int:
    """Bits of a row with about eight cells for each expected hash, ``most`` at most."""
    return min(most, max(12, int(8 * max(1, expected)).bit_length()))
