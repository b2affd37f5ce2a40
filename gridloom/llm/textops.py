"""Vectorised word and window hashing over Arrow string batches.

Everything here works on the byte buffer of a whole batch at once, so a task
spends its time in numpy rather than in per-word Python.  Words are maximal
runs of bytes other than space and TAB..CR, which is exact on UTF-8 because
those separators are single ASCII bytes.

Hashes come in two independent 64-bit lanes; equal inputs give equal lanes, and
two different inputs agree in both lanes with a chance of about 2**-110.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Separators of words: space and the control characters TAB to CR.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Odd multipliers of the byte-level and of the word-level polynomials, by lane.
BYTE_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_BASE = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

_MASK = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}
#: Powers that a worker keeps of each base: 8 MB.  Those of longer texts are made anew.
MOST_POWERS = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = np.full(size, np.uint64(base), dtype=np.uint64)
        out[0] = 1
        have = np.cumprod(out, dtype=np.uint64)
        if size <= MOST_POWERS:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    """The inverse of an odd base modulo 2**64."""
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the hash depends on all of x."""
    x = x.copy()
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The polynomial hash of values[starts[i]:ends[i]] for every i."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), dtype=np.uint64, out=total[1:])
    out = total[ends] - total[starts]
    out *= powers(inverse(base), len(values) + 1)[starts]
    return out


class Words:
    """The words of a batch of texts: where each lies, and whose it is.

    ``counts[d]`` words of text d are ``starts[first[d]:first[d + 1]]``, as byte
    offsets into ``data``.  A null text has no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        lengths = np.diff(offsets)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and n else np.zeros(0, np.uint8)
        offsets = offsets - (offsets[0] if n else 0)
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        blank = np.ones(len(data) + 2, dtype=bool)
        blank[1:-1] = _SPACE[data]
        begins = ~blank[1:-1] & blank[:-2]
        edges = offsets[1:-1]
        inner = edges[(edges > 0) & (edges < len(data))]
        begins[inner] = ~blank[1:-1][inner]
        self.starts = np.flatnonzero(begins)
        finish = ~blank[1:-1] & blank[2:]
        finish[inner - 1] = ~blank[1:-1][inner - 1]
        self.ends = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        if texts.null_count:
            valid = np.asarray(texts.is_valid())
            assert not lengths[~valid].any() or not self.counts[~valid].any()

    def __len__(self) -> int:
        return len(self.counts)

    def hashes(self, lane: int) -> np.ndarray:
        """A hash of every word."""
        h = spans_hash(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, BYTE_BASE[lane])
        return mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(WORD_BASE[lane]))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, text) of every run of ``size`` words inside one text."""
        n = np.maximum(self.counts - size + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        start = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + self.first[:-1][text]
        return start, text

    def window_hashes(self, size: int, start: np.ndarray, lane: int, words: np.ndarray | None = None) -> np.ndarray:
        """A hash of the ``size`` words from every ``start``."""
        words = self.hashes(lane) if words is None else words
        return mix(spans_hash(words, start, start + size, WORD_BASE[lane]))


def chunks(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text each, one row at least."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not len(texts):
        return
    if pa.types.is_large_string(texts.type):
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)
    else:
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
