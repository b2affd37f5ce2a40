"""Byte-pair merges of many chunks at once, and a table of chunks already segmented.

A chunk is a piece of text that merges cannot leave.  Chunks of up to 32 symbols are
merged together in numpy: one column a chunk, and in every round each chunk merges its
best pair.  Longer chunks go through a heap over linked symbols, in O(n log n) steps.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Numbers of symbols up to which chunks share a matrix; longer ones take the heap.
WIDTHS = (4, 8, 16, 32)
_POSITIONS = 64
_NONE = np.int64(1) << 40
#: Chunks and ids that a task keeps before its table starts anew: some 100 MB.
MOST_CHUNKS, MOST_IDS = 1 << 19, 1 << 22


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + counts[i] - 1 of every i, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Merges:
    """Pairs of symbols (left, right) that merge into a symbol; the smallest rank goes first, then the leftmost.

    Symbols are numbers from 0 to ``size`` - 1; ``size`` itself stands for a symbol that never merges.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, size: int):
        self.size, self.stride = size, size + 1
        key = left.astype(np.int64) * self.stride + right
        bits = max(4, int(4 * len(key)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks, self.results = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        todo = np.arange(len(key))
        slot = self._slot(key)
        while len(todo):  # linear probing, all keys a step at a time; the first to claim a free slot has it
            free = self.keys[slot] < 0
            claimed, first = np.unique(slot[free], return_index=True)
            winners = np.flatnonzero(free)[first]
            at = todo[winners]
            self.keys[claimed], self.ranks[claimed], self.results[claimed] = key[at], rank[at], merged[at]
            lost = np.ones(len(todo), bool)
            lost[winners] = False
            todo, slot = todo[lost], (slot[lost] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged) of pairs; the rank is _NONE where a pair does not merge."""
        key = left.astype(np.int64) * self.stride + right
        slot = self._slot(key)
        there = self.keys[slot]
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            open_ = open_[(there != key[open_]) & (there >= 0)]
        return np.where(self.keys[slot] == key, self.ranks[slot].astype(np.int64), _NONE), self.results[slot]

    def one(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols that one chunk is merged into, by a heap."""
        n = len(symbols)
        ids = symbols.tolist()
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # ends[i] is -1 once symbol i is merged away
        rank, merged = (x.tolist() for x in self.find(symbols[:-1], symbols[1:])) if n > 1 else ([], [])
        heap = [(r, i, i + 1, i + 2, m) for i, (r, m) in enumerate(zip(rank, merged, strict=True)) if r < _NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def offer(i: int, mid: int, end: int) -> None:
            pair = ids[i], ids[mid]
            if pair not in known:
                r, m = self.find(np.array(pair[:1]), np.array(pair[1:]))
                known[pair] = int(r[0]), int(m[0])
            if known[pair][0] < _NONE:
                heapq.heappush(heap, (known[pair][0], i, mid, end, known[pair][1]))

        while heap:
            _, i, mid, end, m = heapq.heappop(heap)
            if ends[i] != mid or ends[mid] != end:
                continue  # one of the two symbols has changed since
            ids[i], ends[i], ends[mid] = m, end, -1
            if end < n:
                before[end] = i
                offer(i, end, ends[end])
            if before[i] >= 0:
                offer(before[i], i, end)
        return np.array([x for x, e in zip(ids, ends, strict=True) if e >= 0], np.int32)

    def apply(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, offsets) of all chunks after merging; chunk i is symbols[offsets[i]:offsets[i + 1]]."""
        lengths = np.diff(offsets)
        parts, owners, low = [symbols[offsets[:-1][lengths == 1]]], [np.flatnonzero(lengths == 1)], 1
        for width in WIDTHS:
            at = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for some in np.array_split(at, len(at) // (1 << 15) + 1):
                if len(some):
                    ids, counts = self._together(symbols, offsets[some], lengths[some], width)
                    parts.append(ids)
                    owners.append(np.repeat(some, counts))
        for i in np.flatnonzero(lengths > low):
            ids = self.one(symbols[offsets[i] : offsets[i + 1]])
            parts.append(ids)
            owners.append(np.full(len(ids), i))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        out = np.zeros(len(offsets), np.int64)
        np.cumsum(np.bincount(owner, minlength=len(lengths)), out=out[1:])
        return np.concatenate(parts)[order].astype(np.int32), out

    def _together(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, number of symbols by chunk) of chunks of at most ``width`` symbols."""
        n = len(starts)
        row = np.arange(width)[:, None]
        alive = row < lengths
        ids = np.full((width + 1, n), self.size, np.int32)  # one row below the last, for what ends a chunk
        ids[:-1][alive] = symbols[(starts + row)[alive]]
        best, into = self.find(ids[:-1].ravel(), ids[1:].ravel())
        best = np.where(best < _NONE, best * _POSITIONS + np.repeat(np.arange(width), n), _NONE).reshape(width, n)
        into = into.reshape(width, n).copy()
        after = np.repeat((np.arange(width) + 1)[:, None], n, axis=1)
        before = np.repeat((np.arange(width + 1) - 1)[:, None], n, axis=1)
        todo = np.arange(n)
        while len(todo):
            least = best[:, todo].min(axis=0) if len(todo) < n else best.min(axis=0)
            more = least < _NONE
            todo = todo[more]
            at = least[more] % _POSITIONS
            gone = after[at, todo]
            follows = np.where(gone < width, after[np.minimum(gone, width - 1), todo], width)
            merged = into[at, todo]
            ids[at, todo] = merged
            alive[gone, todo] = False
            best[gone, todo] = _NONE
            after[at, todo] = follows
            before[follows, todo] = at
            rank, result = self.find(merged, ids[follows, todo])
            best[at, todo] = np.where((rank < _NONE) & (follows < width), rank * _POSITIONS + at, _NONE)
            into[at, todo] = result
            has = before[at, todo] >= 0
            left, cols = before[at, todo][has], todo[has]
            rank, result = self.find(ids[left, cols], merged[has])
            best[left, cols] = np.where(rank < _NONE, rank * _POSITIONS + left, _NONE)
            into[left, cols] = result
        return ids[:-1].T[alive.T], alive.sum(axis=0)


class ChunkTable:
    """The ids of every distinct chunk that a task has met: each is segmented once.

    ``segment`` maps an array of distinct chunks to (ids, offsets).  The table is emptied
    when it holds MOST_CHUNKS chunks or MOST_IDS ids, so its memory has a bound; ``age``
    counts how often that has happened, for tables that a caller keeps beside it.
    """

    def __init__(self, segment: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.segment, self.age = segment, -1
        self._clear()

    def _clear(self) -> None:
        self.age += 1
        self.slot: dict[bytes, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def slots(self, chunks: pa.Array) -> np.ndarray:
        """Of every chunk its row in ``starts`` and ``counts``; call it once a batch, as it may empty the table."""
        if len(self.slot) > MOST_CHUNKS or len(self.ids) > MOST_IDS:
            self._clear()
        coded = chunks.dictionary_encode()
        known, get = coded.dictionary.to_pylist(), self.slot.get
        at = np.fromiter((get(x, -1) for x in known), np.int64, len(known))
        new = np.flatnonzero(at < 0)
        if len(new):
            ids, offsets = self.segment(coded.dictionary.take(pa.array(new)))
            at[new] = np.arange(len(self.slot), len(self.slot) + len(new))
            self.slot.update(zip([known[i] for i in new.tolist()], at[new].tolist(), strict=True))
            self.starts = np.concatenate([self.starts, offsets[:-1] + len(self.ids)])
            self.counts = np.concatenate([self.counts, np.diff(offsets)])
            self.ids = np.concatenate([self.ids, ids])
        return at[np.asarray(coded.indices, np.int64)]

    def spread(self, slots: np.ndarray) -> np.ndarray:
        """The ids of chunks, one after the other: joined back by position."""
        return self.ids[ragged(self.starts[slots], self.counts[slots])]
