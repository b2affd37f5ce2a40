"""Periodic runs of words by naming blocks of power-of-two lengths.

Level 0 names the words of a document; level k names the 2^k words from every position,
by sorting pairs of names of level k - 1.  Equal names mean equal blocks, so how far two
positions agree follows from comparing names from the highest level down.

A run with period p and three periods or more covers two neighbouring points of the grid
0, p, 2p, ... of its document, and both agree over a known number of words from there.
These pairs of points are the candidates, n ln n of a document of n words; one comparison
of names drops nearly all, and the others are extended to both sides.  No hashes of blocks
and no suffix sorting; a batch of documents is treated as one sequence.

There is no shuffle: a document is read by one task.  Memory grows with the words of a
batch of bounded bytes, or of its one longest text, times the levels at which blocks still
repeat; candidates are made for bounded numbers of grid points at a time.

Defined results: null, empty and blank texts have no words and no runs; their digests are
those of the empty string.  A row without an id is not repeated on purpose.  Repeated rows
and ids give a row each; further columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_map
from gridloom.llm.merges import ragged
from gridloom.llm.textops import Words

#: Fewest words of a run, and fewest periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Grid points that are held at once, and bytes of text that a task reads at once.
MOST_POINTS, BATCH = 1 << 20, 1 << 20


@dataclass
class Names:
    """Names of blocks of a sequence of documents: ``levels[k][i]`` names the 2^k words from i.

    Only blocks inside a document have comparable names; others and blocks that occur once
    have a name of their own.
    """

    levels: list[np.ndarray]
    #: End of the document of every word.
    end: np.ndarray
    #: Start of the document of every word.
    begin: np.ndarray

    def agree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j, i < j in one document, are equal."""
        total = np.zeros(len(i), np.int64)
        limit = self.end[j] - j
        for k in range(len(self.levels) - 1, -1, -1):
            step = 1 << k
            name = self.levels[k]
            while True:  # the highest level can fit several times
                room = np.flatnonzero(total + step <= limit)
                room = room[name[i[room] + total[room]] == name[j[room] + total[room]]]
                total[room] += step
                if k < len(self.levels) - 1 or not len(room):
                    break
        return total

    def agree_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j, i < j in one document, are equal."""
        total = np.zeros(len(i), np.int64)
        limit = i - self.begin[j]
        for k in range(len(self.levels) - 1, -1, -1):
            step = 1 << k
            name = self.levels[k]
            while True:
                room = np.flatnonzero(total + step <= limit)
                room = room[name[i[room] - total[room] - step] == name[j[room] - total[room] - step]]
                total[room] += step
                if k < len(self.levels) - 1 or not len(room):
                    break
        return total


def name_blocks(words: np.ndarray, first: np.ndarray) -> Names:
    """Names of all blocks of documents, whose words are numbered; document d is words[first[d]:first[d + 1]]."""
    n, counts = len(words), np.diff(first)
    document = np.repeat(np.arange(len(counts)), counts)
    names = Names([], first[1:][document], first[:-1][document])
    key = document * (np.int64(words.max(initial=0)) + 1) + words
    active, k = np.arange(n), 0
    while True:
        _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        level = np.arange(n, dtype=np.int64) + n  # a name of its own
        level[active[again]] = inverse[again]
        names.levels.append(level)
        active = active[again]
        step = 1 << k
        active = active[active + 2 * step <= names.end[active]]
        if not len(active):
            return names
        key = level[active] * (2 * n) + level[active + step]
        k += 1


def find_runs(words: np.ndarray, first: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and then period; positions are those of ``words``."""
    names = name_blocks(words, first)
    counts = np.diff(first)
    found = []
    most_period = counts // least_periods
    for period, document in _grids(counts, most_period):
        points = (counts[document] - 1) // period  # pairs of neighbours on the grid
        of = np.repeat(np.arange(len(period)), points)
        p = period[of]
        i = first[document][of] + ragged(np.zeros(len(points), np.int64), points) * p
        # from the first grid point in a run at least so many words agree with those one period on
        sure = np.maximum(least_words, least_periods * p) - 2 * p + 1
        level = np.minimum(np.log2(np.maximum(sure, 1)).astype(np.int64), len(names.levels) - 1)
        keep = np.zeros(len(i), bool)
        for k in np.unique(level):
            some = np.flatnonzero(level == k)
            some = some[i[some] + p[some] + (1 << k) <= names.end[i[some]]]
            keep[some] = names.levels[k][i[some]] == names.levels[k][i[some] + p[some]]
        i, p = i[keep], p[keep]
        start = i - names.agree_before(i, i + p)
        end = i + p + names.agree(i, i + p)
        long = end - start >= np.maximum(least_words, least_periods * p)
        found.append(_once(np.stack([start[long], end[long], p[long]])))
    runs = _once(np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64))
    start, end, period = runs[:, np.lexsort((runs[2], runs[0]))]
    return start, end, period


def _once(runs: np.ndarray) -> np.ndarray:
    """Each (start, end) with its smallest period: a run is found at each of its grid points and with multiples of its period."""
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    new = np.ones(runs.shape[1], bool)
    new[1:] = (runs[:2, 1:] != runs[:2, :-1]).any(axis=0)
    return runs[:, new]


def _grids(counts: np.ndarray, most_period: np.ndarray):
    """(periods, documents) whose grids have MOST_POINTS points together, or are one grid."""
    longest = int(most_period.max(initial=0))
    by_length = np.argsort(-most_period, kind="stable")
    having = np.searchsorted(-most_period[by_length], -np.arange(1, longest + 1), side="right")  # documents with each period
    whole = np.cumsum(counts[by_length])
    pending, size = [], 0
    for p in range(1, longest + 1):
        docs = by_length[: having[p - 1]]
        pending.append((p, docs))
        size += int(whole[having[p - 1] - 1]) // p
        if size >= MOST_POINTS or p == longest:
            yield np.repeat([q for q, _ in pending], [len(d) for _, d in pending]), np.concatenate([d for _, d in pending])
            pending, size = [], 0


def repeated_on_purpose(ids: list[int | None], first: np.ndarray) -> np.ndarray:
    """Which word stands at every position, after documents with a hash divisible by ten are made periodic from some word on."""
    source = np.arange(first[-1])
    for d, i in enumerate(ids):
        begin, n = int(first[d]), int(first[d + 1] - first[d])
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n > 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[begin + a : begin + n] = begin + a + np.arange(n - a) % p
    return source


def runs_of_batch(ids: list[int | None], texts: pa.Array) -> dict[str, list]:
    """The result columns of a batch of documents."""
    words = Words(texts)
    source = repeated_on_purpose(ids, words.first)
    ends = np.append(words.starts, 0)[:-1]
    lengths = words.ends - ends
    raw = words.data[ragged(words.starts, lengths)].tobytes()
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    spelled = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
    numbers = np.asarray(spelled.dictionary_encode().indices, np.int64)[source]
    start, end, period = find_runs(numbers, words.first)

    dropped = np.zeros(len(source) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, end, -1)
    kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0)
    spaced = np.full(int((lengths[source[kept]] + 1).sum()), 0x20, np.uint8)  # every kept word and a space
    width = lengths[source[kept]]
    at = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(width + 1, out=at[1:])
    spaced[ragged(at[:-1], width)] = words.data[ragged(words.starts[source[kept]], width)]
    text_at = at[np.searchsorted(kept, words.first)]

    run_at = np.searchsorted(start, words.first)
    out: dict[str, list] = {c: [] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
    for d in range(len(ids)):
        mine = range(int(run_at[d]), int(run_at[d + 1]))
        rows = [(int(start[r] - words.first[d]), int(end[r] - start[r]), int(period[r])) for r in mine]
        best = None
        for r in rows:  # the greatest length / period, compared without division; the first of equals
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        out["n_runs"].append(len(rows))
        for k, c in enumerate(("start", "length", "period")):
            out[c].append(best[k] if best else None)
        out["exponent_milli"].append(1000 * best[1] // best[2] if best else None)
        out["runs_sha256"].append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in rows).encode()).hexdigest())
        out["collapsed_sha256"].append(hashlib.sha256(spaced[text_at[d] : max(text_at[d], text_at[d + 1] - 1)].tobytes()).hexdigest())
    return out


def periodic_runs(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document its number of runs, the run of most periods, and digests of all runs and of the text without repeats."""
    source = documents.select(F.col(id_column).alias("__id"), F.col(text_column).alias("__text"))
    kinds = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = runs_of_batch(batch.column(0).to_pylist(), batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[c], t) for c, t in kinds.items()]], names=["__id", *kinds])

    schema = f"__id {dict(source.dtypes)['__id']}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return arrow_map(source, "__text", run, schema, BATCH).withColumnRenamed("__id", id_column)
