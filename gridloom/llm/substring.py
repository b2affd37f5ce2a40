"""Removal of passages repeated from documents with smaller ids.

A window is ``WINDOW`` consecutive words.  The first pass counts windows in a
count-min sketch.  A window is counted under its anchor: of its sub-windows of
``ANCHOR`` words, the one with the smallest hash.  Equal windows have equal anchors
at equal places, so an anchor occurs at least as often as any window it stands
for; merged estimates of anchors are therefore never below the windows' counts,
while neighbouring windows share anchors and the sketch holds some 13 times fewer
entries than there are windows.

The second pass takes only windows that are estimated to be repeated and groups
them exactly, by 128-bit fingerprints of their words, to find the smallest document
of each.  A task first settles repeats among its own rows and sends on only those of
its smallest document, so a passage that a third of all documents share costs one
row a task and no group grows with the number of copies.  What is repeated is then
joined to the texts, where the words covered are removed.

If the sketch is too small for the data, more windows reach the second pass; none
is ever lost.

Defined results: a null text has no words; a document shorter than a window keeps
all its words; a row without an id is compared with nothing and keeps all its words;
of rows with one id, none is smaller than the other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_map, kept_columns
from gridloom.llm.sketch import at_least_two, bits_for, marked, merged_sketch
from gridloom.llm.textops import Words, chunks

WINDOW = 50
ANCHOR = 25
#: Most bits of a row of the sketch; two bitmaps of 2**28 bits are 64 MB.
MOST_BITS = 28
#: Windows that a task gathers before it settles repeats among them.
FLUSH = 1 << 20


def sliding_minimum(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of x[i:i + n] for every i."""
    width = 1
    out = x
    while 2 * width <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    left = n - width
    return np.minimum(out[: len(out) - left], out[left:]) if left else out


def anchors(words: Words, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window its first word, its text and its anchor's hash."""
    start, text = words.windows(window)
    if not len(start):
        return start, text, np.zeros(0, np.uint64)
    grams = words.window_hashes(anchor, np.arange(len(hashes) - anchor + 1), 0, hashes)
    return start, text, sliding_minimum(grams, window - anchor + 1)[start]


def _settled(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Windows of a task: those of its smallest documents, and what is repeated within the task.

    Both kinds have columns k0, k1, id, tid, pos, more.  A window has its first
    place in ``pos`` and further ones of its document in ``more``; repeats found
    here are listed in ``more`` by document, with -1 in ``pos``.
    """
    k0, k1, ids, tid, pos = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((pos, tid, ids, k0))
    k0, k1, ids, tid, pos = k0[order], k1[order], ids[order], tid[order], pos[order]
    new = np.ones(len(k0), bool)
    new[1:] = (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])
    group = np.cumsum(new) - 1
    smallest = ids == ids[np.flatnonzero(new)][group]
    heads = new.copy()
    heads[1:] |= tid[1:] != tid[:-1]
    send, extra = np.flatnonzero(smallest & heads), np.flatnonzero(smallest & ~heads)
    more: list[bytes | None] = [None] * len(send)
    if len(extra):
        owner = np.searchsorted(send, extra, side="right") - 1
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for part in np.split(np.arange(len(extra)), cuts):
            more[owner[part[0]]] = pos[extra[part]].astype(np.int32).tobytes()
    here = np.flatnonzero(~smallest)
    here = here[np.lexsort((pos[here], tid[here], ids[here]))]
    groups = np.split(here, np.flatnonzero(np.diff(tid[here]) | np.diff(ids[here])) + 1) if len(here) else []
    owners = np.array([tid[g[0]] for g in groups], np.int64)
    columns = [
        pa.array(np.concatenate([k0[send].view(np.int64), owners])),
        pa.array(np.concatenate([k1[send].view(np.int64), np.zeros(len(groups), np.int64)])),
        pa.array(np.concatenate([ids[send], np.array([ids[g[0]] for g in groups], np.int64)])),
        pa.array(np.concatenate([tid[send], owners])),
        pa.array(np.concatenate([pos[send].astype(np.int32), np.full(len(groups), -1, np.int32)])),
        pa.array([*more, *[pos[g].astype(np.int32).tobytes() for g in groups]], pa.binary()),
    ]
    whole = pa.RecordBatch.from_arrays(columns, names=["k0", "k1", "id", "tid", "pos", "more"])
    for at in range(0, whole.num_rows, 1 << 16):
        yield whole.slice(at, 1 << 16)


def _source(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text, key = F.col(text_column), F.col(id_column).cast("long")
    return documents.where(key.isNotNull()).select(key.alias("id"), F.xxhash64(key, text).alias("tid"), text.alias("text"))


def repeated_windows(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, most_bits: int = MOST_BITS) -> DataFrame:
    """(id, tid, places, more): by document the first words of windows that a smaller document has too.

    ``tid`` is a hash of id and text, which tells rows with one id apart; ``more`` holds
    further places as packed int32.
    """
    source = _source(documents, id_column, text_column)
    anchor = max(1, window // 2)
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bits_for(size // (3 * anchor), most_bits)

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in chunks(batch, "text"):
            words = Words(part.column(0))
            start, text, least = anchors(words, words.hashes(0), window, anchor)
            if len(start):
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
                yield least[new]

    bitmaps = merged_sketch(source.select("text"), hashes, bits, 2, at_least_two)
    shared = documents.sparkSession.sparkContext.broadcast(bitmaps)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column(2))
                lane = words.hashes(0)
                start, text, least = anchors(words, lane, window, anchor)
                hit = marked(shared.value, least, bits)
                if not hit.any():
                    continue
                start, text = start[hit], text[hit]
                ids, tids = np.asarray(part.column(0)), np.asarray(part.column(1))
                held.append(
                    (words.window_hashes(window, start, 0, lane), words.window_hashes(window, start, 1), ids[text], tids[text], start - words.first[:-1][text])
                )
                size += len(start)
                if size >= FLUSH:
                    yield from _settled(held)
                    held, size = [], 0
        if held:
            yield from _settled(held)

    rows = source.mapInArrow(candidates, "k0 long, k1 long, id long, tid long, pos int, more binary")
    least = F.min(F.when(F.col("pos") >= 0, F.col("id"))).over(Window.partitionBy("k0", "k1"))
    found = rows.withColumn("least", least).where((F.col("pos") < 0) | (F.col("id") > F.col("least")))
    return found.groupBy("id", "tid").agg(F.collect_list("pos").alias("places"), F.collect_list("more").alias("more"))


def _kept(text: str | None, places: list[int] | None, more: list[bytes] | None, window: int) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if places is None:
        return words, len(words)
    starts = np.concatenate([np.array(places, np.int64), *[np.frombuffer(m, np.int32) for m in more]])
    starts = starts[starts >= 0]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return [w for w, c in zip(words, covered.tolist(), strict=True) if not c], len(words)


def remove_repeats(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW, digest: bool = False, most_bits: int = MOST_BITS) -> DataFrame:
    """Per document: id, ``keep``, ``n_words``, ``n_removed`` and ``kept``.

    ``kept`` is the text itself where nothing was removed, else the remaining
    words joined by one space.  With ``digest`` there is ``kept_sha256`` instead,
    of the remaining words joined by one space.
    """
    keep = kept_columns(keep, id_column.lower(), "n_words", "n_removed", "kept", "kept_sha256")
    found = repeated_windows(documents, id_column, text_column, window, most_bits)
    text, key = F.col(text_column), F.col(id_column).cast("long")
    source = documents.select(
        key.alias("id"), *[F.col(c).alias(f"__{k}") for k, c in enumerate(keep)], text.alias("__text"), F.xxhash64(key, text).alias("tid")
    )
    joined = source.where("id IS NOT NULL").join(found, ["id", "tid"], "left")
    alone = source.where("id IS NULL").withColumns({c: F.lit(None).cast(t) for c, t in found.dtypes if c in ("places", "more")})
    joined = joined.unionByName(alone).drop("tid")
    names = [n for n in joined.columns if n not in ("__text", "places", "more")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, out = [], [], []
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for text, places, more in zip(columns["__text"].to_pylist(), columns["places"].to_pylist(), columns["more"].to_pylist(), strict=True):
            words, n = _kept(text, places, more, window)
            n_words.append(n)
            n_removed.append(n - len(words))
            if digest:
                out.append(hashlib.sha256(b" ".join(words)).hexdigest())
            else:
                out.append(text if n == len(words) else b" ".join(words).decode("utf-8", "surrogatepass"))
        return pa.RecordBatch.from_arrays(
            [*[columns[n] for n in names], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())], names=[*names, "n_words", "n_removed", "kept"]
        )

    types = dict(joined.dtypes)
    schema = ", ".join(f"{n} {types[n]}" for n in names) + ", n_words long, n_removed long, kept string"
    out = arrow_map(joined, "__text", run, schema)
    return out.withColumnsRenamed({"id": id_column, **{f"__{k}": c for k, c in enumerate(keep)}, "kept": "kept_sha256" if digest else "kept"})
