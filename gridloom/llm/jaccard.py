"""N-gram Jaccard self-join and its connected components.

A document is the set of its distinct shingles of ``SIZE`` words.  Two documents
are linked when 100 * |intersection| >= ``PERCENT`` * |union|.  The join finds all
links that matter for components, without ever listing the pairs of a group of
copies:

1. Documents with equal sets form a class; only the smallest goes on.
2. Shingles are ordered from the rarest on, by a frequency sketch over all
   documents.  Two linked documents share a shingle within their prefixes, so
   only prefix rows are shuffled.
3. Star rounds: in each bucket of a shingle the most central document, the one whose
   prefix is the most frequent elsewhere, is the hub; every document is compared
   with the hub that it shares most prefix shingles with.  That joins nearly all of
   a group of near copies to their origin at the cost of one comparison a document.
   The second round does so for documents that are not in the largest component of
   a bucket yet, with the most central one in it.
4. Exact round: buckets whose documents are still in different components give every
   pair across components (pairs within one are settled).  Both sides of a bucket are
   dealt into parts of some ``ROWS_A_CELL`` rows, and each pair of parts is a task of
   its own, so a frequent shingle is not gathered.
5. Candidates pass the length, the positional and the suffix filter, are made
   unique, and are verified once on whole sets.

Hubs and counts of a bucket are aggregates and are joined back, so a shingle that
very many documents share is not gathered in one task.

Defined results: a null or empty text has no shingles and no links; a text of fewer
words than a shingle is one shingle; rows without an id link with nothing and have no
component; rows with one id are one document to the links; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import staged, unstage
from gridloom.llm.components import components
from gridloom.llm.sketch import at_least_one, bits_for, level_of, levels, marked, merged_sketch
from gridloom.llm.textops import WORD_BASE, Words, chunks, mix, spans_hash

SIZE = 5
PERCENT = 80
#: Most bits of the frequency sketch (four bits a cell: 64 MB) and of the filter of ids.
FREQUENCY_BITS, ID_BITS = 27, 27
#: Bytes of text for each cell of the frequency sketch: some two shingles.
BYTES_A_CELL = 13
#: Parts of a shingle's hash range whose counts bound an overlap, and the largest set that they are used for (counts are 16-bit).
PARTS, MOST_IN_PARTS = 128, 32767
#: Sets that a task remembers in order to send equal ones once: some 25 MB.
SEEN = 1 << 17
#: Rows of one bucket that meet in one task on either side of the exact round.
ROWS_A_CELL = 512


class Shingles:
    """The distinct shingles of a batch: ``hashes`` of text d are those where ``text == d``, ascending."""

    def __init__(self, texts: pa.Array, size: int = SIZE):
        words = Words(texts, lower=True)
        lane = words.hashes(0)
        start, text = words.windows(size)
        every = words.window_hashes(size, start, 0, lane)
        short = np.flatnonzero((words.counts > 0) & (words.counts < size))
        if len(short):
            first = words.first[:-1][short]
            whole = mix(spans_hash(lane, first, first + words.counts[short], WORD_BASE[0]) + words.counts[short].astype(np.uint64))
            every, text = np.concatenate([every, whole]), np.concatenate([text, short])
        order = np.lexsort((every, text))
        every, text = every[order], text[order]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]) | (text[1:] != text[:-1])
        self.hashes, self.text = every[new], text[new]
        self.edges = np.searchsorted(self.text, np.arange(len(words) + 1))
        self.counts = np.diff(self.edges)

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit lanes that equal sets share; 0 for an empty set."""
        lanes = []
        for salt in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
            total = np.zeros(len(self.hashes) + 1, np.uint64)
            np.cumsum(mix(self.hashes ^ np.uint64(salt)), out=total[1:])
            lanes.append((total[self.edges[1:]] - total[self.edges[:-1]]).view(np.int64))
        return lanes[0], lanes[1]

    def parts(self) -> np.ndarray:
        """Of each text how many hashes lie in each of PARTS parts of their range."""
        of = (self.hashes >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64)
        return np.bincount(self.text * PARTS + of, minlength=len(self.counts) * PARTS).reshape(-1, PARTS)


def needed_overlap(a: F.Column, b: F.Column, percent: int) -> F.Column:
    """The smallest intersection of linked sets of sizes a and b."""
    return F.ceil((a + b) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def _fits(percent: int, x: str, y: str, before: str = "pos") -> F.Column:
    """Length and positional filter of a common prefix shingle at places pos_x and pos_y.

    Of what lies before it, at most ``before`` shingles of either can be common.
    """
    nx, ny, px, py, bx, by = (F.col(f"{c}_{s}") for c in ("n", "pos", before) for s in (x, y))
    most = F.least(bx, by) + 1 + F.least(nx - px - 1, ny - py - 1)
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (most >= needed_overlap(nx, ny, percent))


def _overlap_possible(percent: int, x: str, y: str) -> F.Column:
    """Suffix filter: what the parts of the hash range can have in common is enough for a link, or the sets are too large to tell."""
    most = F.aggregate(F.zip_with(f"parts_{x}", f"parts_{y}", lambda a, b: F.least(a, b)), F.lit(0), lambda s, a: s + a)
    large = F.greatest(f"n_{x}", f"n_{y}") > MOST_IN_PARTS
    return large | (most >= needed_overlap(F.col(f"n_{x}"), F.col(f"n_{y}"), percent))


def document_sets(source: DataFrame, size: int) -> DataFrame:
    """(id, n, s1, s2, parts) of every document of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = Shingles(part.column(1), size)
                s1, s2 = sets.signatures()
                parts = pa.array(np.minimum(sets.parts(), MOST_IN_PARTS).astype(np.int16).tolist(), pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets.counts), pa.array(s1), pa.array(s2), parts], names=["id", "n", "s1", "s2", "parts"])

    return source.mapInArrow(run, "id long, n long, s1 long, s2 long, parts array<smallint>")


def prefixes(source: DataFrame, size: int, percent: int, texts_size: int) -> DataFrame:
    """(token, id, n, pos, central): the prefix shingles of each document, the rarest first.

    ``central`` adds up how frequent they are.  Of equal sets in one task, one
    document is enough.
    """
    bits = min(FREQUENCY_BITS, max(12, (texts_size // BYTES_A_CELL).bit_length()))

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in chunks(batch, "text"):
            yield Shingles(part.column(0), size).hashes

    counters = merged_sketch(source.select("text"), hashes, bits, 65535, levels, rows=1)[0]
    shared = source.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = Shingles(part.column(1), size)
                estimate = level_of(shared.value, sets.hashes, bits)
                order = np.lexsort((sets.hashes, estimate, sets.text))
                token, estimate, text = sets.hashes[order], estimate[order], sets.text[order]
                pos = np.arange(len(token)) - sets.edges[:-1][text]
                n = sets.counts
                length = n - (percent * n + 99) // 100 + 1
                s1, s2 = (x.tolist() for x in sets.signatures())
                first = np.ones(len(n), bool)
                for d, key in enumerate(zip(s1, s2, n.tolist(), strict=True)):
                    first[d] = key not in seen
                    seen.add(key)
                if len(seen) > SEEN:
                    seen.clear()
                inside = pos < length[text]
                central = np.bincount(text[inside], weights=estimate[inside], minlength=len(n)).astype(np.int32)
                take = np.flatnonzero(inside & first[text] & (estimate > 0))
                owner = text[take]
                out = pa.RecordBatch.from_arrays(
                    [pa.array(token[take].view(np.int64)), pa.array(np.asarray(part.column(0))[owner]), pa.array(n[owner].astype(np.int32)), pa.array(pos[take].astype(np.int32)), pa.array(central[owner])],
                    names=["token", "id", "n", "pos", "central"],
                )
                for at in range(0, out.num_rows, 1 << 16):
                    yield out.slice(at, 1 << 16)

    return source.mapInArrow(run, "token long, id long, n int, pos int, central int")


def verified(pairs: DataFrame, source: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are linked.

    Only the sets of documents in a pair are built and moved: a filter of their
    ids, of bounded size, lets some others through and misses none.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    bits = bits_for(ids.count(), ID_BITS)

    def id_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield mix(np.asarray(batch.column(0)).view(np.uint64))

    bitmaps = merged_sketch(ids, id_hashes, bits, 1, at_least_one)
    shared = source.sparkSession.sparkContext.broadcast(bitmaps)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hit = marked(shared.value, mix(np.asarray(batch.column(0)).view(np.uint64)), bits)
            for part in chunks(batch.filter(pa.array(hit)), "text"):
                sets = Shingles(part.column(1), size)
                packed = [sets.hashes[a:b].tobytes() for a, b in zip(sets.edges[:-1], sets.edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["id", "set"])

    sets = staged(source.mapInArrow(build, "id long, set binary").where(F.length("set") > 0))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    for end in ("a", "b"):
        pairs = pairs.join(sets.withColumnsRenamed({"id": end, "set": f"set_{end}"}), end)
    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long")


def links(source: DataFrame, sets: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between classes that connect all that any links connect, as (a, b).

    ``members`` maps every document to the first of its class.
    """
    texts_size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = staged(prefixes(source, size, percent, texts_size))
    with_parts = staged(sets.join(members.where("id = first").select("id").distinct(), "id", "left_semi").select("id", "parts"))
    hub = F.max(F.struct("central", (-F.col("id")).alias("i"), "n", "pos")).alias("h")

    def shared(on: DataFrame) -> DataFrame:
        """``rows`` with the hub of their bucket."""
        hubs = on.select("token", (-F.col("h.i")).alias("id_hub"), F.col("h.n").alias("n_hub"), F.col("h.pos").alias("pos_hub"), F.col("h.central").alias("central_hub"))
        return rows.join(hubs, "token")

    def survivors(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, n_a, n_b) that pass the suffix filter."""
        for end in ("a", "b"):
            pairs = pairs.join(with_parts.withColumnsRenamed({"id": end, "parts": f"parts_{end}"}), end)
        return pairs.where(_overlap_possible(percent, "a", "b")).select("a", "b")

    def ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
        """Pairs as (a, b, n_a, n_b) with a < b, each once."""
        swap = F.col(f"id_{x}") > F.col(f"id_{y}")
        pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
        return pairs.where(F.col(f"id_{x}") != F.col(f"id_{y}")).select(
            *[pick(f"{c}_{x}", f"{c}_{y}").alias(f"{c}_a") for c in ("id", "n")], *[pick(f"{c}_{y}", f"{c}_{x}").alias(f"{c}_b") for c in ("id", "n")]
        ).withColumnsRenamed({"id_a": "a", "id_b": "b"}).distinct()

    def star(with_hub: DataFrame) -> DataFrame:
        """The best hub of each document, as pairs (a, b, n_a, n_b)."""
        near = with_hub.where("id <> id_hub").withColumnsRenamed({"n": "n_id", "pos": "pos_id"}).where(_fits(percent, "id", "hub"))
        near = near.groupBy("id", "id_hub", "n_id", "n_hub", "central_hub").agg(F.count("*").alias("common"))
        best = near.groupBy("id").agg(F.max(F.struct("common", "central_hub", (-F.col("id_hub")).alias("i"), "n_id", "n_hub")).alias("m"))
        return best.select("id", (-F.col("m.i")).alias("id_hub"), F.col("m.n_id").alias("n_id"), F.col("m.n_hub").alias("n_hub"))

    # buckets of one document are dropped; the others get their hub
    buckets = staged(rows.groupBy("token").agg(F.count("*").alias("here"), hub).where("here > 1").select("token", "h"))
    rows = staged(shared(buckets))
    first = star(rows).join(members.distinct(), "id").select(F.col("first").alias("id_x"), F.col("n_id").alias("n_x"), "id_hub", F.col("n_hub").alias("n_y"))
    first = first.join(members.select(F.col("id").alias("id_hub"), F.col("first").alias("id_y")).distinct(), "id_hub")
    tried = staged(survivors(ordered(first, "x", "y")))
    found = staged(verified(tried, source, size, percent))

    def placed() -> DataFrame:
        """Rows of buckets with several components: token, id (first of its class), n, pos, before, central, c."""
        group = components(found)
        home = members.distinct().join(group.withColumnsRenamed({"id": "first", "component": "c"}), "first", "left").select("id", "first", F.coalesce("c", "first").alias("c"))
        here = staged(rows.select("token", "id", "n", "pos", "central").join(home, "id").drop("id").withColumnRenamed("first", "id"))
        mixed = staged(here.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("token"))
        every = here
        here = here.join(mixed, "token", "left_semi").groupBy("token", "id", "n", "pos", "c").agg(F.max("central").alias("central"))
        # only shingles of mixed buckets can be common to two components
        here = staged(here.withColumn("before", F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1))
        sizes = here.groupBy("token", "c").agg(F.count("*").alias("count"), hub)
        main = sizes.groupBy("token").agg(F.max(F.struct("count", "c", "h")).alias("m"), F.sum("count").alias("all"))
        parts = [F.ceil(n / ROWS_A_CELL).cast("int").alias(name) for n, name in ((F.col("m.count"), "in_parts"), (F.col("all") - F.col("m.count"), "out_parts"))]
        main = staged(main.select("token", F.col("m.c").alias("main"), F.col("m.h").alias("h"), *parts))
        out = staged(here.join(main, "token"))
        unstage(group, mixed, every, here, main)
        return out

    rows = placed()
    outside = rows.where("c <> main").select("token", "id", "n", "pos", (-F.col("h.i")).alias("id_hub"), F.col("h.n").alias("n_hub"), F.col("h.pos").alias("pos_hub"), F.col("h.central").alias("central_hub"))
    again = ordered(star(outside).select(F.col("id").alias("id_x"), F.col("n_id").alias("n_x"), F.col("id_hub").alias("id_y"), F.col("n_hub").alias("n_y")), "x", "y")
    again = staged(survivors(again.join(tried, ["a", "b"], "left_anti")))
    found = staged(found.unionByName(verified(again, source, size, percent)))
    tried = tried.unionByName(again)

    # the suffix filter belongs to the join: a pair that it drops makes no row for each shared shingle
    rows = staged(placed().join(with_parts, "id"))
    columns = ("id", "n", "pos", "before", "c", "parts")
    own = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    all_of = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    x = rows.where("c <> main").withColumn("p", own("out_parts")).select("token", "p", "in_parts", "out_parts", *[F.col(c).alias(f"{c}_x") for c in columns])
    largest = rows.where("c = main").withColumn("q", own("in_parts")).select("token", all_of("out_parts").alias("p"), "q", *[F.col(c).alias(f"{c}_y") for c in columns])
    other = x.withColumnsRenamed({f"{c}_x": f"{c}_y" for c in columns} | {"p": "q"}).withColumn("p", all_of("out_parts"))
    ends = ["id_x", "id_y", "n_x", "n_y"]
    fits = _fits(percent, "x", "y", "before") & _overlap_possible(percent, "x", "y")
    cell = ["token", "p", "q"]
    across = x.withColumn("q", all_of("in_parts")).join(largest, cell).where(fits).select(*ends, "pos_x", "pos_y")
    rest = x.withColumn("q", all_of("out_parts")).join(other.drop("in_parts", "out_parts"), cell).where((F.col("c_x") < F.col("c_y")) & fits).select(*ends, "pos_x", "pos_y")
    # nothing common lies before the first common shingle of two prefixes
    pairs = across.unionByName(rest).groupBy(*ends).agg(F.min("pos_x").alias("px"), F.min("pos_y").alias("py"))
    most = F.least(F.col("n_x") - F.col("px"), F.col("n_y") - F.col("py"))
    pairs = ordered(pairs.where(most >= needed_overlap(F.col("n_x"), F.col("n_y"), percent)), "x", "y")
    pairs = staged(pairs.select("a", "b").join(tried, ["a", "b"], "left_anti"))
    return found.unionByName(verified(pairs, source, size, percent))


def similar_components(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Per document: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links (null without an id)."""
    every = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    source = every.where("id IS NOT NULL")
    everything = staged(document_sets(every, size))
    sets = everything.where("id IS NOT NULL")
    classes = staged(sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("first")))
    members = staged(sets.where("n > 0").select("id", "s1", "s2", "n").join(classes, ["s1", "s2", "n"]).select("id", "first"))
    found = links(source, sets.where("n > 0"), members, size, percent)
    same = members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    group = components(found.unionByName(same))
    out = sets.select("id", "n").join(group, "id", "left").unionByName(everything.where("id IS NULL").select("id", "n", F.lit(None).cast("long").alias("component")))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
