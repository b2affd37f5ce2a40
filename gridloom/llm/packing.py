"""Conflict-constrained best-fit packing of documents into bins.

A bin holds ``capacity`` words.  A document longer than that fills bins of its
own with whole pieces; what is left over is packed like a short document.  Inside
a block, pieces are placed from the longest down.  Open bins are kept in order of
their residual capacity; the search starts at the successor of the piece's length
and goes on upwards until it meets a bin whose bitmaps hold neither the piece's
source nor its duplicate cluster: the tightest compatible bin.  Without one, a new
bin is opened.

A duplicate cluster is a set of texts that are equal but for case, unless
``cluster_column`` names a column with clusters, such as the components of the n-gram
Jaccard join, in which near copies conflict as well.

A block is a bounded number of documents, chosen by a hash of the document and of its
number among rows that are equal, so a source, a group of copies or of repeated rows
that holds a third of all rows is spread over all blocks.  Blocks are packed independently of each other and in parallel; the cost
against one global packing is at most the half-empty bins of each block.

Defined results: one row per piece; a null or empty text is one piece of no words,
which takes a place in a bin (all of them are one cluster); a null source conflicts
with no other null source;
an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import with_copies

CAPACITY = 2048
DOCUMENTS_A_BLOCK = 1024


def best_fit(lengths: list[int], sources: list[int | None], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, place in the bin) of every piece, pieces given in the order of placing.

    Sources and clusters are numbered from 0; each is one bit of a bin's bitmaps.
    """
    open_bins: list[tuple[int, int]] = []  # (residual, bin), sorted
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    filled: list[int] = []
    out, places = [], []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        s, c = 0 if source is None else 1 << source, 1 << cluster
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not (source_bits[b] & s or cluster_bits[b] & c):
                break
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, len(filled)
            source_bits.append(0)
            cluster_bits.append(0)
            filled.append(0)
        source_bits[b] |= s
        cluster_bits[b] |= c
        insort(open_bins, (residual - length, b))
        out.append(b)
        places.append(filled[b])
        filled[b] += 1
    return out, places


def pack(
    documents: DataFrame,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    documents_a_block: int = DOCUMENTS_A_BLOCK,
    cluster_column: str | None = None,
) -> DataFrame:
    """Per piece: id, ``piece``, ``first_word``, ``n_words``, ``block``, ``bin`` and ``place``.

    Only lengths and hashes are shuffled, never text.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    cluster = F.xxhash64(F.lower(text) if cluster_column is None else F.col(cluster_column))
    rows = documents.select(F.col(id_column).cast("long").alias("id"), words.alias("n"), F.xxhash64(F.col(source_column)).alias("source"), F.col(source_column).isNull().alias("nosource"), cluster.alias("cluster"))
    blocks = max(1, -(-documents.count() // documents_a_block))
    rows = with_copies(rows).withColumn("block", F.pmod(F.xxhash64("id", "cluster", "source", "copy"), F.lit(blocks)).cast("int"))

    def of_block(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["id", "cluster", "n"], kind="stable", na_position="last").reset_index(drop=True)
        full, rest = block["n"] // capacity, block["n"] % capacity
        pieces = (full + ((rest > 0) | (full == 0))).to_numpy()
        parts = block.loc[block.index.repeat(pieces)].reset_index()
        parts["piece"] = parts.groupby("index").cumcount()
        parts["first_word"] = parts["piece"] * capacity
        parts["n_words"] = (parts["n"] - parts["first_word"]).clip(upper=capacity)
        parts = parts.sort_values(["n_words", "index", "piece"], ascending=[False, True, True], kind="stable")
        sources = pd.factorize(parts["source"])[0].tolist()
        sources = [None if none else x for x, none in zip(sources, parts["nosource"], strict=True)]
        parts["bin"], parts["place"] = best_fit(parts["n_words"].tolist(), sources, pd.factorize(parts["cluster"])[0].tolist(), capacity)
        return parts[["id", "piece", "first_word", "n_words", "block", "bin", "place"]].astype({"id": "Int64"})

    schema = "id long, piece long, first_word long, n_words long, block int, bin long, place long"
    return rows.groupBy("block").applyInPandas(of_block, schema).withColumnRenamed("id", id_column)
