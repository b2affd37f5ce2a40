"""Sharding by k-d tree partitioning.

Documents are points in a space of metadata: length in characters, language and
source.  The space is split recursively.  Each split takes the node
above the target bytes, its widest dimension (the largest spread of values, by
the share of that dimension's whole range), and the weighted median along it,
found over all rows by narrowing histograms: a few aggregations that return at
most ``BINS`` rows a node to the driver, whatever the number of documents.

Documents with equal texts form a group and carry the group's metadata, so no
split parts them, unless the group alone is above ``TOLERANCE`` of a target, in
which case its rows are spread by their ids.  Shard sizes are near equal (law
``bytes``): a split misses the median by at most one group of the tolerance.

Slots are numbered without sorting a shard in one task: rows are counted in
blocks by a hash of their id, and each block starts where the ones before it end.
Rows that are equal in id, text and metadata carry their number among them, which
parts them like different ids would.

Defined results: a null text has size 1 and the checksum of the empty string; a
null id or metadata counts as the empty value; an empty table gives no rows; when
fewer groups than shards exist, some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import staged, with_copies
from gridloom.operators.relational import join_spread

BINS = 1 << 10
#: Digits of the split key: 20 bits of the dimension's value, 20 of the group, 20 of the row.
DIGITS = 6
TOLERANCE = 1 / 32
ROWS_A_BLOCK = 50_000


def _points(documents: DataFrame, id_column: str, text_column: str, metadata: list[str]) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return documents.select(
        F.col(id_column).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text, F.lit(1)).alias("g1"),
        F.length(text).cast("long").alias("d0"),
        *[F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(1 << 20)).alias(f"d{k}") for k, c in enumerate(metadata, 1)],
    )


def kd_shards(
    documents: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text", metadata: tuple[str, ...] = ("lang", "source")
) -> DataFrame:
    """Per document: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``."""
    metadata = [c for c in metadata if c in documents.columns]
    dims = [f"d{k}" for k in range(len(metadata) + 1)]
    points = staged(with_copies(_points(documents, id_column, text_column, metadata)))
    whole = points.agg(F.sum("size").alias("size"), F.count("*").alias("n"), *[f(d).alias(f"{d}_{f.__name__}") for d in dims for f in (F.min, F.max)]).first()
    total, rows = whole["size"] or 0, whole["n"]
    large = max(1, int(total / shards * TOLERANCE))
    groups = staged(points.groupBy("crc", "g1").agg(F.sum("size").alias("bytes"), *[F.min(d).alias(f"g_{d}") for d in dims[1:]]))
    points = join_spread(points, groups, ["crc", "g1"])  # a third of all rows may have one text
    # of a group above the tolerance, every row is a group of its own
    key = F.when(F.col("bytes") > large, F.xxhash64("g1", "id", "copy")).otherwise(F.xxhash64("g1", F.lit(0)))
    tie = F.pmod(key, F.lit(1 << 40))

    def scaled(k: int, d: str) -> F.Column:
        low, high = whole[f"{d}_min"] or 0, whole[f"{d}_max"] or 0
        value = F.col(d if k == 0 else f"g_{d}")
        return F.floor((value - low) * ((1 << 20) - 1) / max(1, high - low)).cast("long")

    points = staged(
        points.select("id", "size", "crc", "copy", F.lit(0).alias("node"), *[F.shiftleft(scaled(k, d), 40).bitwiseOR(tie).alias(f"k{k}") for k, d in enumerate(dims)])
    )
    keys = [f"k{k}" for k in range(len(dims))]
    # node -> (shards below it, first shard); a node of one shard has reached the target bytes
    nodes = {0: (shards, 0)}
    while any(n > 1 for n, _ in nodes.values()):
        splits = _split(points, {k: n for k, (n, _) in nodes.items() if n > 1}, keys)
        side, below = F.lit(0), {}
        for node, (n, first) in nodes.items():
            if n == 1:
                below[2 * node + 1] = (1, first)
                side = F.when(F.col("node") == node, 2 * node + 1).otherwise(side)
                continue
            dim, at = splits.get(node, (keys[0], 0))
            below[2 * node + 1], below[2 * node + 2] = (n - n // 2, first), (n // 2, first + n - n // 2)
            side = F.when(F.col("node") == node, F.when(F.col(dim) <= at, 2 * node + 1).otherwise(2 * node + 2)).otherwise(side)
        points, nodes = points.withColumn("node", side), below
    shard = F.lit(0)
    for node, (_, first) in nodes.items():
        shard = F.when(F.col("node") == node, first).otherwise(shard)
    return numbered(points.select("id", "size", F.col("crc").alias("text_crc32"), "copy", F.lit("bytes").alias("law"), shard.cast("int").alias("shard")), rows).select(
        F.col("id").alias(id_column), "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _split(points: DataFrame, nodes: dict[int, int], keys: list[str]) -> dict[int, tuple[str, int]]:
    """Of every node its widest dimension and the key of its weighted median there.

    A node of an odd number of shards is split in proportion.
    """
    inside = points.where(F.col("node").isin(list(nodes)))
    spread = inside.groupBy("node").agg(
        F.sum("size").alias("size"), *[(F.shiftright(F.max(k), 40) - F.shiftright(F.min(k), 40)).alias(k) for k in keys]
    ).collect()
    widest = {r["node"]: max(keys, key=lambda k: r[k]) for r in spread}
    want = {r["node"]: r["size"] * (nodes[r["node"]] - nodes[r["node"]] // 2) / nodes[r["node"]] for r in spread}
    if not widest:
        return {}
    key = F.lit(0).cast("long")
    for node, dim in widest.items():
        key = F.when(F.col("node") == node, F.col(dim)).otherwise(key)
    rows = inside.select("node", "size", key.alias("key"))
    head = dict.fromkeys(widest, 0)
    bits = BINS.bit_length() - 1
    for digit in range(DIGITS):
        left = (DIGITS - 1 - digit) * bits
        prefix = F.lit(-1).cast("long")
        for node, h in head.items():
            prefix = F.when(F.col("node") == node, F.lit(h)).otherwise(prefix)
        hist = rows.where(F.shiftright("key", left + bits) == prefix).groupBy("node", F.pmod(F.shiftright("key", left), F.lit(BINS)).alias("bin")).agg(F.sum("size").alias("size"))
        bins: dict[int, dict[int, int]] = {n: {} for n in widest}
        for r in hist.collect():  # at most BINS rows a node
            bins[r["node"]][r["bin"]] = r["size"]
        for node, found in bins.items():
            for b in sorted(found):
                if want[node] <= found[b] or b == max(found):
                    head[node] = head[node] << bits | b
                    break
                want[node] -= found[b]
    # the last bin holds one group: it goes to the side that leaves the smaller error
    last = {n: bins[n].get(head[n] & (BINS - 1), 0) for n in widest}
    return {n: (widest[n], head[n] if want[n] * 2 >= last[n] else head[n] - 1) for n in widest}


def numbered(rows: DataFrame, count: int) -> DataFrame:
    """Add ``slot``: 0, 1, ... inside every ``shard``, in an order that depends on the rows alone."""
    keys = ["id", "size", "text_crc32", "copy"]
    blocks = max(1, -(-count // ROWS_A_BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))
    sizes = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy(*keys)
    return rows.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["shard", "block"]).withColumn("slot", (F.col("start") + F.col("at")).cast("long"))
