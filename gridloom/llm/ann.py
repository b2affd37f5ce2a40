"""Approximate nearest neighbours by balanced posting lists.

Vectors are grouped into posting lists of near equal length around centroids.  The
centroids come from a bounded sample by balanced bisection and stay in memory; a
graph over them finds the lists near a vector.  A vector near a boundary is put in
several lists: those whose centroid is at most ``replicate`` times as far as the
nearest.  A query visits the lists whose centroid is at most ``prune`` times as far
as its nearest; that ratio is set on the sample, as the smallest that reaches the
recall asked for.  There is no other limit on the lists of a query: where the
search of the graph meets no list beyond the ratio, all centroids are compared.

Every vector is indexed.  A list longer than ``PART`` (copies of one vector all
fall into one list) is dealt over parts by a hash of the id, and a query visits all
parts of a list.  Scores are exact inner products in double precision on the
original vectors.

Inner products become distances by one more dimension that fills every vector up to
the largest norm, so vectors of any norms are handled.

All candidates come from lists.  The sample travels with the index only to tell a
floor: lists return no candidate below the k-th best of those vectors of the sample
that are in the lists that the query visits.

Defined results: ties go to the smaller id; with fewer than k candidates, all are
returned; vectors null, empty, zero or holding null or non-finite components take
no part; vectors of different lengths do not meet, each length has its own lists; rows
that share an id are one candidate, with the better of their scores, and one query; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import bounded_sample, staged

SAMPLE = 16_384
LIST, PART = 512, 2048
MOST_LISTS = 4096
REPLICATE, MOST_COPIES = 1.05, 4
RECALL = 0.96
NEIGHBOURS, BEAM = 24, 512


class CentroidGraph:
    """Centroids with links to their nearest, searched best first."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.squares = (centroids**2).sum(axis=1)
        n = len(centroids)
        k = min(NEIGHBOURS, n - 1)
        self.near = np.empty((n, k + 4), np.int64)
        rng = np.random.default_rng(0)
        for at in range(0, n, 512):
            d = self.squares[None, :] - 2 * centroids[at : at + 512] @ centroids.T
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            self.near[at : at + 512, :k] = np.argpartition(d, k - 1, axis=1)[:, :k] if 0 < k < n - 1 else np.argsort(d, axis=1)[:, :k]
        self.near[:, k:] = rng.integers(0, n, (n, 4))  # far links keep the graph in one piece

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances) of up to ``beam`` centroids near each row, nearest first."""
        norms = (x**2).sum(axis=1)
        n = len(self.centroids)
        if n <= beam:
            d = norms[:, None] + self.squares[None, :] - 2 * x @ self.centroids.T
            ids = np.argsort(d, axis=1, kind="stable")
            return ids, np.sqrt(np.maximum(np.take_along_axis(d, ids, axis=1), 0))
        rows = np.arange(len(x))
        met = np.zeros((len(x), n), bool)
        ids = np.tile(np.linspace(0, n - 1, 16).astype(np.int64), (len(x), 1))
        met[:, ids[0]] = True
        d = norms[:, None] + self.squares[ids] - 2 * np.einsum("bd,bkd->bk", x, self.centroids[ids])
        opened = np.zeros(ids.shape, bool)
        while True:
            best = np.where(opened, np.inf, d).argmin(axis=1)
            go = ~opened[rows, best]
            if not go.any():
                break
            opened[rows, best] = True
            new = self.near[ids[rows, best]]
            dn = norms[:, None] + self.squares[new] - 2 * np.einsum("bd,bkd->bk", x, self.centroids[new])
            dn[met[rows[:, None], new] | ~go[:, None]] = np.inf
            order = np.argsort(new, axis=1, kind="stable")  # a neighbour may be linked twice
            again = np.zeros(new.shape, bool)
            sorted_new = np.take_along_axis(new, order, axis=1)
            np.put_along_axis(again, order[:, 1:], sorted_new[:, 1:] == sorted_new[:, :-1], axis=1)
            dn[again] = np.inf
            met[rows[:, None], new] = True
            ids, d = np.concatenate([ids, new], axis=1), np.concatenate([d, dn], axis=1)
            opened = np.concatenate([opened, np.isinf(dn)], axis=1)
            if ids.shape[1] > beam:
                keep = np.argpartition(d, beam - 1, axis=1)[:, :beam]
                ids, d, opened = (np.take_along_axis(a, keep, axis=1) for a in (ids, d, opened))
        order = np.argsort(d, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.sqrt(np.maximum(np.take_along_axis(d, order, axis=1), 0))


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Centroids of ``lists`` groups of near equal size, by recursive two-means with even halves."""
    rng = np.random.default_rng(seed)
    out, todo = [], [(np.arange(len(x)), lists)]
    while todo:
        at, n = todo.pop()
        if n <= 1 or len(at) <= 1:
            out.append(x[at].mean(axis=0))
            continue
        left = n // 2
        cut = max(1, min(len(at) - 1, round(len(at) * left / n)))
        a, b = x[at[rng.integers(len(at))]], x[at[rng.integers(len(at))]]
        for _ in range(8):
            order = np.argsort(x[at] @ (b - a), kind="stable")
            a, b = x[at[order[:cut]]].mean(axis=0), x[at[order[cut:]]].mean(axis=0)
        todo += [(at[order[:cut]], left), (at[order[cut:]], n - left)]
    return np.array(out)


class ListIndex:
    """What routes vectors and queries to lists: the centroids, two ratios and a bounded sample."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, radius: float, lists: int, k: int):
        self.radius, self.k = radius, k
        self.ids, self.vectors = ids, vectors
        filled = self.lifted(vectors)
        self.graph = CentroidGraph(balanced_centroids(filled, lists))
        row, home = self.homes(vectors)
        first = np.searchsorted(row, np.arange(len(vectors)))
        at = first[:, None] + np.arange(MOST_COPIES)
        mine = np.minimum(at, len(row) - 1)
        # the lists of each vector of the sample; the first stands in for copies that it has not
        self.sample_homes = np.where((at < len(row)) & (row[mine] == np.arange(len(vectors))[:, None]), home[mine], home[first][:, None])
        self.prune = self._ratio()

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors with the dimension that fills them up to the largest norm."""
        rest = np.sqrt(np.maximum(self.radius**2 - (vectors**2).sum(axis=1), 0))
        return np.column_stack([vectors, rest])

    @staticmethod
    def asked(queries: np.ndarray) -> np.ndarray:
        """Queries in the same space."""
        return np.column_stack([queries, np.zeros(len(queries))])

    def homes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every copy of each vector."""
        lists, d = self.graph.search(self.lifted(vectors), 64)
        lists, d = lists[:, :MOST_COPIES], d[:, :MOST_COPIES]
        near = d <= d[:, :1] * REPLICATE + 1e-12
        row, col = np.nonzero(near)
        return row, lists[row, col]

    def _ratio(self) -> float:
        """The smallest ratio with which the sample's own queries reach RECALL in their lists."""
        if len(self.vectors) <= self.k + 1:
            return np.inf
        picked = np.random.default_rng(1).permutation(len(self.vectors))[:256]
        scores = self.vectors[picked] @ self.vectors.T
        scores[np.arange(len(picked)), picked] = -np.inf
        best = np.argpartition(-scores, self.k - 1, axis=1)[:, : self.k]
        lists, d = self.graph.search(self.asked(self.vectors[picked]), len(self.graph.centroids))
        ratio = np.empty((len(picked), len(self.graph.centroids)))
        np.put_along_axis(ratio, lists, d / np.maximum(d[:, :1], 1e-12), axis=1)
        needed = ratio[np.arange(len(picked))[:, None, None], self.sample_homes[best]].min(axis=2)
        need = np.sort(needed.ravel())
        return float(need[min(len(need) - 1, int(np.ceil(RECALL * len(need))))]) + 1e-9

    def visits(self, ids: np.ndarray, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list) of every visit, and of each query a score that its k-th best in these lists is not below.

        If the last list found is not beyond the ratio, all lists are looked at; and a
        query goes on to further lists until those visited hold k vectors of the
        sample beside itself.
        """
        asked, n = self.asked(queries), len(self.graph.centroids)
        held = np.bincount(self.sample_homes[:, 0], minlength=n)
        while True:
            lists, d = self.graph.search(asked, beam)
            before = np.cumsum(held[lists], axis=1) - held[lists]
            near = (d <= d[:, :1] * self.prune + 1e-12) | (before <= self.k)
            if lists.shape[1] >= n or not near[:, -1].any():
                break
            beam = n  # one product with all centroids
        row, col = np.nonzero(near)
        visited = np.zeros((len(queries), n), bool)
        visited[row, lists[row, col]] = True
        scores = queries @ self.vectors.T
        scores[ids[:, None] == self.ids[None, :]] = -np.inf
        scores[~visited[:, self.sample_homes].any(axis=2)] = -np.inf
        floor = np.full(len(queries), -np.inf)
        if len(self.ids) > self.k:
            floor = np.partition(scores, -self.k, axis=1)[:, -self.k]
        return row, lists[row, col], floor - 1e-9 * np.abs(np.where(np.isfinite(floor), floor, 0))


def valid_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(id_column).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)).select(
        F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k nearest found of every row whose id is divisible by ``every``.

    Returns ``query_id``, ``rank`` from 1, the candidate's id and ``score``.
    """
    rows = valid_vectors(vectors, id_column, vector_column)
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))
    stored = dict(vectors.dtypes)[vector_column].removeprefix("array<").removesuffix(">")
    found = None
    for r in sizes.orderBy("size").collect():  # one row for each length of vectors
        part = _nearest_of_length(rows.where(F.size("v") == r["size"]), k, every, r["n"], r["norm"], stored)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.where("false").select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id_column), F.lit(0.0).alias("score"))
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")


def _nearest_of_length(rows: DataFrame, k: int, every: int, count: int, norm: float, stored: str) -> DataFrame:
    """(query_id, id, score): the best candidates of each query in each list, of ``count`` vectors (id, v) of one length."""
    spark = rows.sparkSession
    sample = bounded_sample(rows, "id", SAMPLE).toArrow().combine_chunks()
    if not sample.num_rows:  # of very few rows the hash may take none
        sample = rows.limit(SAMPLE).toArrow().combine_chunks()
    ids = np.asarray(sample["id"].combine_chunks())
    matrix = _matrix(sample["v"].combine_chunks())
    lists = int(min(MOST_LISTS, max(1, count // LIST), max(1, len(ids) // 8)))
    index = ListIndex(ids, matrix, float(np.sqrt(norm)) * (1 + 1e-9), lists, k)
    shared = spark.sparkContext.broadcast(index)  # at most SAMPLE vectors and MOST_LISTS centroids

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, home = shared.value.homes(_matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), *(c.take(pa.array(row)) for c in part.columns)], names=["list", "id", "v"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, visit, floor = shared.value.visits(np.asarray(part.column(0)), _matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(visit.astype(np.int32)), *(c.take(pa.array(row)) for c in part.columns), pa.array(floor[row])], names=["list", "id", "v", "floor"]
                )

    packed = F.transform("v", lambda x: x.cast(stored))
    postings = staged(rows.mapInArrow(post, "list int, id long, v array<double>").select("list", "id", packed.alias("v")))
    parts = staged(postings.groupBy("list").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts")))
    postings = postings.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    queries = rows.where(F.col("id") % every == 0).mapInArrow(ask, "list int, id long, v array<double>, floor double").select("list", "id", packed.alias("v"), "floor")
    every_part = parts.select(F.col("list").alias("of"), F.sequence(F.lit(0), F.col("parts") - 1).alias("all"))
    queries = queries.join(F.broadcast(every_part), F.col("list") == F.col("of")).select("list", "id", "v", "floor", F.explode("all").alias("part"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            q_ids, floor = np.asarray(left["id"]), np.asarray(left["floor"])
            v_ids, v = np.asarray(right["id"]), _matrix(right["v"].combine_chunks())
            q = _matrix(left["v"].combine_chunks())
            for at in range(0, len(q), 256):
                scores = q[at : at + 256] @ v.T
                for i, s in enumerate(scores, at):
                    near = np.flatnonzero((s >= floor[i]) & (v_ids != q_ids[i]))
                    if len(near) > k:
                        near = near[np.lexsort((v_ids[near], -s[near]))[:k]]
                    out[0].append(np.full(len(near), q_ids[i]))
                    out[1].append(v_ids[near])
                    out[2].append((v[near] * q[i]).sum(axis=1))
        arrays = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query_id": arrays[0].astype(np.int64), "id": arrays[1].astype(np.int64), "score": arrays[2].astype(np.float64)})

    keyed = ("list", "part")
    return queries.groupBy(*keyed).cogroup(postings.groupBy(*keyed)).applyInArrow(meet, "query_id long, id long, score double")
