"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors of integers are dealt into blocks of bounded size.  The index of a block
keeps postings in segments of one quantised impact: the bit length of the
component's magnitude.  A query block meets every vector block once; segments are
processed from the highest impact down, each adding its exact share to the
accumulators.  After a segment, the unprocessed rest of a vector has a known norm,
which bounds what is still missing of each score.  A member is ruled out when its
upper bound is below the k-th largest lower bound; processing stops only when what
is left is proven to hold the top k, and these possible members are rescored
exactly in integers.

Each pair of blocks returns k rows a query at most, and a window keeps the best k
over all blocks.  No task holds more than one block of vectors and one of queries.

Defined results: ties go to the smaller id; with fewer than k candidates, all are
returned; vectors null, empty or holding null or non-finite components take no
part, and vectors of different lengths do not meet; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VECTORS_A_BLOCK = 1024
QUERIES_A_BLOCK = 512
#: Possible members a query that are cheaper to rescore than to refine further.
FEW = 16


class ImpactIndex:
    """The postings of a block of integer vectors, in segments of descending impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        level = np.zeros(vectors.shape, np.int8)
        rest = np.abs(vectors)
        while rest.any():
            level += rest > 0
            rest = rest >> 1
        self.segments = []
        left = (vectors.astype(np.float64) ** 2).sum(axis=1)
        for impact in range(int(level.max(initial=0)), 0, -1):
            part = np.where(level == impact, vectors, 0)
            dims = np.flatnonzero(part.any(axis=0))
            left = left - (part.astype(np.float64) ** 2).sum(axis=1)
            self.segments.append((dims, part[:, dims].astype(np.float64), np.sqrt(np.maximum(left, 0.0))))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, candidate ids, exact scores) of k best candidates per query, or all."""
        n = len(self.ids)
        score = np.zeros((len(queries), n))
        float_queries = queries.astype(np.float64)
        norms = np.sqrt((float_queries**2).sum(axis=1))
        same = query_ids[:, None] == self.ids[None, :]
        possible = ~same
        todo = np.arange(len(queries))
        for step, (dims, part, left) in enumerate(self.segments):
            score[todo] += float_queries[np.ix_(todo, dims)] @ part.T
            if n <= k + 1 or step == len(self.segments) - 1:
                continue
            # a little more than the bound, so that rounding never rules out a member
            gap = norms[todo, None] * left[None, :] * (1 + 1e-9) + 1e-6
            lower = np.where(same[todo], -np.inf, score[todo] - gap)
            kth = -np.partition(-lower, k - 1, axis=1)[:, k - 1 : k]
            possible[todo] = (score[todo] + gap >= kth) & ~same[todo]
            todo = todo[possible[todo].sum(axis=1) > max(FEW, 2 * k)]
            if not len(todo):
                break
        for q, query in enumerate(queries):
            at = np.flatnonzero(possible[q])
            exact = self.vectors[at] @ query
            best = np.lexsort((self.ids[at], -exact))[:k]
            yield int(query_ids[q]), self.ids[at][best], exact[best]


def integer_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """``id`` and ``v``, floor(scale * x) of every component, of the vectors that take part."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(v.isNotNull() & F.col(id_column).isNotNull() & (F.size(v) > 0) & finite).select(
        F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    )


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k best candidates of every row whose id is divisible by ``every``.

    Returns ``query_id``, ``rank`` from 1, the candidate's id and ``score``.
    """
    rows = integer_vectors(vectors, id_column, vector_column, scale)
    count = vectors.count()
    blocks = max(1, -(-count // VECTORS_A_BLOCK))
    query_blocks = max(1, -(-count // every // QUERIES_A_BLOCK))
    every_block, every_query = F.sequence(F.lit(0), F.lit(blocks - 1)), F.sequence(F.lit(0), F.lit(query_blocks - 1))
    held = rows.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "part": F.explode(every_query)})
    asked = rows.where(F.col("id") % every == 0).withColumns({"part": F.pmod(F.xxhash64("id", F.lit(7)), F.lit(query_blocks)).cast("int"), "block": F.explode(every_block)})

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "id": [], "score": []}
        q_ids, q_all = np.asarray(left["id"]), left["v"].to_pylist()
        v_ids, v_all = np.asarray(right["id"]), right["v"].to_pylist()
        for size in {len(v) for v in q_all}:
            q_at, v_at = ([i for i, v in enumerate(x) if len(v) == size] for x in (q_all, v_all))
            if not v_at:
                continue
            index = ImpactIndex(v_ids[v_at], np.array([v_all[i] for i in v_at], np.int64))
            for query, ids, scores in index.search(q_ids[q_at], np.array([q_all[i] for i in q_at], np.int64), k):
                out["query_id"] += [query] * len(ids)
                out["id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]))

    found = asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInArrow(meet, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")
