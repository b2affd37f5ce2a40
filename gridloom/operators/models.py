"""Clusterings of whole tables whose models are fitted together.

Equal vectors are one row with a weight, and rows are vectors of doubles as binary, which
reach Python as they are.  A round is one pass: every task adds up what each model that
still moves needs of its rows, Spark adds the tasks' sums, and a few numbers a cluster
reach the driver.  All models, such as every algorithm with every number of
clusters, share the passes, so that the longest of them sets the time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds after which a model is taken as it is: k-means and k-medoids, and mixtures.
MOST_ROUNDS, MIXTURE_ROUNDS = 300, 100
SHAPES = ("full", "tied", "diag", "spherical")


class KMeans:
    """Lloyd's rounds, until no centre moves."""

    def __init__(self, centres: np.ndarray, rounds: int = MOST_ROUNDS):
        self.centres, self.left, self.moves = centres.copy(), rounds, True

    def labels(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) of points; the smaller cluster of equals."""
        d = _squares(x, self.centres)
        best = d.argmin(axis=0)
        return best, d[best, np.arange(len(x))]

    def sums(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts and sums by cluster."""
        return _by_cluster(x, w, self.labels(x)[0], len(self.centres)).ravel()

    def step(self, total: np.ndarray) -> None:
        moved = _means(total, self.centres)
        self.left -= 1
        self.moves = np.abs(moved - self.centres).max() >= 1e-9 and self.left > 0
        self.centres = moved


class KMedoids(KMeans):
    """Alternate assignment and the best member of each cluster, until none changes.

    The best member has the least summed squared distance to its cluster, so it is the one
    nearest to the mean; a second pass of a round finds it.
    """

    means: np.ndarray | None = None

    def step(self, total: np.ndarray) -> None:
        self.means = _means(total, self.centres)

    def settle(self, members: dict[int, np.ndarray]) -> None:
        moved = np.stack([members.get(i, c) for i, c in enumerate(self.centres)])
        self.left -= 1
        self.moves = not np.array_equal(moved, self.centres) and self.left > 0
        self.centres, self.means = moved, None


class Mixture:
    """A Gaussian mixture, until the mean likelihood grows by less than ``tolerance``."""

    def __init__(self, centres: np.ndarray, variances: np.ndarray, shape: str, rounds: int = MIXTURE_ROUNDS, tolerance: float = 1e-3):
        if shape not in SHAPES:
            raise ValueError(f"no shape named {shape!r}")
        k = len(centres)
        self.means, self.shape, self.left, self.tolerance = centres.copy(), shape, rounds, tolerance
        self.covariances = np.repeat(np.diag(np.maximum(variances, 1e-9))[None], k, axis=0)
        self.weights, self.last, self.moves = np.full(k, 1 / k), -np.inf, True

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The logarithm of each component's weighted density."""
        factors = np.linalg.cholesky(np.linalg.inv(self.covariances))
        constant = np.log(np.maximum(self.weights, 1e-12)) + np.log(np.einsum("kii->ki", factors)).sum(axis=1) - self.means.shape[1] / 2 * np.log(2 * np.pi)
        return np.column_stack([c - 0.5 * (((x - m) @ f) ** 2).sum(axis=1) for m, f, c in zip(self.means, factors, constant, strict=True)])

    def labels(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = self.scores(x).argmax(axis=1) if len(x) else np.zeros(0, int)
        return best, ((x - self.means[best]) ** 2).sum(axis=1)

    def sums(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Likelihood, rows, and weights, sums and products by component."""
        z = self.scores(x)
        top = z.max(axis=1, keepdims=True)
        share = np.exp(z - top)
        whole = share.sum(axis=1, keepdims=True)
        share *= w[:, None] / whole
        products = np.stack([(x * r[:, None]).T @ x for r in share.T])
        return np.concatenate([[((np.log(whole) + top)[:, 0] * w).sum(), w.sum()], share.sum(axis=0), (share.T @ x).ravel(), products.ravel()])

    def step(self, total: np.ndarray) -> None:
        k, d = self.means.shape
        likelihood, size, rest = total[0] / max(total[1], 1), total[2 : 2 + k], total[2 + k :]
        first, second = rest[: k * d].reshape(k, d), rest[k * d :].reshape(k, d, d)
        self.weights, self.means = size / size.sum(), first / np.maximum(size, 1e-12)[:, None]
        covariances = second / np.maximum(size, 1e-12)[:, None, None] - self.means[:, :, None] * self.means[:, None, :]
        if self.shape == "tied":
            covariances = np.repeat((covariances * self.weights[:, None, None]).sum(axis=0)[None], k, axis=0)
        elif self.shape != "full":
            variances = np.einsum("kii->ki", covariances)
            variances = np.repeat(variances.mean(axis=1)[:, None], d, axis=1) if self.shape == "spherical" else variances
            covariances = variances[:, :, None] * np.eye(d)
        self.covariances = covariances + 1e-6 * np.eye(d)
        self.left -= 1
        self.moves = likelihood - self.last >= self.tolerance and self.left > 0
        self.last = likelihood


Model = KMeans | KMedoids | Mixture


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points from each centre, a row a centre."""
    return np.stack([np.einsum("ij,ij->i", d, d) for d in (x - c for c in centres)])


def _by_cluster(x: np.ndarray, w: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
    """Of each cluster how many rows it has, and their sums."""
    chosen = (label[:, None] == np.arange(k)) * w[:, None]
    return np.column_stack([chosen.sum(axis=0), chosen.T @ x])


def _means(total: np.ndarray, before: np.ndarray) -> np.ndarray:
    each = total.reshape(len(before), -1)
    return np.where(each[:, :1] > 0, each[:, 1:] / np.maximum(each[:, :1], 1), before)


def packed(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, w, x): each distinct vector of the columns, how many rows have it, and the smallest of their keys.

    ``x`` holds doubles as binary; nulls and other values that are no finite numbers are errors.
    """
    x = F.array(*[F.col(c).cast("double") for c in columns])
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    checked = rows.select(F.col(key).alias("key"), F.when(bad, F.raise_error(F.lit("clustering needs finite numbers"))).otherwise(x).alias("x"))
    kind = dict(checked.dtypes)["key"]

    def binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten(), "<f8").reshape(-1, len(columns)) + 0.0  # no minus zero
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in flat], pa.binary())], names=["key", "x"])

    alike = checked.mapInArrow(binary, f"key {kind}, x binary").groupBy("x")
    return alike.agg(F.min("key").alias("key"), F.count("*").cast("double").alias("w")).select("key", "w", "x")


def vectors(batch: pa.RecordBatch) -> np.ndarray:
    """The last column of a batch, of binary vectors, as a matrix."""
    x = batch.column(batch.num_columns - 1)
    if not len(x):
        return np.zeros((0, 0))
    ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(x.buffers()[2], "<f8", offset=int(ends[0]), count=int(ends[-1] - ends[0]) // 8).reshape(len(x), -1)


def added(rows: DataFrame, size: int, sums: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``sums`` of the vectors of all rows and their weights, added up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += sums(vectors(batch), np.asarray(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    parts = rows.select("w", "x").mapInArrow(add, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for r in parts.collect():  # as many numbers as the models have
        out[r["i"]] = r["v"]
    return out


def spread_start(rows: DataFrame, k: int) -> np.ndarray:
    """k start centres, each the row farthest from those before (the smaller key of equals); the first has the smallest key."""
    first = rows.agg(F.min(F.struct("key", "x")).alias("m")).first()["m"]
    if first is None:
        raise ValueError("no rows to cluster")
    centres = [np.frombuffer(first["x"], "<f8")]
    kind = dict(rows.dtypes)["key"]
    while len(centres) < k:

        def farthest(batches: Iterator[pa.RecordBatch], known: list[np.ndarray] = centres) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = vectors(batch)
                    d = np.round(_squares(x, np.stack(known)).min(axis=0), 9)
                    at = np.flatnonzero(d == d.max())
                    yield pa.RecordBatch.from_arrays([pa.array(d[at]), *[c.take(pa.array(at)) for c in batch.columns]], names=["d", "key", "x"])

        far = rows.select("key", "x").mapInArrow(farthest, f"d double, key {kind}, x binary").groupBy("d").agg(F.min(F.struct("key", "x")).alias("m"))
        centres.append(np.frombuffer(far.agg(F.max_by("m", "d").alias("m")).first()["m"]["x"], "<f8"))
    return np.stack(centres)


def variances(rows: DataFrame, d: int) -> np.ndarray:
    """The population variance of every component."""
    total = added(rows, 2 * d + 1, lambda x, w: np.concatenate([[w.sum()], w @ x, w @ (x * x)]))
    mean = total[1 : d + 1] / total[0]
    return np.maximum(total[d + 1 :] / total[0] - mean**2, 0.0)


def fit(rows: DataFrame, models: list[Model]) -> None:
    """Fit all models to (key, w, x) together; each ends by its own test."""
    while moving := [m for m in models if m.moves]:
        probe = np.zeros((1, len((moving[0].means if isinstance(moving[0], Mixture) else moving[0].centres)[0])))
        ends = np.cumsum([0, *[len(m.sums(probe, np.ones(1))) for m in moving]])
        total = added(rows, int(ends[-1]), lambda x, w, moving=moving: np.concatenate([m.sums(x, w) for m in moving]))
        for m, a, b in zip(moving, ends[:-1], ends[1:], strict=True):
            m.step(total[a:b])
        if medoids := [m for m in moving if isinstance(m, KMedoids)]:
            found = _members(rows, medoids)
            for i, m in enumerate(medoids):
                m.settle(found.get(i, {}))


def _members(rows: DataFrame, models: list[KMedoids]) -> dict[int, dict[int, np.ndarray]]:
    """Of each model and cluster the member nearest to the cluster's mean, the smaller key of equals."""
    kind = dict(rows.dtypes)["key"]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors(batch)
            for i, m in enumerate(models):
                label = m.labels(x)[0]
                d = np.round(((x - m.means[label]) ** 2).sum(axis=1), 9)
                least = np.full(len(m.centres), np.inf)
                np.minimum.at(least, label, d)
                at = np.flatnonzero(d == least[label])
                columns = [pa.array(np.full(len(at), i, np.int32)), pa.array(label[at].astype(np.int32)), pa.array(d[at]), *[c.take(pa.array(at)) for c in batch.columns]]
                yield pa.RecordBatch.from_arrays(columns, names=["m", "c", "d", "key", "x"])

    best = rows.select("key", "x").mapInArrow(nearest, f"m int, c int, d double, key {kind}, x binary").groupBy("m", "c").agg(F.min(F.struct("d", "key", "x")).alias("b"))
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in best.collect():  # one row a cluster
        out.setdefault(r["m"], {})[r["c"]] = np.frombuffer(r["b"]["x"], "<f8")
    return out


def labelled(rows: DataFrame, columns: list[str], model: Model) -> DataFrame:
    """All columns of ``rows`` with ``cluster`` and ``sq_distance`` by a fitted model, in one pass without a join."""
    names = [c for c in rows.columns if c not in ("cluster", "sq_distance")]
    source = rows.select(*names, F.array(*[F.col(c).cast("double") for c in columns]).alias("__x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, d = model.labels(np.asarray(batch.column(batch.num_columns - 1).flatten(), float).reshape(batch.num_rows, len(columns)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(label.astype(np.int32)), pa.array(d)], names=[*names, "cluster", "sq_distance"])

    kinds = dict(rows.dtypes)
    return source.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", cluster int, sq_distance double")


def indices(rows: DataFrame, models: list[Model], k: list[int], d: int) -> list[tuple[float, float]]:
    """(Calinski-Harabasz, Davies-Bouldin) of every model's clustering of (key, w, x), in two passes for all; empty clusters do not count."""
    ends = np.cumsum([0, *[n * (d + 2) for n in k]])

    def first(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        square = (x * x).sum(axis=1) * w
        return np.concatenate([np.column_stack([_by_cluster(x, w, label, n), np.bincount(label, square, n)]).ravel() for label, n in ((m.labels(x)[0], n) for m, n in zip(models, k, strict=True))])

    total = added(rows, int(ends[-1]), first)
    tables = [total[a:b].reshape(n, d + 2) for a, b, n in zip(ends[:-1], ends[1:], k, strict=True)]
    centres = [t[:, 1:-1] / np.maximum(t[:, :1], 1) for t in tables]
    apart = np.cumsum([0, *k])

    def second(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = []
        for m, c in zip(models, centres, strict=True):
            label = m.labels(x)[0]
            out.append(np.bincount(label, w * np.sqrt(((x - c[label]) ** 2).sum(axis=1)), len(c)))
        return np.concatenate(out)

    spread = added(rows, int(apart[-1]), second)
    found = []
    for t, c, a, b in zip(tables, centres, apart[:-1], apart[1:], strict=True):
        there = t[:, 0] > 0
        n, centre, s = t[there, 0], c[there], spread[a:b][there] / t[there, 0]
        mean = (n[:, None] * centre).sum(axis=0) / n.sum()
        within, between = (t[there, -1] - n * (centre**2).sum(axis=1)).sum(), (n * ((centre - mean) ** 2).sum(axis=1)).sum()
        if len(n) < 2 or within <= 0:
            found.append((float("nan"), float("nan")))
            continue
        gap = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2))
        np.fill_diagonal(gap, np.inf)
        worst = ((s[:, None] + s[None]) / gap).max(axis=1)
        found.append((float((between / (len(n) - 1)) / (within / (n.sum() - len(n)))), float(worst.mean())))
    return found
