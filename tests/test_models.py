"""Clusterings fitted together, against numpy on all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import cluster, metrics, models

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    clouds = [rng.normal(m, s, (n, 3)) for m, s, n in (((0, 0, 0), 1, 120), ((6, 0, 1), 0.5, 60), ((0, 7, -2), 1.5, 80), ((5, 6, 9), 1, 40))]
    return np.round(np.concatenate(clouds), 6)


@pytest.fixture(scope="module")
def rows(spark, points):
    data = [(i, "x", *map(float, p)) for i, p in enumerate(points)]
    return spark.createDataFrame(data, "id long, cluster string, a double, b double, c double").repartition(5)


def start(points, k):
    out = [points[0]]
    while len(out) < k:
        out.append(points[np.round(np.min([((points - c) ** 2).sum(axis=1) for c in out], axis=0), 9).argmax()])
    return np.array(out)


def nearest(points, centres):
    return ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)


def lloyd(points, k):
    c = start(points, k)
    while True:
        label = nearest(points, c)
        new = np.array([points[label == i].mean(axis=0) if (label == i).any() else c[i] for i in range(k)])
        if np.abs(new - c).max() < 1e-9:
            return label, new
        c = new


def medoids(points, k):
    c = start(points, k)
    while True:
        label = nearest(points, c)
        new = c.copy()
        for i in range(k):
            own = points[label == i]
            new[i] = own[((own[:, None] - own[None]) ** 2).sum(axis=(1, 2)).round(6).argmin()]
        if (new == c).all():
            return label, c
        c = new


@pytest.mark.parametrize("k", [2, 4, 6])
def test_means_and_medoids(rows, points, k):
    for fitted, brute in ((cluster.k_means, lloyd), (cluster.k_medoids, medoids)):
        out, centres = fitted(rows, COLUMNS, "id", k)
        label, want = brute(points, k)
        assert np.allclose(centres, want, atol=1e-8)
        got = {r.id: (r.cluster, r.sq_distance) for r in out.collect()}
        assert out.columns == ["id", "a", "b", "c", "cluster", "sq_distance"]  # a column named like a result gives way
        assert [got[i][0] for i in range(len(points))] == label.tolist()
        assert np.allclose([got[i][1] for i in range(len(points))], ((points - want[label]) ** 2).sum(axis=1))


def test_sweep_fits_all_in_the_passes_of_the_longest(rows, points, monkeypatch):
    passes, add = [], models.added
    monkeypatch.setattr(models, "added", lambda *a: passes.append(1) or add(*a))
    found = {(r.algorithm, r.k): (r.ch, r.db) for r in cluster.index_sweep(rows, COLUMNS, "id").collect()}
    together = len(passes)
    assert set(found) == {(a, k) for a in ("kmeans", "kmedoids", *models.SHAPES) for k in range(3, 8)}
    longest = 0
    for name, k in (("kmeans", 4), ("kmedoids", 3), ("kmedoids", 7), ("full", 4), ("tied", 7), ("diag", 3), ("spherical", 5)):
        passes.clear()
        labelled = cluster._fitted(rows, COLUMNS, "id", k, name)[0]
        longest = max(longest, len(passes))
        ch = metrics.calinski_harabasz(labelled, COLUMNS, "cluster").first().ch
        db = metrics.davies_bouldin(labelled, COLUMNS, "cluster").first().db
        assert found[name, k] == pytest.approx((ch, db), rel=1e-6), (name, k)
    assert longest <= together <= models.MIXTURE_ROUNDS + 4


def test_rows_that_cannot_be_clustered(rows):
    with pytest.raises(ValueError, match="no rows"):
        cluster.k_means(rows.where("false"), COLUMNS, "id", 2)
    with pytest.raises(Exception, match="finite"):
        cluster.k_means(rows.withColumn("a", F.when(F.col("id") == 3, None).otherwise(F.col("a"))), COLUMNS, "id", 2)
    with pytest.raises(ValueError, match="no shape"):
        cluster.gaussian_mixture(rows, COLUMNS, "id", 2, "square")


def test_equal_vectors_are_fitted_once(rows, points):
    """copies weigh as much as they are many, and add no rows to the passes."""
    copies = rows.withColumn("id", F.explode(F.expr("transform(sequence(0, id % 4), i -> id + 1000 * i)")))
    packed = models.packed(copies, COLUMNS, "id")
    assert packed.columns == ["key", "w", "x"] and {r["key"]: r["w"] for r in packed.collect()} == {i: i % 4 + 1 for i in range(len(points))}
    whole = np.repeat(points, np.arange(len(points)) % 4 + 1, axis=0)
    for fitted, brute in ((cluster.k_means, lloyd), (cluster.k_medoids, medoids)):
        out, centres = fitted(copies, COLUMNS, "id", 4)
        assert np.allclose(centres, brute(whole, 4)[1], atol=1e-8) and out.count() == len(whole)
    found = cluster.index_sweep(copies, COLUMNS, "id", range(3, 4), ("tied",)).first()
    labelled = cluster._fitted(copies, COLUMNS, "id", 3, "tied")[0]
    assert found.ch == pytest.approx(metrics.calinski_harabasz(labelled, COLUMNS, "cluster").first().ch, rel=1e-6)
    assert found.db == pytest.approx(metrics.davies_bouldin(labelled, COLUMNS, "cluster").first().db, rel=1e-6)
