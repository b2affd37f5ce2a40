"""Metrics of networks, and indices of clusterings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import electrical as E


def simultaneous_load_by(df: DataFrame, keys: list[str], kind: str, power: str, count: str) -> DataFrame:
    """(keys..., load): consumers summed by class, made simultaneous, and added up."""
    by_class = df.groupBy(*keys, E.consumer_class(F.col(kind)).alias("class")).agg(F.sum(power).alias("p"), F.sum(count).alias("n"))
    load = E.simultaneous_load(F.col("p").cast("double"), F.col("n"), E.simultaneity(F.col("class")))
    return by_class.groupBy(*keys).agg(F.sum(load).alias("load"))


def grid_metrics(lines: DataFrame, loads: DataFrame, paths: DataFrame, key: str = "grid") -> DataFrame:
    """One row a grid: houses, households, power, cable length, distances, branches and their ratios.

    ``lines`` has the grid, length_km, parent; ``loads`` grid, bus, max_p_mw;
    ``paths`` grid, bus, distance and branch of every consumer bus.
    """
    cable = lines.groupBy(key).agg(F.sum("length_km").alias("cable_length_km"))
    power = loads.groupBy(key).agg(F.count("*").alias("no_households"), F.sum("max_p_mw").alias("max_power_mw"))
    far = paths.groupBy(key).agg(
        F.countDistinct("bus").alias("no_house_connections"), F.countDistinct("branch").alias("no_branches"), F.max("distance").alias("max_trafo_dis"), F.avg("distance").alias("avg_trafo_dis")
    )
    equal = F.col("max_power_mw") * 1000 / 30
    return cable.join(power, key).join(far, key).withColumns(
        {
            "no_household_equ": equal,
            "cable_len_per_house": F.try_divide("cable_length_km", "no_house_connections"),
            "no_house_connections_per_branch": F.try_divide("no_house_connections", "no_branches"),
            "no_households_per_branch": F.try_divide(equal, F.col("no_branches")),
        }
    )


def vsw(paths: DataFrame, lines: DataFrame, households: DataFrame) -> DataFrame:
    """(branch, resistance, reactance): resistance that the households of each branch see.

    Each consumer's path is exploded to its lines: household equivalents times
    length times ohm per km, with the simultaneity ``factor`` on resistance only.
    """
    steps = paths.join(households, "vertex").select("vertex", "branch", "h", F.explode(F.slice("path", F.lit(2), F.size("path"))).alias("line"))
    joined = steps.join(lines, "line")
    return joined.groupBy("branch").agg(
        F.sum(F.col("h") * F.col("length") * F.col("r") * F.col("factor")).alias("resistance"), F.sum(F.col("h") * F.col("length") * F.col("x")).alias("reactance")
    )


def settlement_class(distance: Column) -> Column:
    """3 where houses are near each other (below 25 m), 2 below 45 m, else 1."""
    return F.when(distance < 25, 3).when((distance >= 25) & (distance < 45), 2).otherwise(1)


def calinski_harabasz(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(k, n, ch): dispersion between the clusters over that within, each by its degrees of freedom."""
    each = rows.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], sum((F.sum(F.col(c) * F.col(c)) for c in columns), F.lit(0.0)).alias("sq"))
    centre = sum((F.col("n") * F.col(f"m_{c}") ** 2 for c in columns), F.lit(0.0))
    whole = each.agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("sq") - centre).alias("within"),
        (F.sum(centre) - sum((F.sum(F.col("n") * F.col(f"m_{c}")) ** 2 for c in columns), F.lit(0.0)) / F.sum("n")).alias("between"),
    )
    return whole.select("k", "n", ((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("ch"))


def davies_bouldin(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(db): mean over the clusters of the worst ratio of their spreads to their centres' distance."""
    centres = rows.groupBy(label).agg(*[F.avg(c).alias(f"m_{c}") for c in columns])
    far = F.sqrt(sum(((F.col(c) - F.col(f"m_{c}")) ** 2 for c in columns), F.lit(0.0)))
    spread = rows.join(F.broadcast(centres), label).groupBy(label).agg(F.avg(far).alias("s"))  # one row a cluster
    a = centres.join(spread, label)
    b = a.select(*[F.col(c).alias(f"o_{c}") for c in a.columns])
    apart = F.sqrt(sum(((F.col(f"m_{c}") - F.col(f"o_m_{c}")) ** 2 for c in columns), F.lit(0.0)))
    worst = a.join(F.broadcast(b), F.col(label) != F.col(f"o_{label}")).groupBy(label).agg(F.max((F.col("s") + F.col("o_s")) / apart).alias("r"))
    return worst.agg(F.avg("r").alias("db"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(ari): agreement of two labelings, corrected for chance."""
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    table = rows.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    both = table.agg(F.sum(pairs("n")).alias("both"), F.sum("n").alias("all"))
    left = table.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("left"))
    right = table.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("right"))
    by_chance = F.col("left") * F.col("right") / pairs("all")
    one = both.crossJoin(F.broadcast(left)).crossJoin(F.broadcast(right))
    return one.select(((F.col("both") - by_chance) / ((F.col("left") + F.col("right")) / 2 - by_chance)).alias("ari"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson's r of every pair of columns, in one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    one = rows.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def explained_variance(rows: DataFrame, columns: list[str]) -> list[tuple[int, float, float]]:
    """(component, share, cumulative share) of the principal components of the correlations.

    Only the matrix of columns by columns reaches the driver.
    """
    values = np.linalg.eigvalsh(_matrix(rows, columns))[::-1]
    share = values / values.sum()
    return [(i + 1, float(s), float(c)) for i, (s, c) in enumerate(zip(share, np.cumsum(share), strict=True))]


def _matrix(rows: DataFrame, columns: list[str]) -> np.ndarray:
    at = {c: i for i, c in enumerate(columns)}
    out = np.eye(len(columns))
    for r in correlations(rows, columns).collect():
        out[at[r["a"]], at[r["b"]]] = r["r"] if r["r"] is not None else float(r["a"] == r["b"])
    return out


def factors(rows: DataFrame, columns: list[str]) -> list[tuple[int, str, float]]:
    """(factor, column, loading): for every eigenvalue above 1, the column that loads most after a varimax rotation."""
    values, vectors = np.linalg.eigh(_matrix(rows, columns))
    keep = values > 1
    loadings = vectors[:, keep] * np.sqrt(values[keep])
    p, k = loadings.shape
    turn, last = np.eye(k), 0.0
    for _ in range(100):
        turned = loadings @ turn
        u, s, v = np.linalg.svd(loadings.T @ (turned**3 - turned * (turned**2).sum(axis=0) / p))
        turn = u @ v
        if s.sum() < last * (1 + 1e-8):
            break
        last = s.sum()
    turned = loadings @ turn
    return [(j + 1, columns[int(np.abs(turned[:, j]).argmax())], float(turned[np.abs(turned[:, j]).argmax(), j])) for j in range(k)]


def adequacy(rows: DataFrame, columns: list[str]) -> tuple[float, float]:
    """Bartlett's statistic of sphericity and the Kaiser-Meyer-Olkin measure."""
    r, n = _matrix(rows, columns), rows.count()
    p = len(columns)
    bartlett = -(n - 1 - (2 * p + 5) / 6) * np.log(max(np.linalg.det(r), 1e-300))
    inverse = np.linalg.pinv(r)
    partial = -inverse / np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    off = ~np.eye(p, dtype=bool)
    return float(bartlett), float((r[off] ** 2).sum() / ((r[off] ** 2).sum() + (partial[off] ** 2).sum()))


def deviation_from(rows: DataFrame, representatives: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(label, deviation): root mean square relative deviation from the representative, averaged over columns."""
    reps = representatives.select(label, *[F.col(c).alias(f"r_{c}") for c in columns])
    each = rows.join(reps, label).groupBy(label).agg(*[F.sqrt(F.avg(F.try_divide(F.col(c) - F.col(f"r_{c}"), F.col(f"r_{c}")) ** 2)).alias(c) for c in columns])
    return each.select(label, (sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)).alias("deviation"))


def mean_deviation(rows: DataFrame, representatives: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(clusters, deviation): ``deviation_from`` averaged over the clusters, each counting once; those without a deviation do not count."""
    return deviation_from(rows, representatives, label, columns).agg(F.count("deviation").alias("clusters"), F.avg("deviation").alias("deviation"))


def house_distance(points: DataFrame, key: str, neighbours: DataFrame) -> DataFrame:
    """(key, house_distance): the median over houses of the mean distance to their four nearest."""
    means = neighbours.groupBy(key, "house").agg((F.sum("distance") / 4).alias("m"))
    return means.groupBy(key).agg(F.percentile("m", F.lit(0.5)).alias("house_distance"))


def running_share(rows: DataFrame, order: str, value: str) -> Column:
    """A cumulative sum over a small table in order."""
    return F.sum(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
