"""Clustering: capacity-bound bisection, greedy assignment, sites, and representatives.

Sequential algorithms run inside ``applyInPandas`` on groups of bounded size (one
supply area each); areas run in parallel.  Clusterings of whole tables iterate over
DataFrames: each round is one aggregation that returns a few rows a cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import electrical as E
from gridloom.functions.electrical import MAPPED_CAPACITIES, RESIDENTIAL_TYPES, SIMULTANEITY, SYNTHESISED_CAPACITIES
from gridloom.operators import models
from gridloom.operators.spatial import nearest, within_distance
from gridloom.operators.staging import cut

#: Points of a component above which it is split by k-means, and points of a part.
LARGE_COMPONENT, PART = 2000, 1000
#: Rows that one task may cut at medians; up to here the approximate medians of Spark are exact, so both ways agree.
NODE = 4000
#: Clusters below this size are accepted even if they are overloaded.
SMALLEST_SPLIT = 5
#: Longest connection to a mapped transformer, and the load that fills one.
REACH, FULL_KVA = 300.0, 630.0


def component_clusters(components: DataFrame, consumers: DataFrame, first: int = 0) -> DataFrame:
    """(component, n, action, parts, cluster): what becomes of each component.

    With several components, those of at most one consumer are dropped and those of
    ``LARGE_COMPONENT`` or more are split; clusters are numbered by component.
    """
    n = components.join(consumers.select("vertex", F.lit(1).alias("one")), "vertex", "left").groupBy("component").agg(F.coalesce(F.sum("one"), F.lit(0)).alias("n"))
    count = n.agg(F.count("*").alias("all"))
    action = F.when((F.col("all") > 1) & (F.col("n") <= 1), "drop").when(F.col("n") >= LARGE_COMPONENT, "split").otherwise("keep")
    parts = F.when(F.col("action") == "split", F.floor(F.col("n") / PART)).when(F.col("action") == "keep", 1).otherwise(0)
    out = n.crossJoin(F.broadcast(count)).withColumn("action", action).withColumn("parts", parts.cast("long"))
    before = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, -1)  # one row a component
    return out.select("component", "n", "action", "parts", F.when(F.col("action") != "drop", F.coalesce(F.sum("parts").over(before), F.lit(0)) + first + 1).alias("cluster"))


def coincident_load(kinds: list[str], powers: list[float], counts: list[float]) -> float:
    """Simultaneous load of consumers, by class: the form of the column expression for kernels.

    As there, a class without a share of simultaneous use carries no load.
    """
    total: dict[str, list[float]] = {}
    for kind, power, count in zip(kinds, powers, counts, strict=True):
        of = total.setdefault("Residential" if kind in RESIDENTIAL_TYPES else kind, [0.0, 0.0])
        of[0] += power
        of[1] += count
    return sum(p * (SIMULTANEITY[c] + (1 - SIMULTANEITY[c]) * n**-0.75) for c, (p, n) in total.items() if n and c in SIMULTANEITY)


def halves(distances: np.ndarray) -> np.ndarray:
    """The two clusters of average linkage: a label 0 or 1 of every point.

    Follows chains of nearest neighbours; a merge weighs distances by sizes.
    """
    n = len(distances)
    d = distances.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    sizes, members = np.ones(n), {i: [i] for i in range(n)}
    merges: list[tuple[float, int, list[int], list[int]]] = []
    chain: list[int] = []
    while len(members) > 1:
        if not chain:
            chain = [min(members)]
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        a = chain.pop()
        chain.pop()
        merges.append((float(d[a, b]), len(merges), members[a], members[b]))
        d[a] = d[:, a] = (sizes[a] * d[a] + sizes[b] * d[b]) / (sizes[a] + sizes[b])
        d[b] = d[:, b] = np.inf
        d[a, a] = np.inf
        sizes[a] += sizes[b]
        members[a] = members[a] + members.pop(b)
    labels = np.zeros(n, int)
    if merges:
        _, _, left, right = max(merges, key=lambda m: (len(m[2]) + len(m[3]) == n, m[0], m[1]))
        labels[right if min(left) < min(right) else left] = 1
    return labels


def bisect_by_capacity(points: DataFrame, key: str, capacities: tuple[int, ...] = SYNTHESISED_CAPACITIES, costs: DataFrame | None = None) -> DataFrame:
    """(key, point, cluster, load, size_kva): points of each area in clusters that a transformer can serve.

    ``points`` has the key, point, x, y, kind, power and count, and one row for every
    class of consumer at a point; an area of one point is one cluster.  Distances are straight
    or, with ``costs`` (key, i, j, cost), those of the network.  A cluster whose
    coincident load reaches the largest capacity is cut in two by average linkage,
    the oldest first, until it is served or has fewer than five points.
    """
    top = max(capacities)

    def size_of(load: float) -> float:
        single = min((c for c in capacities if c > load), default=math.inf)
        double = min((2 * c for c in capacities[2:4] if 2 * c > 1.15 * load), default=math.inf)
        return single if double > single else double

    def area(group: pd.DataFrame, network: pd.DataFrame | None = None) -> pd.DataFrame:
        at_point = {p: rows for p, rows in group.groupby("point", sort=True)}
        group = group.drop_duplicates("point").sort_values("point").reset_index(drop=True)
        users = [[at_point[p][c].tolist() for c in ("kind", "power", "count")] for p in group["point"]]
        if network is None:
            x, y = group["x"].to_numpy(float), group["y"].to_numpy(float)
            distances = np.hypot(x[:, None] - x[None, :], y[:, None] - y[None, :])
        else:
            place = {p: i for i, p in enumerate(group["point"])}
            i, j = network["i"].map(place), network["j"].map(place)
            known = i.notna() & j.notna()
            distances = np.full((len(group), len(group)), network["cost"].sum() + 1.0)
            distances[i[known].astype(int), j[known].astype(int)] = network["cost"][known]
            distances = np.minimum(distances, distances.T)
        queue, out = [np.arange(len(group))], []
        while queue:
            at = queue.pop(0)
            labels = halves(distances[np.ix_(at, at)])
            for part in (at[labels == side] for side in np.unique(labels)):
                load = coincident_load(*[[x for i in part for x in users[i][c]] for c in range(3)])
                if load >= top and len(part) >= SMALLEST_SPLIT:
                    queue.append(part)
                else:
                    out.append((part, load, size_of(load) if load < top else math.ceil(load)))
        rows = [(group[key].iloc[0], group["point"].iloc[i], c, load, float(size)) for c, (part, load, size) in enumerate(out) for i in part]
        return pd.DataFrame(rows, columns=[key, "point", "cluster", "load", "size_kva"])

    kind = dict(points.dtypes)
    schema = f"{key} {kind[key]}, point {kind['point']}, cluster long, load double, size_kva double"
    if costs is None:
        return points.groupBy(key).applyInPandas(lambda group: area(group), schema)
    empty = pd.DataFrame(columns=[key, "point", "cluster", "load", "size_kva"])
    return points.groupBy(key).cogroup(costs.groupBy(key)).applyInPandas(lambda group, network: area(group, network) if len(group) else empty, schema)


def assign_to_transformers(costs: DataFrame, consumers: DataFrame, key: str) -> DataFrame:
    """(key, consumer, transformer, cost, load, size_kva): consumers of each area given to mapped transformers.

    ``costs`` has the key, consumer, transformer and cost; ``consumers`` the key,
    consumer, kind, power and count, with one row for every class of user at a consumer.
    Pairs below ``REACH`` are taken from the
    cheapest on (then by consumer and transformer); a transformer that would reach
    630 kVA is full from then on.

    A pair can be decided once it is the cheapest left of its consumer and so are all
    cheaper ones of its transformer.  A round decides all such pairs of all areas by running sums
    over each transformer's pairs; consumers taken and transformers full leave the
    others.  The overall cheapest pair can always be decided, so the rounds end; no
    task holds an area.
    """
    users = _by_class(consumers, key)
    rest = users.columns[2:]
    cheapest = costs.where(F.col("cost") < REACH).groupBy(key, "consumer", "transformer").agg(F.min("cost").alias("cost"))
    given, _ = _decided(cut(cheapest.join(users, [key, "consumer"]).select(key, "consumer", "transformer", "cost", *rest)), key)
    return _sized(given, key)


def assign_within_reach(consumers: DataFrame, transformers: DataFrame, key: str) -> DataFrame:
    """``assign_to_transformers`` by straight distances, without a table of all pairs within reach.

    ``consumers`` also has x and y, the same in all rows of a consumer; ``transformers`` has
    transformer, tx and ty, and each serves every area with 630 kVA of its own.

    Pairs are taken by cost, so those of a distance can be decided before any farther one
    is known: a step looks for pairs from the distance done up to a larger one, of consumers
    not given yet and transformers not full.  The next distance is the largest halving of
    ``REACH`` that a count of both in cells finds few pairs for, and at least the next one.
    """
    places = consumers.groupBy(key, "consumer").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    left = cut(places.join(_by_class(consumers, key), [key, "consumer"]))
    rest = left.columns[4:]
    sites = cut(transformers.select("transformer", "tx", "ty").distinct())
    given = full = None
    done, after = 0.0, HALVINGS + 1
    while after:
        after = _next_reach(left, sites, after)
        reach = REACH / 2**after
        near = within_distance(left, sites, reach, ("x", "y"), ("tx", "ty"), strict=True).where(F.col("distance") >= done)
        pairs = near.select(key, "consumer", "transformer", F.col("distance").alias("cost"), *rest)
        if given is None:
            given, full = _decided(cut(pairs), key)
        else:
            pairs = cut(pairs.join(full, [key, "transformer"], "left_anti"))
            offered = pairs.select(key, "transformer").distinct()
            # those given before come first in the running sums of their transformers
            before = given.join(offered, [key, "transformer"], "left_semi").select(pairs.columns)
            more, filled = _decided(cut(pairs.unionByName(before)), key)
            given = cut(given.join(offered, [key, "transformer"], "left_anti").unionByName(more))
            full = cut(full.unionByName(filled))
        if after:
            left = cut(left.join(given, [key, "consumer"], "left_anti"))
            if left.isEmpty():
                break
        done = reach
    return _sized(given, key)


#: Halvings of ``REACH`` that ``assign_within_reach`` may begin with, and the pairs of a step: by consumer, and always allowed.
HALVINGS, STEP_PAIRS, SMALL_STEP = 10, 16, 4_000_000


def _next_reach(left: DataFrame, sites: DataFrame, after: int) -> int:
    """The fewest halvings of ``REACH``, less than ``after``, within which there are few pairs by a count in cells."""
    size = REACH / 2**HALVINGS
    fine = lambda df, x, y: df.groupBy(*[F.floor(F.col(c) / size).cast("long").alias(n) for n, c in (("cx", x), ("cy", y))]).agg(F.count("*").alias("n"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(after - 1)))

    def at_levels(df: DataFrame, n: str) -> DataFrame:
        rows = df.withColumn("l", levels).withColumn("s", F.lit(HALVINGS) - F.col("l"))
        return rows.groupBy("l", F.expr("shiftright(cx, s)").alias("cx"), F.expr("shiftright(cy, s)").alias("cy")).agg(F.sum("n").alias(n))

    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    there = at_levels(fine(sites, "tx", "ty"), "t").withColumn("i", around).withColumn("j", around)
    there = there.groupBy("l", (F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy")).agg(F.sum("t").alias("t"))
    here = at_levels(fine(left, "x", "y"), "c")
    met = here.join(there, ["l", "cx", "cy"], "left").groupBy("l").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("t")).alias("pairs"))
    few = [r["l"] for r in met.collect() if (r["pairs"] or 0) <= max(SMALL_STEP, STEP_PAIRS * r["c"])]  # a row a halving
    return min(few, default=after - 1)


def _by_class(consumers: DataFrame, key: str) -> DataFrame:
    """(key, consumer, ...): power and count of each consumer by class of simultaneous use."""
    of_class = E.consumer_class(F.col("kind"))
    only = lambda name, c: F.sum(F.when(of_class == name, F.col(c).cast("double")).otherwise(0.0)).alias(f"__{c}_{name}")
    return consumers.groupBy(key, "consumer").agg(*[only(name, c) for name in E.SIMULTANEITY for c in ("power", "count")])


def _load_of(total: Callable[[str], Column]) -> Column:
    return sum((E.simultaneous_load(total(f"__power_{name}"), total(f"__count_{name}"), F.lit(share)) for name, share in E.SIMULTANEITY.items()), F.lit(0.0))


def _sized(given: DataFrame, key: str) -> DataFrame:
    sizes = given.groupBy(key, "transformer").agg(_load_of(F.sum).alias("load"))
    sizes = sizes.select(key, "transformer", "load", E.next_capacity(F.col("load"), MAPPED_CAPACITIES).cast("long").alias("size_kva"))
    return given.join(sizes, [key, "transformer"]).select(key, "consumer", "transformer", "cost", "load", "size_kva")


def _decided(pairs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The pairs of (key, consumer, transformer, cost, ...) that are given, and (key, transformer) of those full.

    A transformer none of whose pairs waits leaves the rounds.
    """
    columns = pairs.columns
    own, of = Window.partitionBy(key, "consumer"), Window.partitionBy(key, "transformer")
    before = of.orderBy("cost", "consumer").rowsBetween(Window.unboundedPreceding, 0)
    load = _load_of(lambda c: F.sum(c).over(before))
    given, full = [], []
    while True:
        ranked = pairs.withColumn("nth", F.row_number().over(own.orderBy("cost", "transformer")))
        summed = ranked.withColumns({"waits": F.max(F.col("nth") > 1).over(before), "open": F.max(F.col("nth") > 1).over(of), "load": load})
        judged = summed.withColumn("full", F.max(~F.col("waits") & (F.col("load") >= FULL_KVA)).over(before)).withColumn("given", ~F.col("waits") & ~F.col("full"))
        judged = judged.withColumn("taken", F.max("given").over(own)).where(F.col("full") | F.col("given") | ~F.col("taken"))
        judged = cut(judged.select(*columns, "given", "full", "open"))
        full.append(judged.where("full").select(key, "transformer").distinct())
        given.append(judged.where("given and not open").select(columns))
        pairs = judged.where("open and not full")
        if pairs.where("not given").isEmpty():
            given.append(pairs.select(columns))
            return reduce(DataFrame.unionByName, given), cut(reduce(DataFrame.unionByName, full).distinct())
        pairs = pairs.select(columns)


def weighted_median_site(distances: DataFrame, loads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., site, moment): of each group the point with the least load-weighted distance to all.

    ``distances`` has the keys, i, j and cost; ``loads`` the keys, j and load.
    """
    moments = distances.join(loads, [*keys, "j"]).groupBy(*keys, "i").agg(F.sum(F.col("cost") * F.col("load")).alias("moment"))
    return moments.groupBy(*keys).agg(F.min(F.struct("moment", "i")).alias("m")).select(*keys, F.col("m.i").alias("site"), F.col("m.moment").alias("moment"))


#: Sites of an area that are probed in one round of ``weighted_median_point``, as the side of a square of cells.
PROBES = 4


def weighted_median_point(points: DataFrame, key: str, tolerance: float = 1e-3) -> DataFrame:
    """(key, site, moment): of each area the point with the least load-weighted straight distance to all its points.

    ``points`` has the key, id, x, y and load.  The moment is convex, so its slope at a
    probed site bounds it from below everywhere.  A round probes at most PROBES * PROBES
    sites of what is left of each area, spread over its cells, and drops all sites whose
    bound is above the best moment found; it reads each point once a probe and emits no pairs.
    The moment is exact, rounded to ``tolerance``; among equals the smaller id is taken.
    Null coordinates take no part; null and negative loads count as none; an area
    without load gives its smallest id and a moment of 0.
    """
    digits = max(0, round(-math.log10(tolerance)))
    load = F.greatest(F.coalesce(F.col("load").cast("double"), F.lit(0.0)), F.lit(0.0))
    known = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    at = cut(known.groupBy(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min("id").alias("id"), F.sum(load).alias("load")))
    loaded = at.groupBy(key).agg(F.sum("load").alias("all"), F.min("id").alias("id"))
    found = cut(loaded.where("all <= 0").select(key, "id", F.lit(0.0).alias("moment")))
    left = cut(at.join(loaded.where("all > 0").select(key), key, "left_semi").select(key, "id", "x", "y"))
    best = found
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    distance = F.sqrt(dx * dx + dy * dy)
    slope = lambda d: F.sum(F.when(distance > 0, F.col("load") * d / distance).otherwise(0.0))
    while not left.isEmpty():
        box = left.groupBy(key).agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))])
        cell = [F.least(F.floor((F.col(c) - F.col(f"low_{c}")) / F.greatest(F.col(f"high_{c}") - F.col(f"low_{c}"), F.lit(1e-9)) * PROBES), F.lit(PROBES - 1)).alias(f"cell_{c}") for c in "xy"]
        picked = left.join(box, key).groupBy(key, *cell).agg(F.min(F.struct("id", "x", "y")).alias("p"))
        probes = cut(picked.select(key, F.col("p.id").alias("probe"), F.col("p.x").alias("px"), F.col("p.y").alias("py")))
        # the points of an area meet its few probes; partial sums leave one row a probe and task
        measured = cut(
            at.join(probes, key).groupBy(key, "probe", "px", "py").agg(F.sum(F.col("load") * distance).alias("moment"), slope(dx).alias("gx"), slope(dy).alias("gy"))
        )
        tried = best.unionByName(measured.select(key, F.col("probe").alias("id"), F.round("moment", digits).alias("moment")))
        best = cut(tried.groupBy(key).agg(F.min(F.struct("moment", "id")).alias("m")).select(key, F.col("m.id").alias("id"), F.col("m.moment").alias("moment")))
        planes = measured.groupBy(key).agg(F.collect_list(F.struct("probe", "moment", "px", "py", "gx", "gy")).alias("planes"))  # at most PROBES * PROBES
        plane = lambda p: p["moment"] + p["gx"] * (F.col("x") - p["px"]) + p["gy"] * (F.col("y") - p["py"])
        bound = F.array_max(F.transform("planes", plane))
        open_ = (bound <= F.col("moment") * (1 + 1e-9) + tolerance) & ~F.exists("planes", lambda p: p["probe"] == F.col("id"))
        left = cut(left.join(planes, key).join(best.select(key, "moment"), key).where(open_).select(key, "id", "x", "y"))
    return best.select(key, F.col("id").alias("site"), "moment")


def k_means(rows: DataFrame, columns: list[str], key: str, k: int) -> tuple[DataFrame, list[list[float]]]:
    """Rows with ``cluster`` and ``sq_distance``, and the centres, by Lloyd's rounds from a spread start.

    Rounds end when no centre moves, at the latest after ``models.MOST_ROUNDS``.
    """
    return _fitted(rows, columns, key, k, "kmeans")


def representatives(labelled: DataFrame, key: str, order: str) -> DataFrame:
    """(cluster, representative): the row nearest to each centre; clusters renumbered from 0 by its ``order``."""
    nearest = labelled.groupBy("cluster").agg(F.min(F.struct("sq_distance", key, order)).alias("r")).select("cluster", F.col(f"r.{key}").alias("representative"), F.col(f"r.{order}").alias("__o"))
    nth = F.row_number().over(Window.orderBy("__o", "cluster")) - 1  # one row a cluster
    return nearest.select(F.col("cluster").alias("old"), nth.alias("cluster"), "representative")


def k_medoids(rows: DataFrame, columns: list[str], key: str, k: int) -> tuple[DataFrame, list[list[float]]]:
    """Rows with ``cluster`` and ``sq_distance``, and the medoids: alternate assignment and the best member of each cluster.

    Rounds end when no medoid changes, at the latest after ``models.MOST_ROUNDS``.
    """
    return _fitted(rows, columns, key, k, "kmedoids")


def gaussian_mixture(rows: DataFrame, columns: list[str], key: str, k: int, shape: str = "tied") -> DataFrame:
    """Rows with ``cluster`` by a Gaussian mixture whose covariances have a ``shape``.

    Shapes are full (one matrix a component), tied (one for all), diag (variances) and
    spherical (one variance a component).  Rounds end when the mean likelihood grows by
    less than a thousandth, at the latest after ``models.MIXTURE_ROUNDS``.
    """
    return _fitted(rows, columns, key, k, shape)[0].drop("sq_distance")


def _model(algorithm: str, centres: np.ndarray, variances: np.ndarray) -> models.Model:
    if algorithm in ("kmeans", "kmedoids"):
        return (models.KMeans if algorithm == "kmeans" else models.KMedoids)(centres)
    return models.Mixture(centres, variances, algorithm)


def _fitted(rows: DataFrame, columns: list[str], key: str, k: int, algorithm: str) -> tuple[DataFrame, list[list[float]]]:
    rows = cut(rows)
    points = cut(models.packed(rows, columns, key))
    model = _model(algorithm, models.spread_start(points, k), models.variances(points, len(columns)))
    models.fit(points, [model])
    centres = model.means if isinstance(model, models.Mixture) else model.centres
    return models.labelled(rows, columns, model), centres.tolist()


def halved(points: DataFrame, group: str, parts: str) -> DataFrame:
    """``points`` (group, x, y, parts, ...) with ``__node``: each group cut at medians along its wider side into its number of parts.

    Groups are halved in rounds until all that is left to cut has at most NODE rows; one
    task then finishes each of these.  Points without a coordinate stay on the left.
    """
    rows = cut(points.withColumns({"__node": F.lit(1).cast("long"), "__todo": F.col(parts).cast("long")}))
    is_open = F.coalesce(F.col("__todo") > 1, F.lit(False))
    while not rows.where(is_open).groupBy(group, "__node").count().where(F.col("count") > NODE).isEmpty():
        open_nodes = rows.where(is_open).groupBy(group, "__node").agg(
            F.coalesce((F.max("x") - F.min("x")) >= (F.max("y") - F.min("y")), F.lit(False)).alias("__wide"), F.percentile_approx("x", 0.5, 10_000).alias("__mx"), F.percentile_approx("y", 0.5, 10_000).alias("__my")
        )
        right = F.coalesce(F.when(F.col("__wide"), F.col("x") > F.col("__mx")).otherwise(F.col("y") > F.col("__my")), F.lit(False))
        half = F.when(right, F.floor(F.col("__todo") / 2)).otherwise(F.ceil(F.col("__todo") / 2))
        moved = rows.join(open_nodes, [group, "__node"], "left").withColumn("__right", right)
        rows = cut(
            moved.withColumns(
                {
                    "__node": F.when(F.col("__wide").isNull(), F.col("__node")).otherwise(F.col("__node") * 2 + F.col("__right").cast("long")),
                    "__todo": F.when(F.col("__wide").isNull(), F.col("__todo")).otherwise(half).cast("long"),
                }
            ).drop("__wide", "__mx", "__my", "__right")
        )

    def finish(node: pa.Table) -> pa.Table:
        x, y = (node.column(c).to_numpy() for c in ("x", "y"))
        names = np.empty(len(x), np.int64)
        known = lambda v: v[v == v]
        span = lambda v: np.ptp(known(v)) if len(known(v)) else -np.inf
        work = [(np.arange(len(x)), *(node.column(c)[0].as_py() for c in ("__node", "__todo")))]
        while work:
            at, name, todo = work.pop()
            names[at] = name
            if todo > 1 and len(at):
                side = x[at] if span(x[at]) >= span(y[at]) else y[at]
                seen = np.sort(known(side))
                right = side > seen[(len(seen) - 1) // 2] if len(seen) else np.zeros(len(at), bool)
                work += [(at[~right], 2 * name, (todo + 1) // 2), (at[right], 2 * name + 1, todo // 2)]
        return node.set_column(node.schema.get_field_index("__node"), "__node", pa.array(names))

    finished = rows.where(is_open).groupBy(group, "__node").applyInArrow(finish, rows.schema)
    return cut(rows.where(~is_open).unionByName(finished).drop("__todo"))


def bounded_areas(points: DataFrame, group: str, most: int = PART) -> DataFrame:
    """``points`` (group, x, y, ...) with ``area``, the part of its group that a point is in.

    Groups are cut at medians, so that a kernel gets about ``most`` points at once however
    large the group is.  Points at one place stay together; a column
    named area is replaced.
    """
    parts = points.groupBy(group).agg(F.ceil(F.count("*") / F.lit(most)).cast("long").alias("__parts"))
    rows = halved(points.join(parts, group), group, "__parts")
    rows = rows.drop("area")
    number = rows.select(group, "__node").distinct().withColumn("area", F.dense_rank().over(Window.orderBy(group, "__node")).cast("long"))  # one row an area
    return rows.join(number, [group, "__node"]).drop("__node", "__parts")


def place_clusters(points: DataFrame, group: str, parts: str, rounds: int = 50) -> DataFrame:
    """``points`` (group, id, x, y, parts, ...) with ``part``: k-means of each group into its number of parts.

    Start centres come from halving at medians along the wider side, which no task has
    to sort a group for; each round gives points to their nearest centre by
    cells and moves the centres, until none moves, at the latest after ``rounds``.
    """
    rows, last = halved(points, group, parts), None
    for _ in range(rounds):
        centres = cut(rows.groupBy(F.col(group).alias("__of"), F.col("__node").alias("__c")).agg(F.avg("x").alias("__x"), F.avg("y").alias("__y")))
        if last is not None:
            moved = centres.join(last, ["__of", "__c"], "left").where(F.coalesce(F.hypot(F.col("__x") - F.col("__ox"), F.col("__y") - F.col("__oy")) > 1e-6, F.lit(True)))
            if moved.isEmpty():
                break
        last = centres.select("__of", "__c", F.col("__x").alias("__ox"), F.col("__y").alias("__oy"))
        found = nearest(rows.drop("__node"), centres.withColumn("__name", F.struct("__of", "__c")), 1, "id", "__name", ("x", "y"), ("__x", "__y"), (group, "__of"))
        rows = cut(found.withColumn("__node", F.col("__c")).select(*points.columns, "__node"))
    number = rows.select(group, "__node").distinct().withColumn("part", F.row_number().over(Window.partitionBy(group).orderBy("__node")) - 1)  # one row a part
    return rows.join(number, [group, "__node"]).drop("__node")


def index_sweep(rows: DataFrame, columns: list[str], key: str, numbers: range = range(3, 8), algorithms: tuple[str, ...] = ("kmeans", "kmedoids", "full", "tied", "diag", "spherical")) -> DataFrame:
    """(algorithm, k, ch, db): both indices of each clustering of the rows; a large ch and a small db are good.

    All clusterings are fitted in the same passes; start centres of fewer clusters are the
    first of those of more.
    """
    points = cut(models.packed(rows, columns, key))
    centres, variances = models.spread_start(points, max(numbers)), models.variances(points, len(columns))
    names = [(name, k) for name in algorithms for k in numbers]
    all_ = [_model(name, centres[:k], variances) for name, k in names]
    models.fit(points, all_)
    found = models.indices(points, all_, [k for _, k in names], len(columns))
    return rows.sparkSession.createDataFrame([(name, k, ch, db) for (name, k), (ch, db) in zip(names, found, strict=True)], "algorithm string, k int, ch double, db double")
