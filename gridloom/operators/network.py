"""Cable choice and the layout of low-voltage networks."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import electrical as E


def cables(spark: SparkSession, rows: tuple = E.STREET_CABLES) -> DataFrame:
    """The catalogue: cable, r and x in ohm per km, max_i_ka, q_mm2."""
    return spark.createDataFrame([(n, float(r), float(x), float(i), int(q)) for n, r, x, i, q in rows], "cable string, r double, x double, max_i_ka double, q_mm2 int")


def choose_cable(lines: DataFrame, key: str, current_ka: Column, distance_m: Column, catalogue: tuple = E.STREET_CABLES, drop_volts: Column | None = None) -> DataFrame:
    """``lines`` with ``cable`` and ``parallel``: the fewest parallel cables that carry the current and keep the voltage.

    ``drop_volts`` is the voltage that a line may lose, by default a share of the network's.

    Of those that do, the smallest cross-section, then the smaller name.  Numbers
    needed follow in closed form for each cable, so the choice is one expression
    over a catalogue of fixed size, without a join.
    """
    limit = F.lit(E.VOLTS * E.VOLTAGE_DROP) if drop_volts is None else drop_volts
    options = []
    for name, r, x, most_ka, q in catalogue:
        by_current = F.ceil(current_ka / most_ka - 1e-12)
        by_voltage = F.ceil(F.lit(math.hypot(r, x)) / limit * current_ka * distance_m - 1e-12)
        n = F.greatest(by_current, F.when(distance_m != 0, by_voltage).otherwise(0), F.lit(1)).cast("int")
        options.append(F.struct(n.alias("n"), F.lit(q).alias("q"), F.lit(name).alias("cable")))
    best = F.array_min(F.array(*options))
    return lines.withColumn("__best", best).withColumn("cable", F.col("__best.cable")).withColumn("parallel", F.col("__best.n")).drop("__best")


def branch_cut(nodes: DataFrame, keys: list[str], order: str, kind: str, power: str, count: str, limit_ka: float = E.BRANCH_LIMIT_KA) -> DataFrame:
    """Nodes of each path with the running ``load``, ``current_ka`` and whether they are still on the branch.

    Loads add up by class along the path; the first node is always on it, and the
    branch ends before the first later node that reaches the limit.
    """
    along = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    of_class = E.consumer_class(F.col(kind))
    load = F.lit(0.0)
    for name, share in E.SIMULTANEITY.items():
        p, n = (F.sum(F.when(of_class == name, F.col(c)).otherwise(0)).over(along) for c in (power, count))
        load = load + E.simultaneous_load(p.cast("double"), n, F.lit(share))
    rows = nodes.withColumn("load", load).withColumn("current_ka", E.branch_current_ka(F.col("load")))
    over = F.when((F.col("current_ka") >= limit_ka) & (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) > 1), F.col(order))
    first_over = F.min(over).over(Window.partitionBy(*keys))
    return rows.withColumn("on_branch", first_over.isNull() | (F.col(order) < first_over))


def lay_branches(nodes: DataFrame, key: str, limit_ka: float = E.BRANCH_LIMIT_KA) -> DataFrame:
    """(key, branch, nth, node, next, length, load, current_ka): the feeders of each network.

    ``nodes`` has the key, node, parent (towards the transformer; null at it),
    distance, and the consumers at the node as lists kinds, powers and counts; these
    are empty at junctions, which a feeder passes.  The
    farthest node that is not connected starts a branch, which takes up the nodes
    on its way to the transformer while its current stays below the limit.
    """

    def lay(group: pa.Table) -> pa.Table:
        at = {r["node"]: r for r in group.to_pylist()}
        number = lambda x: math.nan if x is None else x
        away = {v: number(r["distance"]) for v, r in at.items()}
        left = {v for v, r in at.items() if r["kinds"]}
        out, branch = [], 0
        for far in sorted(left, key=lambda v: (away[v], -v), reverse=True):
            if far not in left:
                continue
            taken, load, total, v = [], 0.0, {}, far
            while v is not None and v in at:
                r = at[v]
                if v in left:
                    # sums by class go on from node to node, in the order of coincident_load
                    for kind, power, count in zip(r["kinds"], r["powers"], r["counts"], strict=True):
                        of = total.setdefault("Residential" if kind in E.RESIDENTIAL_TYPES else kind, [0.0, 0.0])
                        of[0] += number(power)
                        of[1] += number(count)
                    now = 0.0
                    for c, (p, n) in total.items():
                        if n and c in E.SIMULTANEITY:
                            now += p * (E.SIMULTANEITY[c] + (1 - E.SIMULTANEITY[c]) * n**-0.75)
                    if taken and now / (E.VOLTS * E.LOWER_VOLTAGE_BAND * math.sqrt(3)) >= limit_ka:
                        break
                    taken.append(v)
                    load = now
                v = r["parent"]
            for nth, v in enumerate(taken):
                follows = taken[nth + 1] if nth + 1 < len(taken) else None
                length = away[v] - (away[follows] if follows is not None else 0.0)
                out.append((branch, nth, v, follows, length, load, load / (E.VOLTS * E.LOWER_VOLTAGE_BAND * math.sqrt(3))))
            left -= set(taken)
            branch += 1
        keys = group.column(key)[:1].to_pylist() * len(out)
        types = [group.schema.field(key).type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        columns = [keys, *(zip(*out, strict=True) if out else [[]] * 7)]
        names = [key, "branch", "nth", "node", "next", "length", "load", "current_ka"]
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    kind = dict(nodes.dtypes)[key]
    nodes = nodes.select(key, "node", "parent", "distance", "kinds", "powers", "counts")
    return nodes.groupBy(key).applyInArrow(lay, f"{key} {kind}, branch int, nth int, node long, next long, length double, load double, current_ka double")


def house_connections(houses: DataFrame, key: str, kind: str, power: str, count: str, length_m: str, catalogue: tuple = E.HOUSE_CABLES) -> DataFrame:
    """``houses`` with the ``load`` of their connection, its ``current_ka``, ``cable`` and ``parallel``.

    The cable may lose HOUSE_DROP_VOLTS, more above 100 kW.
    """
    share = E.simultaneity(E.consumer_class(F.col(kind)))
    rows = houses.withColumn("load", E.simultaneous_load(F.col(power).cast("double"), F.col(count), share)).withColumn("current_ka", E.branch_current_ka(F.col("load")))
    small, large = E.HOUSE_DROP_VOLTS
    drop = F.when(F.col("load") <= E.LARGE_CONSUMER_KW, F.lit(small)).otherwise(F.lit(large))
    return choose_cable(rows, key, F.col("current_ka"), F.col(length_m), catalogue, drop_volts=drop)


def buses(grids: DataFrame, connections: DataFrame, consumers: DataFrame) -> DataFrame:
    """(grid, bus, kind, zone, vn_kv): low- and medium-voltage, connection and consumer buses of every grid."""
    none = F.lit(None).cast("string")
    parts = [
        grids.select("grid", F.lit("LV").alias("bus"), F.lit("lv").alias("kind"), none.alias("zone"), F.lit(0.4).alias("vn_kv")),
        grids.select("grid", F.lit("MV").alias("bus"), F.lit("mv").alias("kind"), none.alias("zone"), F.lit(20.0).alias("vn_kv")),
        connections.select("grid", F.concat(F.lit("Connection Nodebus "), F.col("vertex")).alias("bus"), F.lit("connection").alias("kind"), none.alias("zone"), F.lit(0.4).alias("vn_kv")),
        consumers.select("grid", F.concat(F.lit("Consumer Nodebus "), F.col("vertex")).alias("bus"), F.lit("consumer").alias("kind"), F.col("kind").alias("zone"), F.lit(0.4).alias("vn_kv")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def household_loads(buildings: DataFrame, key: str) -> DataFrame:
    """One row for every household of a building: key, ``name`` and ``max_p_mw``."""
    rows = buildings.withColumn("j", F.explode(F.sequence(F.lit(1), F.greatest(F.col("units"), F.lit(1)))))
    power = F.when(F.col("kind").isin(*E.RESIDENTIAL_TYPES), F.lit(E.HOUSEHOLD_KW)).otherwise(F.col("peak")) / 1000
    return rows.select(key, F.concat(F.lit("household "), F.col("j")).alias("name"), power.alias("max_p_mw"))


def transformer_type(size: Column) -> tuple[Column, Column]:
    """(standard size, parallel units) of an installed size."""
    twin = size.isin(*[2 * c for c in E.MAPPED_CAPACITIES[2:]]) & ~size.isin(*E.MAPPED_CAPACITIES)
    many = ~size.isin(*E.MAPPED_CAPACITIES) & ~twin
    standard = F.when(twin, size / 2).when(many, F.lit(630)).otherwise(size).cast("int")
    return standard, F.when(twin, 2).when(many, F.ceil(size / 630)).otherwise(1).cast("int")
