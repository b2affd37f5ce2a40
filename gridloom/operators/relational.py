"""Relational operators: duplicates, flags, keyed inserts, bins, shares and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filter_equal(df: DataFrame, **values: object) -> DataFrame:
    """Rows whose columns equal the given values; values are literals and never part of a query text."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in values.items()], F.lit(True)))


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row of each key, the first in ``order``."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")


def drop_marked_duplicates(df: DataFrame, key: str, mark: Column) -> DataFrame:
    """Drop marked rows whose key occurs more than once; rows with a null key stay.

    Keys are counted first, so no task gathers the rows of a frequent key.
    """
    counts = df.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n")).where("__n > 1")
    joined = df.join(counts, F.col(key) == F.col("__key"), "left")
    return joined.where(F.col("__n").isNull() | ~F.coalesce(mark, F.lit(False))).drop("__key", "__n")


def flag_matches(df: DataFrame, other: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Set ``flag`` where the keys occur in ``other``; elsewhere it keeps its value."""
    hit = other.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return df.join(hit, keys, "left").withColumn(flag, F.when(F.col("__hit"), True).otherwise(F.col(flag))).drop("__hit")


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with those of ``rows`` whose keys it lacks."""
    return table.unionByName(rows.join(table.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def unfinished(all_rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those done; nulls among the done rule nothing out."""
    return all_rows.join(done.where(F.col(key).isNotNull()).select(key), key, "left_anti")


def required(rows: DataFrame, what: str) -> DataFrame:
    """``rows``, or an error that names ``what`` if there are none."""
    if rows.isEmpty():
        raise ValueError(f"there are no {what}")
    return rows


def only_ones(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys no other row has."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n = 1").drop("__n")
    return df.join(counts, keys, "left_semi")


def sampled(df: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    """About ``percent`` of the rows, chosen at random: a sampling operator."""
    return df.sample(percent / 100, seed)


def replaced(sample: DataFrame, key: str, value: object, population: DataFrame, alike: list[str]) -> DataFrame:
    """``sample`` with the row of ``value`` exchanged for the first of ``population`` that is like it in ``alike`` and not in the sample.

    The row stays if there is none.
    """
    gone = sample.where(F.col(key) == F.lit(value))
    free = population.join(sample.select(key), key, "left_anti").join(gone.select(*alike).distinct(), alike, "left_semi")
    new = free.orderBy(key).limit(1).select(*sample.columns)
    lonely = gone.join(F.broadcast(new.select(F.lit(True).alias("__found"))), how="left").where("__found IS NULL").drop("__found")
    return sample.where(F.col(key) != F.lit(value)).unionByName(new).unionByName(lonely)


def sorted_entries(entries: Column, descending: bool = False) -> Column:
    """A map from text to values as an array of (key, value), in the order of its keys as whole numbers."""
    numbered = F.transform(F.map_entries(entries), lambda e: F.struct(e["key"].cast("long").alias("k"), e["key"].alias("key"), e["value"].alias("value")))
    return F.transform(F.sort_array(numbered, not descending), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, low, high, n): equal-width bins from the least to the largest value, empty ones too.

    Bins are closed on the right, the first also on the left.
    """
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    placed = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).select(bin_of(F.col(value), F.col("lo"), F.col("hi"), bins).alias("bin"))
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    edges = ends.select("lo", ((F.col("hi") - F.col("lo")) / bins).alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    low = F.col("lo") + F.col("bin") * F.col("width")
    return edges.select("bin", low.alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high")).join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """The bin of a value among right-closed bins of equal width, from 0."""
    at = F.ceil(F.coalesce(F.try_divide((value - low) * bins, high - low), F.lit(0.0))) - 1
    return F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int")


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation; 0 where they do not vary."""
    stats = df.agg(*[f(c).alias(f"__{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scored = {f"{c}": F.coalesce(F.try_divide(F.col(c) - F.col(f"__{c}_m"), F.col(f"__{c}_s")), F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scored).drop(*[f"__{c}_{n}" for c in columns for n in "ms"])


def shares(df: DataFrame, value: str, within: list[str] | None = None) -> DataFrame:
    """(within..., value, n, percent): how often each value occurs, in percent of its group."""
    within = within or []
    counts = df.groupBy(*within, value).agg(F.count("*").alias("n"))
    total = counts.groupBy(*within).agg(F.sum("n").alias("__all"))
    joined = counts.join(total, within) if within else counts.crossJoin(F.broadcast(total))
    return joined.withColumn("percent", F.col("n") * 100.0 / F.col("__all")).drop("__all")


def stratified_sample(df: DataFrame, stratum: str, sizes: DataFrame, key: Column) -> DataFrame:
    """Of each stratum the ``n`` rows with the smallest ``key``; ``sizes`` has the stratum and n."""
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(key))
    return df.join(F.broadcast(sizes), stratum).withColumn("__nth", nth).where("__nth <= n").drop("__nth", "n")


def allocation(df: DataFrame, stratum: str, population: str, total: int) -> DataFrame:
    """(stratum, n): ``total`` shared by population, rounded half to even."""
    sums = df.groupBy(stratum).agg(F.sum(population).alias("p"))
    whole = sums.agg(F.sum("p").alias("all"))
    return sums.crossJoin(F.broadcast(whole)).select(stratum, F.bround(F.col("p") / F.col("all") * total).cast("long").alias("n"))


def null_free_columns(df: DataFrame) -> DataFrame:
    """Only the columns without a null."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if not counts[c]])


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: int = 1000) -> DataFrame:
    """``left`` joined to ``right``, whose keys are unique, without gathering the rows of a frequent key.

    Keys that hold at least one in ``share`` rows of ``left`` are ``share`` at most, so
    their rows of ``right`` are broadcast; all other rows meet in a shuffle.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("__all"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("__n") * share >= F.col("__all")).select(*keys)
    of_hot = right.join(F.broadcast(hot), keys, "left_semi")
    rest = left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how)
    if how == "left":  # a frequent key that right lacks keeps its rows
        of_hot = hot.join(of_hot, keys, "left")
    return rest.unionByName(left.join(F.broadcast(of_hot), keys))
