"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import staged, unstage


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of the links (a, b); a component is named by its smallest id.

    Each round maps every node to its smallest neighbour, follows these pointers a
    few steps, and replaces the ends of the links by where they lead; links inside
    one node vanish.  Rounds are few (a star takes one), and nothing but the
    question whether links are left reaches the driver.

    All members of a large component point to one node.  Each of these joins has the
    unique pointers on its other side and is followed by a write, so adaptive
    execution splits the partition of such a node over tasks once it is large.
    """
    links = staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    found = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("to"))
        old = [links]
        for _ in range(2):
            ahead = step.select(F.col("id").alias("to"), F.col("to").alias("next"))
            step = staged(step.join(ahead, "to").select("id", F.col("next").alias("to")))
            old.append(step)
        if found is None:
            found = old.pop().withColumnRenamed("to", "component")
        else:
            on = step.select(F.col("id").alias("component"), "to")
            old.append(found)
            found = staged(found.join(on, "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        for end in ("a", "b"):
            links = links.join(step.withColumnsRenamed({"id": end, "to": "to_" + end}), end)
        links = staged(links.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a < b").distinct())
        unstage(*old)
    return found if found is not None else links.select(F.col("a").alias("id"), F.col("b").alias("component"))
