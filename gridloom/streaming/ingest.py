"""Incremental ingest that never loads a unit twice.

The reference keeps a ledger of imported municipalities; here the ledger is a table
and a unit is skipped if it is listed.  As an extension, files that arrive later can
be followed as a stream with the same guard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.staging import cut
from gridloom.sources.catalog import Catalog


def load_once(catalog: Catalog, name: str, rows: DataFrame, key: str = "ags") -> None:
    """Append rows of units that the ledger does not list, and list them.

    Rows come before the ledger.  A load that was cut off between the two is finished by
    the next one: units whose rows the table holds already are listed and not appended
    again.  A table without the column ``key`` cannot tell, so there the rows would
    come twice.
    """
    new = rows.join(catalog.read("ledger").select(F.col("ags").alias(key)).distinct(), key, "left_anti")
    units = new.select(F.col(key).alias("ags")).distinct().select("ags", F.current_timestamp().alias("at"))
    units = cut(units)  # the rows that are appended next must not change it
    held = key in catalog.read(name).columns
    catalog.append(name, new if held else new.drop(key), (key,) if held else ())
    catalog.append("ledger", units, ("ags",))


def follow(catalog: Catalog, name: str, stream: DataFrame, checkpoint: str, key: str = "ags") -> StreamingQuery:
    """Load every micro-batch of a stream of files with ``load_once``."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: load_once(catalog, name, batch, key)).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events by type and window of time, closed once nothing older can come."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
