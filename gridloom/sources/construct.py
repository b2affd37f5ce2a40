"""Filling the table store from raw files: once for whole tables, and municipality by municipality for buildings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import projection
from gridloom.operators.relational import required
from gridloom.sources import files, shapefile
from gridloom.sources.catalog import SCHEMAS, Catalog

#: Kinds of building files by the beginning of their names, and the tables they fill.
TABLES = {"Res": "res", "Oth": "oth"}
#: The system that all tables are in.
SYSTEM = 3035


def construct(catalog: Catalog, csv: dict[str, str], transformers: str | None = None, system: int = 4326) -> list[str]:
    """Fill tables from CSV files by name, and the transformers from GeoJSON points in ``system``; names of what was filled.

    A table that exists is left as it is, so a construction that was cut off goes on where
    it ended.  Files must have a header and the columns of the table's schema in order.
    """
    done = []
    for name, path in csv.items():
        if not catalog.exists(name):
            catalog.write(name, required(files.read_csv(catalog.spark, path, SCHEMAS[name]), f"rows for {name}"))
            done.append(name)
    if transformers is not None and not catalog.exists("transformers"):
        rows = files.read_geojson(catalog.spark, transformers, "ogc_fid long, osm_id string, area double, power string, geom_type string, within_shopping boolean", polygons=False)
        rows = rows.withColumn("point", projection.reproject(F.col("point"), system, SYSTEM))
        catalog.write("transformers", required(rows, "transformers"))
        done.append("transformers")
    return done


def import_buildings(catalog: Catalog, folder: str, codes: list[int], system: int = 32633) -> list[int]:
    """Add the buildings of municipalities whose codes the ledger does not list; the codes that were added.

    Files are chosen by their names before any is opened, read in ranges of records, brought
    from ``system`` to that of the tables, and routed by kind.  A code without a file is an
    error.  All new codes are one job a table, partitioned by code; the ledger comes last, so
    an import that was cut off is repeated and replaces its partitions.
    """
    listed = {r["ags"] for r in catalog.read("ledger").where(F.col("ags").isin(codes)).select("ags").distinct().collect()}  # at most the codes asked for
    new = sorted(set(codes) - listed)
    if not new:
        return []
    found = shapefile.read(catalog.spark, folder).where(F.col("code").isin([str(c) for c in new]))
    there = {int(r["code"]) for r in found.select("code").distinct().collect()}  # at most the codes asked for
    if missing := sorted(set(new) - there):
        raise FileNotFoundError(f"no building files for {missing} in {folder}")
    for kind, name in TABLES.items():
        rows = _typed(found.where(F.col("kind") == kind), name, system)
        catalog.write(name, rows, ("ags",))
    listing = catalog.spark.createDataFrame([(c,) for c in new], "ags int").withColumn("at", F.current_timestamp())
    catalog.append("ledger", listing, ("ags",))
    return new


def _typed(rows: DataFrame, name: str, system: int) -> DataFrame:
    """Attributes as the columns of a table, with the ring in its system and the code as ``ags``."""
    columns = []
    for field in T.StructType.fromDDL(SCHEMAS[name]):
        if field.name == "ring":
            columns.append(F.when(F.col("ring").isNotNull(), projection.reproject_line(F.col("ring"), system, SYSTEM)).alias("ring"))
        else:
            text = F.when(F.trim(F.col("attributes")[field.name]) != "", F.col("attributes")[field.name])
            number = text.try_cast("double") if isinstance(field.dataType, (T.IntegerType, T.DoubleType)) else text
            columns.append(number.cast(field.dataType).alias(field.name))
    return rows.select(*columns, F.col("code").cast("int").alias("ags"))
