"""Tables of the engine: their schemas, and a store of Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RING = "array<struct<x:double,y:double>>"

#: Schemas by table, as they are read from files and passed between stages.
SCHEMAS = {
    "res": f"osm_id string, area double, use string, building_t string, floors int, ring {RING}",
    "oth": f"osm_id string, area double, use string, free_walls int, ring {RING}",
    "ways": f"id long, clazz int, source long, target long, cost double, reverse_cost double, line {RING}",
    "postcode": f"gid int, plz int, note string, qkm double, einwohner int, ring {RING}",
    "transformers": "ogc_fid long, osm_id string, area double, power string, geom_type string, within_shopping boolean, point struct<x:double,y:double>",
    "municipal_register": "plz int, pop double, area double, lat double, lon double, ags int, name_city string, fed_state int, regio7 int, regio5 int, pop_den double",
    "equipment": "name string, s_max_kva int, max_i_a int, r_mohm_per_km int, x_mohm_per_km int, z_mohm_per_km int, cost_eur int, kind string, area int",
    "consumer_categories": "id int, definition string, peak_load double, yearly_consumption double, peak_load_per_m2 double, yearly_consumption_per_m2 double, sim_factor double",
    "grids": "version string, plz int, kcid int, bcid int, size_kva double",
    "lines": "version string, plz int, kcid int, bcid int, name string, from_bus string, to_bus string, length_km double, std_type string, parallel int",
    "buses": "version string, plz int, kcid int, bcid int, bus string, kind string, zone string, vn_kv double",
    "ledger": "ags int, at timestamp",
}


class Catalog:
    """Tables as Parquet folders under one root, partitioned where asked for.

    Rows are replaced partition by partition, so a repeated run of a stage leaves
    one copy of its result.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        """The folder of a table; an unknown name is an error."""
        if name not in SCHEMAS:
            raise ValueError(f"no table named {name!r}")
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        """Whether a table has been written."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, name: str) -> DataFrame:
        """A table, empty if it has not been written."""
        self.recover(name)
        if not self.exists(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(T.StructType.fromDDL(SCHEMAS[name])).parquet(self.path(name))

    def write(self, name: str, rows: DataFrame, partitions: tuple[str, ...] = ()) -> None:
        """Replace a table, or with ``partitions`` only those that ``rows`` holds."""
        writer = rows.write.mode("overwrite")
        if partitions:
            writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)
        writer.parquet(self.path(name))

    def append(self, name: str, rows: DataFrame, keys: tuple[str, ...] = ()) -> None:
        """Add rows; with ``keys``, only those whose keys the table lacks."""
        if keys and self.exists(name):
            rows = rows.join(self.read(name).select(*keys).distinct(), list(keys), "left_anti")
        rows.write.mode("append").parquet(self.path(name))

    def delete(self, name: str, **where: object) -> None:
        """Drop the rows whose columns equal the given values; rows with nulls there stay.

        The rest is written beside the table and then takes its place.  The old rows are
        moved aside and deleted last, so no moment is without them: ``recover`` puts
        them back after a crash.
        """
        doomed = F.lit(True)
        for column, value in where.items():
            doomed = doomed & F.col(column).eqNullSafe(F.lit(value))
        self.recover(name)
        if not self.exists(name):
            return
        target = self.path(name)
        self.read(name).where(~doomed).write.mode("overwrite").parquet(f"{target}.next")
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(target).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.rename(fs_path(target), fs_path(f"{target}.old"))
        fs.rename(fs_path(f"{target}.next"), fs_path(target))
        fs.delete(fs_path(f"{target}.old"), True)

    def recover(self, name: str) -> None:
        """Finish a ``delete`` that was cut off: a table moved aside comes back if nothing has taken its place."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        target, aside = fs_path(self.path(name)), fs_path(f"{self.path(name)}.old")
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(aside):
            if fs.exists(target):
                fs.delete(aside, True)
            else:
                fs.rename(aside, target)

    def delete_everywhere(self, **where: object) -> None:
        """Drop the rows with the given values from every table that has all of these columns."""
        for name in self.tables():
            if set(where) <= set(T.StructType.fromDDL(SCHEMAS[name]).names):
                self.delete(name, **where)

    def tables(self) -> list[str]:
        """Names of the tables that exist."""
        return [n for n in SCHEMAS if self.exists(n)]
