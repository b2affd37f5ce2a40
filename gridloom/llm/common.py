"""Reading tables, cutting lineage and running Arrow functions inside tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.textops import chunks
from gridloom.operators.graph import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage with files that outlive any executor; a lost executor
    costs at most the tasks that it was running.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame | None) -> None:
    """Delete the files of staged tables that nothing will read again."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()} if df is not None else ():
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def kept_columns(keep: tuple[str, ...], *results: str) -> list[str]:
    """``keep`` without columns that are named like a result: the result takes their place."""
    return [c for c in keep if c.lower() not in results]


def arrow_map(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, most: int = 1 << 20) -> DataFrame:
    """Apply ``fn`` to slices of at most ``most`` bytes of ``column``, or one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, column, most):
                yield fn(part)

    return df.mapInArrow(run, schema)


def strings(column: pa.Array) -> list[str]:
    """The values of a string column, nulls as empty strings."""
    return [x or "" for x in column.to_pylist()]


def crc_mod(id_column: str, modulus: int) -> F.Column:
    """crc32 of the id written as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus, F.lit(-1))


def with_copies(rows: DataFrame, a_part: int = 4096) -> DataFrame:
    """``rows`` with ``copy``: 0, 1, ... among rows that are equal in all columns.

    Equal rows are counted first, with partial counts, and no task numbers or emits more
    than ``a_part`` copies of a row from one row of its input.
    """
    names = rows.columns
    counted = rows.groupBy(*names).agg(F.count("*").alias("__n"))
    few = counted.where(F.col("__n") <= a_part).select(*names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("copy"))
    parts = counted.where(F.col("__n") > a_part).select(*names, "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(a_part).cast("long"))).alias("__from"))
    many = parts.repartition("__from", *names).select(*names, F.explode(F.sequence("__from", F.least(F.col("__from") + a_part, "__n") - 1)).alias("copy"))
    return few.unionByName(many)


def bounded_sample(df: DataFrame, key: str, most: int, salt: str = "sample") -> DataFrame:
    """About ``most`` rows of ``df``, never many more, chosen by a hash of ``key``.

    The choice depends only on the rows, not on how they are partitioned.  The
    caller may collect the result: its size has a bound that the data do not move.
    """
    total = df.count()
    if total > most:
        share = int(most / total * (1 << 32))
        df = df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(salt)), F.lit(1 << 32)) < share)
    return df


def unit(texts: list[str]) -> np.ndarray:
    """The bytes of texts joined by a zero byte."""
    return np.frombuffer("\0".join(texts).encode("utf-8", "surrogatepass"), dtype=np.uint8)
