"""Tables that cut the lineage of iterations, in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a session on one machine without it gets a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, shared_dir.own.removeprefix("file://"), ignore_errors=True)
    return shared_dir.own


def cut(df: DataFrame) -> DataFrame:
    """Write a table of an iteration to the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
