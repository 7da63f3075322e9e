"""Keeping a table that several analyses read: nothing, the executors' storage, or the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

REUSE = ("none", "persist", "table")


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can reach, as the cluster names it.

    Where it is unset and Spark runs inside this process, one of this machine is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tablescope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str = "table") -> str:
    """A new place below the shared folder, removed when the session's process ends."""
    location = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return location


def remove(spark: SparkSession, location: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str = "table", **options: str) -> DataFrame:
    """The rows as a table in the shared folder: read several times, computed once, safe when executors are lost.

    ``options`` go to the Parquet writer.
    """
    location = new_folder(df.sparkSession, label)
    df.write.options(**options).parquet(location)
    return df.sparkSession.read.schema(df.schema).parquet(location)


def reusable(df: DataFrame, how: str, counted: Observation | None = None) -> DataFrame:
    """``persist`` is rebuilt from the source when executors are lost; ``table`` is written once and read back.

    ``counted`` receives the number of ``rows`` while the table is written.
    """
    if how not in REUSE:
        raise ValueError(f"reuse must be one of {REUSE}, got {how!r}")
    if how == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if how == "none":
        return df
    return written(df if counted is None else df.observe(counted, F.count(F.lit(1)).alias("rows")))


def release(df: DataFrame, how: str) -> None:
    """Give back what ``reusable`` has taken."""
    if how == "persist":
        df.unpersist()
    elif how == "table":
        for location in {f.rpartition("/")[0] for f in df.inputFiles()}:
            remove(df.sparkSession, location)
