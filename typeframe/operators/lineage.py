"""Cutting lineage where a result is used many times."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _test_dir() -> str:
    return tempfile.mkdtemp(prefix="typeframe-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves a local master; a cluster's
    executors could not see it, so there the missing setting is an error.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _test_dir()


def working_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/typeframe/{name}-{uuid.uuid4().hex}"


def removed_at_exit(spark: SparkSession, path: str) -> None:
    """Let the driver's JVM delete a written path when it ends, since results read it until then."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back.

    Later uses read the table instead of planning and running its whole past
    again, also after an executor is lost.
    """
    spark = df.sparkSession
    path = working_path(spark, name)
    df.write.parquet(path)
    removed_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
