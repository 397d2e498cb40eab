"""Tagged datasets from and to files: the format and schema are given, the model is checked."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from typeframe.operators.data import Data
from typeframe.plans.models import Model

FORMATS = ("parquet", "orc", "json", "csv", "xml")


def read(spark: SparkSession, path: str, model: Model, *, format: str = "parquet", schema: T.StructType | None = None, **options: object) -> Data:
    """Read files; a given schema is checked before the files are touched."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format}; there are {', '.join(FORMATS)}")
    if schema is not None:
        model.validate(schema)
    reader = spark.read.format(format).options(**options)
    return Data((reader.schema(schema) if schema is not None else reader).load(path), model)


def write(data: Data, path: str, *, format: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options: object) -> None:
    if format not in FORMATS:
        raise ValueError(f"unknown format {format}; there are {', '.join(FORMATS)}")
    data.to_df().write.format(format).mode(mode).options(**options).partitionBy(*partition_by).save(path)
