"""Tagged datasets over streams: the same checks, on an unbounded DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeframe.functions.expressions import col
from typeframe.operators.data import Data
from typeframe.plans import schema_ops
from typeframe.plans.errors import SchemaError
from typeframe.plans.models import Model
from typeframe.plans.paths import quoted


def read_stream(spark: SparkSession, path: str, schema: T.StructType, model: Model, *, format: str = "parquet", time: str | None = None, **options: object) -> Data:
    """A stream of files whose schema conforms to ``model``.

    No model has timestamps; the top-level timestamp that ``time`` names is
    carried as Long, in microseconds since 1970.
    """
    carried = schema if time is None else schema_ops.replace_field(schema, time, None, T.LongType())
    if time is not None and not isinstance(schema_ops.select_field(schema, time).dataType, T.TimestampType):
        raise SchemaError(f"{time} is not a timestamp")
    model.validate(carried)
    df = spark.readStream.format(format).schema(schema).options(**options).load(path)
    return Data(df if time is None else df.withColumn(time, F.unix_micros(time)), model)


def windowed_edges(data: Data, time: str, source: object, dest: object, *, window: str, late: str) -> DataFrame:
    """Interactions counted by pair and event-time window, with late rows bounded by ``late``.

    The time is a Long of microseconds since 1970 or a String that Spark reads
    as a timestamp; rows without one are left out.  State is one count per
    open (window, pair), and a window's counts leave it once the watermark passes.
    """
    kind = schema_ops.select_field(data.schema, time).dataType
    at = {T.LongType: F.timestamp_micros, T.StringType: F.try_to_timestamp}.get(type(kind))
    if at is None:
        raise SchemaError(f"{time} is {kind.simpleString()}, not a time")
    for p in (source, dest):
        schema_ops.select_field(data.schema, p)
    df = data.to_df().select(at(F.col(quoted(time))).alias("_at"), col(source).column().alias("source"), col(dest).column().alias("dest")).filter("_at is not null")
    keyed = df.withWatermark("_at", late).groupBy(F.window("_at", window), "source", "dest")
    return keyed.agg(F.count(F.lit(1)).cast("int").alias("weight")).select(F.col("window.start").alias("start"), "source", "dest", "weight")
