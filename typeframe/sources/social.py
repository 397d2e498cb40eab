"""The workflow's two inputs: interactions as JSON lines, communities as graph XML."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeframe.operators.data import Data
from typeframe.plans.models import JSON, Relation

USER = T.StructType([T.StructField("id", T.StringType())])
POST = T.StructType([T.StructField("user", USER)])
#: Fixed shape of the lines; what is not named here is not read.
LINES = T.StructType([T.StructField("user", USER), T.StructField("retweeted_status", POST), T.StructField("quoted_status", POST)])
NODES = T.StructType([T.StructField("data", T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_key", T.StringType())])))])
KINDS = ("retweeted_status", "quoted_status")


def interactions(spark: SparkSession, path: str, kind: str, *, id_type: str = "string") -> Data:
    """The lines that have ``kind``, as the author and the post they refer to.

    A key that is present with null counts as absent.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}; there are {', '.join(KINDS)}")
    df = spark.read.schema(LINES).json(path).select("user", kind).filter(F.col(kind).isNotNull())
    if id_type != "string":
        df = df.withColumn("user", F.col("user").withField("id", F.col("user.id").cast(id_type))).withColumn(kind, F.col(kind).withField("user.id", F.col(f"{kind}.user.id").cast(id_type)))
    return Data(df, JSON)


def community_xml(spark: SparkSession, path: str, *, name_key: str = "v_name", community_key: str = "v_community") -> Data:
    """(node, community) from the node elements of a graph file."""
    rows = spark.read.format("xml").option("rowTag", "node").schema(NODES).load(path)
    value = lambda key: F.get(F.filter("data", lambda d: d["_key"] == key), F.lit(0))["_VALUE"]
    return Data(rows.select(value(name_key).alias("node"), value(community_key).cast("int").alias("community")), Relation)
