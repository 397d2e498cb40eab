"""Connected components by alternating large-star and small-star rounds.

Every edge points from a larger to a smaller id.  The large-star step links a
node's larger neighbours to its smallest one, the small-star step its smaller
neighbours; both keep components, and edges end as stars around each
component's smallest id.  A node's smallest neighbour is an aggregation that
combines before it shuffles, and the joins that follow read two written
tables, so Spark can split a hub's edges over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _star(edges: DataFrame, *, large: bool) -> DataFrame:
    """One star step over the written edges (a > b), which it discards."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components-least")
        # Larger neighbours v of u: the edges themselves, read from their smaller end.
        moved = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = materialise(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "components-least")
        moved = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = materialise(moved.filter("a != b").distinct(), "components-edges")
    discard(edges, least)
    return out


def components(edges: DataFrame, *, rounds: int = 50) -> DataFrame:
    """The nodes (``node``) of undirected ``edges`` (a, b) and their component's smallest id.

    Loops, repeated edges and either direction are allowed; rows with a null
    end are ignored; no edges give no rows.
    """
    now = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(now, "components-edges")
    before = _signature(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = _star(_star(now, large=True), large=False)
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
