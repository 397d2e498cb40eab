"""A corpus pipeline of five stages, each written as Parquet before the next.

Quality classifier, toxicity, line dedup, near-duplicate join and packing, in
this order.  Every stage works on all documents that its predecessor kept.

A stage's result must be written before the next stage is called, which then
removes its predecessor's working tables.  Documents without an id or a text
pass through the stages as their operators state; columns beside the text are
carried, whatever their names, but for ``n_chars``, which follows the text if
it is there.  No documents give no rows.
"""

from __future__ import annotations

import functools
import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeframe.llm import byte_cnn, jaccard_join, line_dedup, packing, toxicity
from typeframe.llm.common import remove, scratch, shared_dir, table

#: Tables that the running stage reads from; the next stage's docs no longer need them.
_HELD: list[str] = []


def stage(f):
    """A stage that first removes what its predecessor had to keep until its result was written."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _HELD)
        _HELD.clear()
        with scratch() as paths:
            out = f(spark, docs, sf_dir)
        _HELD.extend(paths)
        return out

    return run


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; a null text is judged as an empty one."""
    return byte_cnn.score_quality(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select(*docs.columns)


@stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; null and empty texts stay."""
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels")).filter("predicted = 0").select(*docs.columns)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but from the first document that has them."""
    out = line_dedup.line_dedup(docs, keep_first=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id.

    Rows of an id that repeat a text stay once; rows without an id cannot be
    named as copies and stay.
    """
    linked = jaccard_join.jaccard_join(docs, size=5, threshold=Fraction(4, 5))
    first = linked.filter("doc_id = component_id").select("doc_id")
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as packed sequences."""
    out = packing.pack(docs)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("toxicity", toxic), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Learned models and a tokenizer decide, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, step in STAGES:
        out = step(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
