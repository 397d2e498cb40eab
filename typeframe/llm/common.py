"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeframe.operators.lineage import removed_at_exit, shared_dir, working_path

__all__ = ["discard", "let", "materialise", "remove", "scratch", "shared_dir", "table", "words_of"]

#: Characters that separate words: space and \t \n \v \f \r.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Collect the paths that ``materialise`` writes meanwhile, so that their owner can remove them."""
    token = _SCRATCH.set(paths := [])
    try:
        yield paths
    finally:
        _SCRATCH.reset(token)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables wherever they are stored."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a later stage that loses an executor rereads the
    table instead of recomputing, and values that depend on task layout are
    fixed once written.  The table lasts until it is discarded or the driver ends.
    """
    spark = df.sparkSession
    path = working_path(spark, name)
    if (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    removed_at_exit(spark, path)
    out = spark.read.schema(schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no unwritten result reads any more."""
    for t in tables:
        remove(t.sparkSession, [t.written_at])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs without separators; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)
