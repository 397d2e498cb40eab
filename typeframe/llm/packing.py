"""Packing by concatenate and cut.

The documents' tokens form one stream, cut into windows of ``window`` ids.
Pass one tokenises every document and keeps, beside the ids, the running
offset inside its partition.  Partition totals (one row a partition) are
prefix-summed into global starts.  Pass two adds the start of a document's
partition to its offset, which fixes every window it touches; documents that
cross a window's edge give one boundary piece on either side.  No row moves
between partitions: the only exchange is over the partition totals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Documents tokenised per call, and tokens per batch of pieces sent back.
BATCH_DOCS = 256
BATCH_TOKENS = 1 << 20


@lru_cache(maxsize=2)
def _byte_bpe(name: str):
    """The byte-level vocabulary ``<name>.json`` as a rank encoder.

    The ranks of ``<name>.tiktoken`` are the same vocabulary; with the added
    tokens of ``<name>.json``, found inside texts, they give the ids that
    ``tokenizers`` gives.
    """
    import base64
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def byte_bpe_ids(texts: list[str], name: str = "byte_bpe_50k") -> list[list[int]]:
    return _byte_bpe(name).encode_batch(texts, num_threads=1, allowed_special="all")


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
    encode=byte_bpe_ids,
) -> DataFrame:
    """Pack all documents into gapless windows of at most ``window`` tokens.

    ``encode`` maps a list of texts to lists of ids; ``end_id`` closes every
    document.  Returns one row per piece: ``id_col``, ``start`` (ids of the
    document before the piece), ``length``, ``ids`` (little-endian unsigned
    32-bit), ``doc_tokens`` (with the end id), ``sequence_id`` and ``offset``
    (place in the sequence, gapless from 0).  Only the last sequence can be
    short of ``window``.

    Null and empty texts are documents of the end id alone; repeated rows are
    packed once each; an empty table gives no rows; a null id is carried as
    it is; other columns of the input are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(lo, BATCH_DOCS)
                ids = [np.asarray([*x, end_id], "<u4") for x in encode([t or "" for t in part.column(1).to_pylist()])]
                n = np.fromiter(map(len, ids), "int64", len(ids))
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.full(len(n), pid)), pa.array(starts), pa.array(n), pa.array([_narrow(x) for x in ids], pa.binary())],
                    ["doc", "pid", "at", "n", "packed"],
                )

    stream = materialise(source.mapInArrow(tokenise, "doc long, pid long, at long, n long, packed binary"), "pack")
    # One row a partition: the sum's window runs over task totals, not over documents.
    totals = stream.groupBy("pid").agg(F.sum("n").alias("total"))
    starts = totals.select("pid", (F.sum("total").over(Window.orderBy("pid")) - F.col("total")).alias("base"))
    # One row per task of pass one, written so that its size is known: Spark broadcasts
    # it below its own threshold and sorts and merges by partition beyond.
    placed = stream.join(materialise(starts, "pack-starts"), "pid").select("doc", (F.col("base") + F.col("at")).alias("at"), "n", "packed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, at, n, packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = _wide(packed, n)
                for lo, hi in _cuts(at, n, window):
                    rows.append((doc, lo, hi - lo, ids[lo:hi].tobytes(), n, (at + lo) // window, (at + lo) % window))
                held += n
                if held >= BATCH_TOKENS:
                    yield _pieces(rows)
                    rows, held = [], 0
            if rows:
                yield _pieces(rows)

    out = placed.mapInArrow(cut, "doc long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("doc", id_col)


def _cuts(at: int, n: int, window: int) -> Iterator[tuple[int, int]]:
    """The document's own ranges between the window edges it crosses."""
    lo = 0
    while lo < n:
        hi = min(n, lo + window - (at + lo) % window)
        yield lo, hi
        lo = hi


def _narrow(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, else four: halves what pass one stores."""
    return (ids.astype("<u2") if ids.size and ids.max() < 65536 else ids).tobytes()


def _wide(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if len(packed) == 2 * n else "<u4").astype("<u4")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
