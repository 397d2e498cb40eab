"""Recall of the embedding near-duplicates against brute force: python -m tests.llm.recall FOLDER...

Compares the links of every vector of a folder's ``embeddings`` with those of
all pairs, in blocks, and prints links found, links there are, and how many
vectors differ in their component.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import SparkSession

from typeframe.llm import multi_index
from typeframe.llm.common import table

from .test_methods import roots

THRESHOLD = 0.95


def brute(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, dict]:
    """Links of each unit vector, and the component of each id."""
    links, tied = np.zeros(len(x), "i8"), []
    for lo in range(0, len(x), 1024):
        a, b = np.nonzero(x[lo : lo + 1024] @ x.T >= THRESHOLD)
        a += lo
        a, b = a[a != b], b[a != b]
        np.add.at(links, a, 1)
        # A vector's links to its later neighbours are enough for components.
        tied.extend(zip(ids[a[a < b]].tolist(), ids[b[a < b]].tolist(), strict=True))
    return links, roots(ids.tolist(), tied)


def main() -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "16").config("spark.ui.enabled", "false").getOrCreate()
    for folder in sys.argv[1:]:
        rows = ds.dataset(f"{folder}/embeddings.parquet").to_table(columns=["vec_id", "embedding"])
        found = {r["vec_id"]: r for r in multi_index.near_duplicates(table(spark, folder, "embeddings")).collect()}
        vectors = rows.column("embedding").combine_chunks().cast(pa.list_(pa.float64())).to_pylist()
        dim = max(len(v) for v in vectors if v)
        good = [i for i, v in enumerate(vectors) if v and len(v) == dim and None not in v and np.isfinite(v).all() and any(v)]
        x = np.asarray([vectors[i] for i in good])
        ids = rows.column("vec_id").to_numpy()[good]
        links, component = brute(ids, x / np.sqrt((x * x).sum(1))[:, None])
        got = sum(found[i]["n_links"] for i in ids.tolist())
        print(f"{folder}: {got} of {links.sum()} links, {sum(found[i]['component_id'] != component[i] for i in ids.tolist())} of {len(ids)} components differ", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
