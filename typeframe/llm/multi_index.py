"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are halved, and each half has its own codebook, fitted by k-means
on a bounded sample; the product of both codebooks is a grid of cells, and
every vector is indexed in one cell.  A query visits cells in the order of the
sum of its two half bounds, as the multi-sequence algorithm yields them, until
the bound passes the search radius.  A half's bound is the distance to the
bisecting plane between the nearest centroid and the cell's, so at a target
recall of 1 no cell that could hold a neighbour is left out, which in many
dimensions is most of the grid; a lower target shrinks the radius to what that
share of planted neighbours needs.  Neighbouring centroids share a tile, whose
bound is the least of its cells': the walk goes over tiles, so a vector is sent
once to all the cells that it visits there.  Candidates are
verified in double precision.  Equal vectors are one class throughout.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components

#: Members and visitors that meet in one matrix product, and rows that a task is dealt.
BLOCK, VISITORS = 1024, 4096
TASK_ROWS = 4096
#: Centroids of a half that share a tile, and tiles of a half that there are at least.
TILE, TILES = 8, 4
#: Vectors that a cell of the grid holds on average, and sampled vectors that a centroid needs.
CELL, SAMPLED = 12, 8
KMEANS_ROUNDS = 12


def codebook(half: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids of a sample's halves by k-means from spread-out seeds."""
    if not len(half):
        return np.zeros((1, half.shape[1]))
    r = np.random.default_rng(seed)
    centres = half[r.choice(len(half), min(k, len(half)), replace=False)]
    for _ in range(KMEANS_ROUNDS):
        own = squared(half, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, half)
        count = np.bincount(own, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], half[r.integers(0, len(half), len(centres))])
    return np.unique(centres, axis=0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def bounds(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared lower bounds of the distance from rows of ``x`` to each centroid's Voronoi cell."""
    d = squared(x, c)
    near = d.argmin(1)
    gap = np.sqrt(squared(c, c))[near]
    # The signed distance to the bisecting plane of the nearest centroid and another.
    plane = np.where(gap > 0, (d - d.min(1, keepdims=True)) / np.where(gap > 0, 2 * gap, 1), 0)
    return plane**2


def tiled(book: np.ndarray) -> np.ndarray:
    """The tile of each centroid: neighbouring ones share one; numbered without gaps."""
    width = max(1, min(TILE, len(book) // TILES))
    return np.unique(squared(book, codebook(book, -(-len(book) // width), 5)).argmin(1), return_inverse=True)[1]


def least(b: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """The least bound of each tile's centroids, a row of ``b`` at a time."""
    order = np.argsort(tile, kind="stable")
    return np.minimum.reduceat(b[:, order], np.searchsorted(tile[order], np.arange(tile.max() + 1)), axis=1)


def visited(first: np.ndarray, second: np.ndarray, radius2: float) -> list[tuple[int, int]]:
    """Places of a grid by rising ``first[i] + second[j]`` while at most ``radius2``: the multi-sequence walk."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, []
    while heap and heap[0][0] <= radius2:
        _, i, j = heapq.heappop(heap)
        out.append((int(a[i]), int(b[j])))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


def reach(sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float, target: float, seed: int = 3) -> float:
    """The squared radius up to which cells are visited.

    At a target of 1 it is the distance of the threshold, and no neighbour can
    be missed.  Below, neighbours at just the threshold are planted beside the
    sample in random directions, and the radius is what that share of them
    needs; closer neighbours need less.
    """
    exact = 2 - 2 * threshold + 1e-9
    if target >= 1 or not len(sample):
        return exact
    half, r = sample.shape[1] // 2, np.random.default_rng(seed)
    b1, b2 = bounds(sample[:, :half], books[0]), bounds(sample[:, half:], books[1])
    need = []
    for _ in range(8):
        u = r.normal(size=sample.shape)
        u -= (u * sample).sum(1, keepdims=True) * sample
        y = threshold * sample + (1 - threshold**2) ** 0.5 * u / np.maximum(np.sqrt((u * u).sum(1, keepdims=True)), 1e-300)
        at = np.arange(len(y))
        need.append(b1[at, squared(y[:, :half], books[0]).argmin(1)] + b2[at, squared(y[:, half:], books[1]).argmin(1)])
    return min(exact, float(np.quantile(np.concatenate(need), target)) + 1e-9)


def usable(vector: Column, dim: int) -> Column:
    """A vector of the right length, without null or non-finite components, that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(r, "f8") for r in rows])
    # Scaling first keeps the squares of very large and very small components finite.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def near_duplicates(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    target_recall: float = 0.999,
    sample: int = 20_000,
    codes: int | None = None,
) -> DataFrame:
    """Link vectors whose cosine is ``threshold`` or more.

    The codebooks are fitted on at most ``sample`` vectors, chosen by a hash;
    every vector is indexed and every vector queries.  ``codes`` is a
    codebook's size; by default it grows with the square root of the number of
    different vectors, so that cells do not fill as the table grows, as far as
    the sample feeds its centroids.  Returns ``id_col``,
    ``n_links``, ``component_id`` (smallest id reachable) and ``kept``.

    Vectors that are null, zero, hold null or non-finite components, or have
    another length than most, link with nothing; equal vectors link with each
    other; rows that repeat an id count one by one; a null id takes part, but
    names no component; an empty table gives no rows; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    # Single-precision components travel as such; all arithmetic is double.
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    source = vectors.select(F.col(id_col).cast("long").alias("doc"), F.col(vector_col).cast(kind).alias("v"))
    common = source.filter("v is not null").groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = max(1, common["dim"] if common else 1)
    # Copies of a vector are one class with a weight; a null id never names it.
    # The digest, not the vector, is the key that rows are dealt by.
    rows = source.withColumn("ok", usable(F.col("v"), dim)).withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))))
    rows = rows.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), F.reverse("v")))
    classes = rows.filter("ok").groupBy("k1", "k2").agg(F.min("doc").alias("doc"), F.count("*").alias("weight"), F.first("v").alias("v")).filter("doc is not null")
    classes = materialise(classes, "index-classes")
    picked = classes.orderBy(F.xxhash64("doc"), "doc").limit(sample).select("v").toPandas()["v"]
    if codes is None:
        codes = max(8, min(sample // SAMPLED, int(np.ceil((classes.count() / CELL) ** 0.5))))
    points = _unit(picked) if len(picked) else np.zeros((0, dim))
    half = dim // 2
    books = codebook(points[:, :half], codes, 1), codebook(points[:, half:], codes, 2)
    tile1, tile2 = tiled(books[0]), tiled(books[1])
    radius2 = reach(points[:2000], books, threshold, target_recall)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                rows = batch.iloc[lo : lo + 2048]
                x = _unit(rows["v"])
                b1, b2 = bounds(x[:, :half], books[0]), bounds(x[:, half:], books[1])
                near1, near2 = squared(x[:, :half], books[0]).argmin(1), squared(x[:, half:], books[1]).argmin(1)
                tiles = [visited(p, q, radius2) for p, q in zip(least(b1, tile1), least(b2, tile2), strict=True)]
                own = tile1[near1].astype("i8") * 65536 + tile2[near2]
                out = rows[["doc", "weight", "v"]].copy()
                out["own"] = own
                out["tiles"] = [np.asarray(sorted({a * 65536 + b for a, b in t} | {int(o)}), "i8") for t, o in zip(tiles, own, strict=True)]
                yield out

    indexed = materialise(classes.mapInPandas(place, f"doc long, weight long, v {kind}, own long, tiles array<long>"), "index")

    # A tile's members and its visitors are cut into blocks of bounded size, and each pair of blocks is one unit.
    visits = indexed.select("doc", F.explode("tiles").alias("tile"))
    members = indexed.groupBy(F.col("own").alias("tile")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m_blocks"))
    visitors = visits.groupBy("tile").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("q_blocks"), F.count("*").alias("n_visits"))
    # A tile visited by its own members only, all of which are one vector, has no pairs to verify.
    tiles = materialise(members.join(visitors, "tile"), "index-tiles").filter("n_visits > 1")
    block = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = indexed.select("doc", "weight", "v", F.col("own").alias("tile")).join(tiles, "tile").select("doc", "weight", "v", "tile", block("m_blocks").alias("m"), steps("q_blocks").alias("q"), F.lit(True).alias("member"))
    asked = indexed.select("doc", "weight", "v", F.explode("tiles").alias("tile")).join(tiles, "tile").select("doc", "weight", "v", "tile", steps("m_blocks").alias("m"), block("q_blocks").alias("q"), F.lit(False).alias("member"))
    units = held.unionByName(asked)
    n = tiles.agg(F.coalesce(F.sum(F.col("n_visits") * F.col("m_blocks")), F.lit(0))).first()[0]
    tasks = max(1, 2 * n // TASK_ROWS)

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, unit in rows.groupby(["tile", "m", "q"], sort=False):
            flag = unit["member"].to_numpy()
            m, q = unit[flag], unit[~flag]
            if not len(m) or not len(q):
                continue
            ids, asks = m["doc"].to_numpy(), q["doc"].to_numpy()
            hit = (_unit(q["v"]) @ _unit(m["v"]).T >= threshold) & (asks[:, None] != ids[None, :])
            at = np.flatnonzero(hit.any(1))
            if not len(at):
                continue
            count = hit[at] @ m["weight"].to_numpy()
            # Links inside the unit shrink to one per query: to its local component's smallest member.
            label = ids.copy()
            while True:
                asked = np.where(hit[at], label[None, :], np.iinfo("i8").max).min(1)
                new = np.minimum(label, np.where(hit[at], asked[:, None], np.iinfo("i8").max).min(0))
                if (new == label).all():
                    break
                label = new
            found.append(pd.DataFrame({"a": asks[at], "b": asked, "n": count}))
            tied = np.flatnonzero(hit.any(0) & (label != ids))
            found.append(pd.DataFrame({"a": ids[tied], "b": label[tied], "n": 0}))
        return pd.concat(found).astype("int64") if found else pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")

    dealt = units.withColumn("task", F.pmod(F.xxhash64("tile", "m", "q"), F.lit(tasks)))
    links = materialise(dealt.groupBy("task").applyInPandas(verify, "a long, b long, n long"), "index-links")
    linked = components(links.select("a", "b"))
    count = links.groupBy("a").agg(F.sum("n").alias("n"))
    result = classes.select("k1", "k2", "doc", "weight").join(linked, F.col("doc") == F.col("node"), "left").join(count, F.col("doc") == F.col("a"), "left")
    result = materialise(result.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "doc").alias("component")), "index-result")
    out = rows.select("doc", "k1", "k2", "ok").join(result, ["k1", "k2"], "left")
    component = F.when(F.col("ok"), F.coalesce("component", "doc")).otherwise(F.col("doc"))
    return out.select(F.col("doc").alias(id_col), F.when(F.col("ok"), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def oracle_sql(threshold: float = 0.95) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= {threshold}),
r AS (SELECT vec_id AS node, vec_id AS reached FROM v UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, min(r.reached) AS component_id, min(r.reached) = v.vec_id AS kept
FROM v JOIN r ON v.vec_id = r.node GROUP BY v.vec_id"""
