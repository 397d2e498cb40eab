"""Exact Jaccard join of word n-gram sets in metric regions.

Jaccard distance is a metric.  A region of sets is parted by pivots: every set
is measured against them and belongs to the Voronoi cell of the nearest, and
joins a further cell as a visitor where the triangle inequality allows a
neighbour there: its distance to that pivot exceeds its least by no more than
twice the radius, and the cell's own reach by no more than the radius.  Cells
with their visitors are regions again, until they are small or of one
component, and are joined exactly; a large region is parted by Spark, a small
one inside its task.  Sets within the radius of a pivot are linked with it, so
sets of one component are not compared any more.

Unrelated documents are all at a distance near 1 from any pivot, and such
windows would replicate them everywhere.  So a stated reduction comes first:
regions start from signatures that no linked pair can escape.  Sets of like
size are cut by hash into one part more than the largest symmetric difference
a linked pair can have, so a linked pair has an equal part; sets that share a
part's hash, directly or through others, form a region.  A region that pivots
do not part is reduced once more by the prefix filter in its own order of
rarity, and what is still dense is joined block by block, leaving out blocks
that are further apart than the radius or of one component.  Equal sets are
one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, words_of
from .components import components

#: Sets of a region that are compared pair by pair without pivots; sets and elements of a region that one task joins; rows that a task is dealt.
LEAF = 1
TASK_SETS = 1024
TASK_ELEMENTS = 4_000_000
TASK_ROWS = 1024
#: Pivots of a region; what a cell may keep of its region, and all cells of it, for the region to count as parted.
PIVOTS = 8
SHRINK, GROWTH = 0.75, 2.0
#: Mean distance to the nearest pivot beyond which a region holds strangers, and below which near copies.
FAR = 0.5
#: Dense regions: sets in a block, and the width of shells as a share of the radius.
BLOCK = 256
SHELLS = 4
#: Size of the bitmap that sieves signatures, fixed whatever the input: 16 MB.
SIEVE_BITS = 1 << 27
#: Slack for distances that pass through doubles.
EPS = 1e-9


def shingles(text: Column, size: int) -> Column:
    """The sorted distinct hashes of a text's ``size``-word windows, A-Z lower-cased.

    A text with fewer words gives its whole sequence, one without words an
    empty array.  64-bit hashes stand for windows.
    """
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return _windows(words_of(low), size)


def _windows(words: Column, size: int) -> Column:
    def of(w: Column) -> Column:
        window = lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(size)))
        return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), window)).when(F.size(w) > 0, F.array(F.xxhash64(F.lit(size), F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return F.sort_array(F.array_distinct(F.element_at(F.transform(F.array(words), of), 1)))


def linked_sizes(threshold: Fraction) -> list[tuple[int, int, int, int, int]]:
    """Size intervals (low, high, largest partner, parts, spare) that cover all int sizes.

    A linked pair whose smaller set lies in [low, high) has a larger set of at
    most ``largest`` elements, and differs in fewer than ``parts - spare``
    elements, so at least ``spare + 1`` of its parts are equal.  ``spare`` is
    how many empty parts a set may have and still be sure of an equal part
    with elements; it is the least that few sets exceed.
    """
    if threshold == 1:
        return [(1, 1 << 31, 1 << 31, 1, 0)]
    out, low = [], 1
    while low < 1 << 31:
        high = max(low + 1, int(low / threshold) + 1)
        largest = int((high - 1) / threshold)
        # J >= t means |A| + |B| - 2 I <= (|A| + |B|) (1 - t) / (1 + t).
        need = int((high - 1 + largest) * (1 - threshold) / (1 + threshold)) + 1
        out.append((low, high, largest, *_spare(need, low)))
        low = high
    return out


def _spare(need: int, low: int) -> tuple[int, int]:
    if need == 1:
        return 1, 0
    best = None
    for spare in sorted({int(round(1.3**i)) - 1 for i in range(80)}):
        if spare > need:
            break
        parts = need + spare
        mean = parts * (1 - 1 / parts) ** low
        # The empty parts' count is near Poisson; their excess in standard deviations.
        excess = (spare + 0.5 - mean) / max(mean, 0.05) ** 0.5
        if excess >= 4:
            return parts, spare
        if best is None or excess > best[0]:
            best = (excess, parts, spare)
    return best[1:]


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser, so that sums of mixed values identify sets."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_signatures(values: np.ndarray, n: np.ndarray, table: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets laid end to end, and the number of each set's.

    ``values`` are the elements as uint64, ``n`` the sizes, ``table`` the rows
    of ``linked_sizes``.  A set with more empty parts than are spare could
    share only empty ones with a partner, which then has as many; both add the
    elements of their prefix filter.
    """
    own = np.searchsorted(table[:, 0], n, "right") - 1
    below = (own > 0) & (n <= table[np.maximum(own - 1, 0), 2]) & (n > 0)
    doc = np.concatenate((np.flatnonzero(n > 0), np.flatnonzero(below)))
    interval = np.concatenate((own[n > 0], own[below] - 1))
    if not len(doc):
        return np.zeros(0, "u8"), np.zeros(len(n), "i8")
    starts = np.cumsum(n) - n
    k, m = table[interval, 3], n[doc]
    base = np.cumsum(k) - k
    row = np.repeat(np.arange(len(doc)), m)
    element = values[np.repeat(starts[doc] - (np.cumsum(m) - m), m) + np.arange(len(row))]
    cell = base[row] + (_mix(element, 0) % k[row].astype("u8")).astype("i8")
    sums = np.zeros(int(k.sum()), "u8")
    np.add.at(sums, cell, _mix(element, 1))
    full = np.bincount(cell, minlength=len(sums)) > 0
    part_row = np.repeat(np.arange(len(doc)), k)
    part = np.arange(len(sums)) - base[part_row]
    label = _mix(interval[part_row].astype("u8") * np.uint64(1 << 34) + part.astype("u8"), 7)
    sigs, of = [_mix(sums ^ label, 9)[full]], [doc[part_row][full]]
    empty = np.bincount(part_row[~full], minlength=len(doc))
    for d in np.unique(doc[empty > table[interval, 4]]):
        length = int(n[d]) - -(-int(n[d]) * threshold.numerator // threshold.denominator) + 1
        sigs.append(_mix(np.sort(_mix(values[starts[d] : starts[d] + n[d]], 11))[:length], 13))
        of.append(np.full(length, d))
    sigs, of = np.concatenate(sigs), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return sigs[order], np.bincount(of, minlength=len(n))


def _digests(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """(doc, n, d1, d2, sigs): a set's size, 128-bit digest and signatures."""
    table = np.asarray([t for t in linked_sizes(threshold)], "i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                lists = batch.column(1)
                values = lists.flatten().to_numpy(zero_copy_only=False).view("u8")
                n = np.diff(lists.offsets.to_numpy()).astype("i8")
                row = np.repeat(np.arange(len(n)), n)
                digest = [np.zeros(len(n), "u8") for _ in range(2)]
                for d, seed in zip(digest, (101, 103), strict=True):
                    np.add.at(d, row, _mix(values, seed))
                sigs, count = set_signatures(values, n, table, threshold)
                edges = pa.array(np.concatenate(([0], np.cumsum(count))).astype("i4"))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *(pa.array(d.view("i8")) for d in digest), pa.ListArray.from_arrays(edges, pa.array(sigs.view("i8")))], ["doc", "n", "d1", "d2", "sigs"])

    return sets.mapInArrow(run, "doc long, n long, d1 long, d2 long, sigs array<long>")


class _Region:
    """Sets laid end to end, joined recursively inside one task."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], threshold: Fraction, leaf: int) -> None:
        self.ids, self.leaf, self.n = ids, leaf, np.asarray([len(s) for s in sets])
        self.num, self.den, self.radius = threshold.numerator, threshold.denominator, float(1 - threshold)
        _, inverse, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # Elements of one set only never count in an intersection.
        shared = seen > 1
        self.width = int(shared.sum())
        row = np.repeat(np.arange(len(sets)), self.n)
        keep = shared[inverse]
        self.columns, self.kept = (np.cumsum(shared) - 1)[inverse[keep]], np.bincount(row[keep], minlength=len(sets))
        self.starts = np.cumsum(self.kept) - self.kept
        self.label = np.arange(len(sets))
        self.by_pivot = np.zeros(len(sets), bool)
        self.mask = np.zeros(self.width + 1, "f4")

    def flat(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The members' columns end to end, and the member that each belongs to."""
        kept = self.kept[at]
        row = np.repeat(np.arange(len(at)), kept)
        return self.columns[np.arange(len(row)) + np.repeat(self.starts[at] - (np.cumsum(kept) - kept), kept)], row

    def links(self, both: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return both * self.den >= self.num * (sizes - both)

    def unite(self, at: np.ndarray) -> None:
        labels = np.unique(self.label[at])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]

    def one_component(self, at: np.ndarray) -> bool:
        return bool((self.label[at] == self.label[at[0]]).all())

    def join(self) -> None:
        open_ = [(np.arange(len(self.n)), np.zeros(0, "i8"))]
        while open_:
            home, visitors = open_.pop()
            at = np.concatenate((home, visitors))
            if len(at) < 2 or not len(home) or self.one_component(at):
                continue
            if len(at) <= self.leaf:
                self.compare(home, at)
                continue
            cells = self.cells(home, at)
            for own, guests in cells:
                if len(own) + len(guests) > SHRINK * len(at):
                    self.compare(own, np.concatenate((own, guests)))
                else:
                    open_.append((own, guests))

    def cells(self, home: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The Voronoi cells of pivots among the home sets, with their visitors.

        A pair of home sets meets in the cell of the smaller number, so only
        sets of later cells visit; visitors of the region visit every cell in reach.
        """
        columns, row = self.flat(at)
        far, distances, next_ = None, [], 0
        for _ in range(PIVOTS):
            p = at[next_]
            own = self.columns[self.starts[p] : self.starts[p] + self.kept[p]]
            self.mask[own] = 1
            both = np.bincount(row, self.mask[columns], len(at)).astype("i8")
            self.mask[own] = 0
            both[next_] = self.n[p]  # its own elements, shared or not
            sizes = self.n[at] + self.n[p]
            hit = self.links(both, sizes)
            if hit.sum() > 1:
                self.by_pivot[at[hit]] = True
                self.unite(at[hit])
            distances.append(1 - both / (sizes - both))
            far = distances[-1].copy() if far is None else np.minimum(far, distances[-1])
            # The next pivot is the home set furthest from all so far.
            next_ = int(far[: len(home)].argmax())
            if far[next_] <= self.radius:
                break
        d = np.stack(distances)
        near, least = d.argmin(0), d.min(0)
        is_home = np.arange(len(at)) < len(home)
        out = []
        for j in range(len(d)):
            own = is_home & (near == j)
            if not own.any():
                continue
            reach = least[own].max() + self.radius + EPS
            guests = ~own & (d[j] <= least + 2 * self.radius + EPS) & (d[j] <= reach) & (~is_home | (near > j))
            out.append((at[own], at[guests]))
        return out

    def compare(self, home: np.ndarray, at: np.ndarray) -> None:
        """Link home sets with all, in products of bounded size."""
        for i in range(0, len(home), BLOCK):
            for j in range(0, len(at), BLOCK):
                a, b = home[i : i + BLOCK], at[j : j + BLOCK]
                if self.one_component(np.concatenate((a, b))):
                    continue
                hit = self.links(self.intersections(a, b), self.n[a][:, None] + self.n[b][None, :])
                for x, y in zip(*np.nonzero(hit & (self.label[a][:, None] != self.label[b][None, :])), strict=True):
                    if self.label[a[x]] != self.label[b[y]]:
                        self.unite(np.asarray([a[x], b[y]]))

    def intersections(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (ca, ra), (cb, rb) = self.flat(a), self.flat(b)
        self.mask[cb] = 1
        keep = self.mask[ca] > 0
        self.mask[cb] = 0
        ca, ra = ca[keep], ra[keep]
        names = np.unique(ca)
        in_b = np.searchsorted(names, cb)
        keep = names[np.minimum(in_b, len(names) - 1)] == cb if len(names) else np.zeros(len(cb), bool)
        ca, cb, rb = np.searchsorted(names, ca), in_b[keep], rb[keep]
        both, width = np.zeros((len(a), len(b))), max(1024, (1 << 21) // max(len(a), len(b)))
        for lo in range(0, len(names), width):
            dense = [np.zeros((m, min(width, len(names) - lo)), "f4") for m in (len(a), len(b))]
            for x, c, r in ((dense[0], ca, ra), (dense[1], cb, rb)):
                inside = (c >= lo) & (c < lo + width)
                x[r[inside], c[inside] - lo] = 1
            both += dense[0] @ dense[1].T
        return both

    def stars(self) -> list[tuple[int, int, bool]]:
        """Each set's link to the smallest id of its component, and whether a pivot linked it."""
        least = np.full(len(self.ids), np.iinfo("i8").max)
        np.minimum.at(least, self.label, self.ids)
        return [(int(i), int(c), bool(p)) for i, c, p in zip(self.ids, least[self.label], self.by_pivot, strict=True) if i != c]


def linked_stars(ids: np.ndarray, sets: list[np.ndarray], threshold: Fraction, leaf: int = LEAF) -> list[tuple[int, int, bool]]:
    """Join sets exactly; each linked set's id, the smallest id of its component, and whether a pivot found the link."""
    some = [i for i, s in enumerate(sets) if len(s)]
    if len(some) < 2:
        return []
    region = _Region(np.asarray(ids)[some], [np.asarray(sets[i]) for i in some], threshold, leaf)
    region.join()
    return region.stars()


def _tasks(rows: int | None, elements: int | None) -> int:
    return max(1, (rows or 0) // TASK_ROWS, (elements or 0) // 500_000)


EDGES = "a long, b long, by_pivot boolean"


def _join_units(units: DataFrame, threshold: Fraction, tasks: int, name: str) -> DataFrame:
    """Edges of units (unit, doc, s), written; whole units are dealt to tasks of bounded size."""
    leaf = LEAF

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = [e for _, x in rows.groupby("unit", sort=False) for e in linked_stars(x["doc"].to_numpy(), list(x["s"]), threshold, leaf)]
        return pd.DataFrame(found, columns=["a", "b", "by_pivot"]).astype({"a": "int64", "b": "int64", "by_pivot": bool})

    dealt = units.select(F.pmod(F.xxhash64("unit"), F.lit(tasks)).alias("task"), "unit", "doc", "s")
    return materialise(dealt.groupBy("task").applyInPandas(run, EDGES), name)


def _sieve(rows: DataFrame, key: Column) -> Broadcast:
    """A bitmap of ``SIEVE_BITS`` bits over 64-bit keys, broadcast; of that size whatever the input."""
    # The bitmap functions count from 1.
    bit = F.pmod(key, F.lit(SIEVE_BITS)) + 1
    parts = rows.select(F.bitmap_bucket_number(bit).alias("k"), F.bitmap_bit_position(bit).alias("at")).groupBy("k").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    sieve = np.zeros(SIEVE_BITS // 8, "u1")
    for r in parts:
        sieve[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), "u1")
    return rows.sparkSession.sparkContext.broadcast(sieve)


def _in_sieve(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.mod(keys, SIEVE_BITS)
    return bits[at >> 3] >> (at & 7).astype("u1") & 1 == 1


def _crowd_of(sets: DataFrame, shared: DataFrame, threshold: Fraction) -> tuple[DataFrame, Broadcast]:
    """(region, doc, n, t): elements that others of the region have, of sets that share enough of them, and the sieve.

    A set with fewer than ceil(t n) shared elements has none in its prefix, so
    it cannot link.  What passes the sieve wrongly the join with ``shared``
    drops.
    """
    bits = _sieve(shared, F.col("region").bitwiseXOR(F.col("t")))
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                lists = batch.column(2)
                values = lists.flatten().to_numpy(zero_copy_only=False)
                n = np.diff(lists.offsets.to_numpy()).astype("i8")
                row = np.repeat(np.arange(len(n)), n)
                region, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                hit = _in_sieve(bits.value, values ^ region[row])
                enough = np.bincount(row[hit], minlength=len(n)) >= -(-n * num // den)
                keep = hit & enough[row]
                row = row[keep]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (region[row], doc[row], n[row], values[keep])], ["region", "doc", "n", "t"])

    return sets.select("region", "doc", "s").mapInArrow(run, "region long, doc long, n long, t long"), bits


def _refined(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Regions reduced anew by their rarest elements: (region, doc, cut), whose cuts hold all that may still link.

    Linked sets share one of the n - ceil(t n) + 1 elements that come first in
    any common order; in order of rarity those that many sets have come last,
    so sets that share no more than a passage part here.
    """
    tokens = sets.select("region", F.explode("s").alias("t"))
    shared = materialise(tokens.groupBy("region", "t").agg(F.count("*").alias("c")).filter("c > 1"), "jaccard-frequency")
    crowd, sieve = _crowd_of(sets, shared, threshold)
    # Elements of one set only come first of all, and need no more than to be counted.
    ranked = crowd.join(shared, ["region", "t"]).groupBy("region", "doc").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "t"))).alias("r"))
    prefix = F.col("n") - F.floor((F.col("n") * threshold.numerator + threshold.denominator - 1) / threshold.denominator) + 1
    left = (prefix - (F.col("n") - F.size("r"))).cast("int")
    first = ranked.filter(left > 0).select("region", "doc", F.explode(F.slice("r", F.lit(1), F.greatest(left, F.lit(0)))).alias("x"))
    # A set is one node in each of its regions.
    first = materialise(first.select(F.xxhash64("region", "doc").alias("node"), F.xxhash64("region", "x.t").alias("t")), "jaccard-prefixes")
    sieve.destroy()
    least = materialise(first.groupBy("t").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("t", "lo"), "jaccard-least")
    found = components(first.join(least, "t").select(F.col("node").alias("a"), F.col("lo").alias("b")))
    nodes = sets.select("region", "doc", F.xxhash64("region", "doc").alias("node"))
    return nodes.join(found, "node").select("region", "doc", F.col("component").alias("cut"))


def _roots(threshold: Fraction):
    """For each region's pivots, the first pivot of their component: a few sets a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            roots = []
            for row in batch["sets"]:
                sets = [np.asarray(s) for s in row]
                found = {a: b for a, b, _ in linked_stars(np.arange(len(sets)), sets, threshold, len(sets))}
                roots.append([found.get(j, j) for j in range(len(sets))])
            yield batch[["region"]].assign(roots=roots)

    return run


def _measured(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """(region, refined, doc, s, d, near, least, settled) of large regions, written.

    ``d`` are the distances to the region's pivots, ``near`` the nearest one,
    ``settled`` the first pivot of the component that a linked pivot gives.
    """
    near = lambda j: F.min(F.struct(F.xxhash64("doc", "region", F.lit(j)).alias("h"), F.col("doc").alias("doc"))).getField("doc")
    chosen = sets.groupBy("region").agg(F.array_distinct(F.array(*(near(j) for j in range(PIVOTS)))).alias("docs"))
    # Written, so that Spark knows their size: the sets stay where they are while the pivots are small enough to broadcast.
    pivot = materialise(chosen.select("region", F.posexplode("docs").alias("j", "doc")), "jaccard-chosen")
    # A region's pivots are at most PIVOTS sets; an id that has several sets gives one.
    own = sets.join(pivot, ["region", "doc"]).groupBy("region", "j").agg(F.min("s").alias("s"))
    pivots = own.groupBy("region").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "s"))), lambda p: p.s).alias("sets"))
    pivots = materialise(pivots, "jaccard-pivots")
    roots = materialise(pivots.mapInPandas(_roots(threshold), "region long, roots array<int>"), "jaccard-roots")
    pivots = materialise(pivots.join(roots, "region"), "jaccard-rooted")
    common = F.transform("sets", lambda p: F.size(F.array_intersect(F.col("s"), p)).cast("long"))
    total = lambda j: F.size("s") + F.size(F.get("sets", j))
    d = F.transform("both", lambda c, j: 1 - c / (total(j) - c))
    linked = F.transform("both", lambda c, j: F.when(c * threshold.denominator >= (total(j) - c) * threshold.numerator, F.get("roots", j)))
    placed = sets.join(pivots, "region").withColumn("both", common)
    placed = placed.select("region", "refined", "doc", "s", d.alias("d"), F.array_min(linked).alias("settled"))
    least = F.array_min("d")
    return materialise(placed.select("region", "refined", "doc", "s", "d", "settled", least.alias("least"), (F.array_position("d", least) - 1).cast("int").alias("near")), "jaccard-measured")


def _parted(measured: DataFrame, radius: float) -> DataFrame:
    """(region, cell, doc, s, refined): Voronoi cells with their visitors."""
    reach = measured.groupBy("region", "near").agg(F.max("least").alias("far"))
    reach = reach.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("near", "far"))).alias("reach"))
    rows = measured.join(materialise(reach, "jaccard-reach"), "region")
    inside = lambda j: F.coalesce(
        (j == F.col("near")) | ((j < F.col("near")) & (F.get("d", j) <= F.col("least") + (2 * radius + EPS)) & (F.get("d", j) <= F.element_at("reach", j) + (radius + EPS))), F.lit(False)
    )
    cells = F.filter(F.sequence(F.lit(0), F.size("d") - 1), inside)
    return rows.select("region", F.explode(cells).alias("cell"), "doc", "s", "refined")


def _blocks(measured: DataFrame, radius: float) -> tuple[DataFrame, int]:
    """Units of dense regions, pairs of blocks that may hold links between components, and their tasks."""
    shell = F.floor(F.col("least") / (radius / SHELLS)).cast("int")
    settled = F.coalesce("settled", F.lit(-1))
    placed = measured.select("region", "doc", "s", "d", settled.alias("settled"), "near", shell.alias("shell"))
    count = placed.groupBy("region", "settled", "near", "shell").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
    placed = placed.join(materialise(count, "jaccard-shells"), ["region", "settled", "near", "shell"])
    placed = materialise(placed.withColumn("block", F.struct("settled", "near", "shell", F.pmod(F.xxhash64("doc"), "parts").alias("part"))).select("region", "block", "doc", "s", "d"), "jaccard-blocks")
    at = lambda j: F.get("d", F.lit(j))
    boxes = placed.groupBy("region", "block").agg(F.array(*(F.min(at(j)) for j in range(PIVOTS))).alias("lo"), F.array(*(F.max(at(j)) for j in range(PIVOTS))).alias("hi"), F.count("*").alias("rows"), F.sum(F.size("s").cast("long")).alias("elements"))
    boxes = materialise(boxes, "jaccard-boxes")
    a, b = boxes.toDF("region", "a", "a_lo", "a_hi", "a_rows", "a_elements"), boxes.toDF("region", "b", "b_lo", "b_hi", "b_rows", "b_elements")
    apart = lambda lo, hi: F.exists(F.zip_with(lo, hi, lambda x, y: F.coalesce(x - y, F.lit(0.0))), lambda g: g > radius + EPS)
    # Sets that settled on one component need not meet.
    open_ = (F.col("a.settled") < 0) | (F.col("a.settled") != F.col("b.settled"))
    near = materialise(a.join(b, "region").filter("a <= b").filter(open_ & ~apart("a_lo", "b_hi") & ~apart("b_lo", "a_hi")), "jaccard-pairs")
    size = near.agg(F.sum(F.col("a_rows") + F.col("b_rows")).alias("rows"), F.sum(F.col("a_elements") + F.col("b_elements")).alias("elements")).first()
    pairs = near.select("region", F.struct("a", "b").alias("pair"), F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    units = placed.select("region", "block", "doc", "s").join(pairs, ["region", "block"]).select(F.xxhash64("region", "pair").alias("unit"), "doc", "s")
    return units, _tasks(size["rows"], size["elements"])


def _sorted_out(sets: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Sets (region, doc, s, refined) of regions that one task joins, those of larger ones, and whether there are such."""
    count = sets.groupBy("region").agg(F.count("*").alias("c"), F.sum(F.size("s").cast("long")).alias("e"))
    large = count.filter((F.col("c") > TASK_SETS) | ((F.col("c") > LEAF) & (F.col("e") > TASK_ELEMENTS))).select("region")
    large = materialise(large, "jaccard-large")
    return sets.join(large, "region", "left_anti"), sets.join(large, "region", "left_semi"), not large.isEmpty()


def _joined(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Edges of regions that are joined inside a task."""
    size = sets.agg(F.count("*").alias("rows"), F.sum(F.size("s").cast("long")).alias("elements")).first()
    return _join_units(sets.select(F.xxhash64("region").alias("unit"), "doc", "s"), threshold, _tasks(size["rows"], size["elements"]), "jaccard-links")


def region_links(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """Edges (a, b, by_pivot) that connect what links inside the regions of written sets (region, doc, s)."""
    radius = float(1 - threshold)
    small, large, more = _sorted_out(sets.withColumn("refined", F.lit(False)))
    edges = _joined(small, threshold)
    while more:
        measured = _measured(large, threshold)
        settled = measured.filter("settled is not null")
        # Sets settled on one pivot's component are linked through it; its smallest id stands for it.
        first = materialise(settled.groupBy("region", "settled").agg(F.min("doc").alias("b")), "jaccard-settled")
        edges = edges.union(settled.join(first, ["region", "settled"]).select(F.col("doc").alias("a"), "b", F.lit(True).alias("by_pivot")).filter("a != b"))
        cells = _parted(measured, radius)
        sizes = cells.groupBy("region", "cell").agg(F.count("*").alias("c")).groupBy("region").agg(F.sum("c").alias("all"), F.max("c").alias("most"))
        sizes = sizes.join(measured.groupBy("region").agg(F.count("*").alias("n"), F.min("refined").alias("refined"), F.count_if(F.col("settled") == 0).alias("done"), F.avg("least").alias("mean")), "region")
        # Of one component, parted, near copies that no cell parts, or strangers still to be reduced.
        fate = F.when(F.col("done") == F.col("n"), "done").when((F.col("most") <= F.col("n") * SHRINK) & (F.col("all") <= F.col("n") * GROWTH), "parted").when(F.col("refined") | (F.col("mean") <= FAR), "dense").otherwise("crowded")
        fates = materialise(sizes.select("region", fate.alias("fate")), "jaccard-fates")
        of = lambda rows, which: rows.join(fates.filter(F.col("fate") == which).select("region"), "region", "left_semi")  # noqa: E731, B023
        there = {r["fate"] for r in fates.select("fate").distinct().collect()}
        parts = []
        if "parted" in there:
            parts.append(of(cells, "parted").select(F.xxhash64("region", "cell").alias("region"), "doc", "s", "refined"))
        if "crowded" in there:
            crowded = of(measured, "crowded").select("region", "doc", "s")
            cuts = materialise(_refined(crowded, threshold), "jaccard-refined")
            parts.append(crowded.join(cuts, ["region", "doc"]).select(F.xxhash64("region", "cut").alias("region"), "doc", "s", F.lit(True).alias("refined")))
        if "dense" in there:
            units, tasks = _blocks(of(measured, "dense"), radius)
            edges = edges.union(_join_units(units, threshold, tasks, "jaccard-dense-links"))
        if not parts:
            break
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        small, large, more = _sorted_out(materialise(rows, "jaccard-parts"))
        edges = edges.union(_joined(small, threshold))
    return edges


def _members_of(digests: DataFrame, groups: DataFrame) -> tuple[DataFrame, Broadcast]:
    """(sig, class, lo) of the sets in ``groups``, most other signatures sieved out first, and the sieve.

    The sieve is a bitmap of ``SIEVE_BITS`` bits over the groups' signatures,
    of that size whatever the input; what passes it wrongly the join drops.
    """
    shared = _sieve(groups, F.col("sig"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                lists = batch.column(1)
                sigs = lists.flatten().to_numpy(zero_copy_only=False)
                classes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
                hit = _in_sieve(bits, sigs)
                yield pa.RecordBatch.from_arrays([pa.array(sigs[hit]), pa.array(classes[hit])], ["sig", "class"])

    some = digests.select("class", "sigs").mapInArrow(run, "sig long, class long")
    return some.join(groups.select("sig", "lo"), "sig"), shared


def jaccard_join(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 3,
    threshold: Fraction = Fraction(9, 10),
) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of ``threshold`` or more.

    Returns one row a document: ``id_col``, ``n_shingles`` and
    ``component_id``, the smallest id reachable by links, itself included.

    Null texts, and texts without words, have an empty set and link with
    nothing; long texts count whole; equal sets are one class, so copies cost
    no pairs; rows that repeat an id are each a document of that id; a null
    id has a null component unless its class has an id; an empty table gives
    no rows; other columns are ignored.
    """
    threshold = Fraction(threshold)
    digests = materialise(_digests(_source(docs, id_col, text_col).select("doc", shingles(F.col("text"), size).alias("s")), threshold), "jaccard-sets")
    # Equal sets are one class, named by its smallest id.
    reps = digests.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc").alias("rep")).filter("rep is not null")
    reps = materialise(reps, "jaccard-reps")
    sets = region_sets(docs, digests, reps, id_col=id_col, text_col=text_col, size=size)
    linked = materialise(components(region_links(sets, threshold).select("a", "b")), "jaccard-components")
    final = materialise(reps.join(linked, F.col("rep") == F.col("node"), "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component")), "jaccard-final")
    out = digests.select("doc", "n", "d1", "d2").join(final, ["n", "d1", "d2"], "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc")).alias("component_id"))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))


def region_sets(docs: DataFrame, digests: DataFrame, reps: DataFrame, *, id_col: str, text_col: str, size: int) -> DataFrame:
    """The first regions (region, doc, s), written: sets that share a signature, directly or through others."""
    # Copies have equal signatures and one class, so they combine before the shuffle.
    named = digests.filter("n > 0").withColumn("class", F.xxhash64("n", "d1", "d2"))
    member = named.select(F.explode("sigs").alias("sig"), "class")
    groups = member.groupBy("sig").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("c")).filter("lo < hi")
    groups = materialise(groups, "jaccard-groups")
    pairs = groups.filter("c = 2").select(F.col("hi").alias("a"), F.col("lo").alias("b"))
    members, sieve = _members_of(named, groups.filter("c > 2"))
    found = components(pairs.union(members.select(F.col("class").alias("a"), F.col("lo").alias("b"))))
    sieve.destroy()
    found = found.select(F.col("node").alias("class"), F.col("component").alias("region"))
    # The class is a short name for candidates; the digest itself tells sets apart.
    regions = reps.withColumn("class", F.xxhash64("n", "d1", "d2")).join(found, "class").select(F.col("rep").alias("doc"), "region")
    regions = materialise(regions, "jaccard-regions")
    # The sets are cut after the join, for members of regions only.
    some = _sieved(_source(docs, id_col, text_col), regions)
    sets = regions.join(some, "doc").select("region", "doc", shingles(F.col("text"), size).alias("s"))
    return materialise(sets, "jaccard-region-sets").filter(F.size("s") > 0)


def _sieved(source: DataFrame, regions: DataFrame) -> DataFrame:
    """The source without most documents that are in no region, so that their texts are not shuffled.

    A bitmap of ``SIEVE_BITS`` bits over hashed ids, at most 16 MB in slices
    of 4,096 bytes, tells them; what passes it wrongly the join drops.
    """
    # The bitmap functions count from 1.
    bit = F.pmod(F.xxhash64("doc"), F.lit(SIEVE_BITS)) + 1
    bits = regions.groupBy(F.bitmap_bucket_number(bit).alias("_k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits"))
    at = F.bitmap_bit_position(bit).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    tried = source.withColumn("_k", F.bitmap_bucket_number(bit)).join(F.broadcast(materialise(bits, "jaccard-sieve")), "_k")
    return tried.filter(F.getbit(byte, F.pmod(at, F.lit(8))) == 1).select(*source.columns)


def oracle_sql(size: int = 3, threshold: Fraction = Fraction(9, 10)) -> str:
    window = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, {window} AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size} + 2)) AS i FROM d WHERE len(w) >= {size})
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {size} - 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE {threshold.denominator} * c >= {threshold.numerator} * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM d UNION SELECT r.node, e.b FROM r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) e ON r.reached = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id
JOIN (SELECT node, min(reached) AS component_id FROM r GROUP BY node) m ON d.doc_id = m.node"""
