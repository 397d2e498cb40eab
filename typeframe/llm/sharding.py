"""Balanced label propagation into shards of equal row counts, in SQL functions only.

Rows that share a group are linked through it, as in a bipartite graph of
rows and groups.  Groups start packed whole, the largest first: a group too
large for any shard's room fills as few shards as it can, and small groups are
packed in slices.  In each round a linked row wants the shard where most of its
group is, among the shards with room, and else stays; a round's flows (source
shard, target shard, slice) are admitted while the target's quota holds, until
nothing moves.  Unlinked rows are indifferent to where they are, so only their
number per shard is tracked: they fill the quotas that the linked rows leave.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Rows ranked together by one task; flows are admitted in so many slices.
BUCKET_ROWS = 20_000
SLICES = 8
#: A group above this part of a quota is packed by itself; there are as many slices of small groups in a shard.
FINE = 16


def ranked(rows: DataFrame, within: list[str], buckets: int, order: list[str], name: str) -> DataFrame:
    """Add ``name``, a gapless rank from 0 inside ``within``, without one task per key.

    Rows are ranked inside (``within``, hash bucket); the buckets' counts are
    prefix-summed, and the two add up.
    """
    keyed = rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy(*within, "_b").agg(F.count("*").alias("_c"))
    bases = counts.select(*within, "_b", (F.sum("_c").over(Window.partitionBy(*within or [F.lit(0)]).orderBy("_b")) - F.col("_c")).alias("_base"))
    inside = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*within, "_b").orderBy(*order)) - 1)
    return inside.join(bases, [*within, "_b"]).withColumn(name, (F.col("_base") + F.col("_n")).cast("long")).drop("_b", "_c", "_base", "_n")


def quota(n: int, shards: int) -> list[int]:
    return [n // shards + (j < n % shards) for j in range(shards)]


def balanced_shards(rows: DataFrame, *, id_col: str, group_cols: list[str], shards: int = 40, rounds: int | None = None) -> DataFrame:
    """Add ``shard``, with row counts at most one apart and groups kept whole.

    A group is cut only where it exceeds the room that larger ones leave, or at
    the end of a slice that does.  ``rounds`` bounds the rounds of propagation;
    each one that moves anything joins parts of a group, so they end by themselves.

    Rows with a null in ``group_cols`` are unlinked.  Repeated ids, ties and
    copies of a row are ranked one by one; fewer rows than shards leave some
    shards empty; an empty table gives no rows; other columns are carried.
    """
    n = rows.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    extra = [c for c in rows.columns if c not in {id_col, *group_cols}]
    key = F.when(sum((F.col(c).isNull().cast("int") for c in group_cols), F.lit(0)) == 0, F.struct(*group_cols))
    base = materialise(ranked(rows.withColumn("_g", key), [], buckets, [id_col, *group_cols, *extra], "_idx"), "shard-rows")
    quotas = quota(n, shards)

    sizes = base.filter("_g is not null").groupBy("_g").agg(F.count("*").alias("_size")).filter("_size > 1")
    cluster, large = F.xxhash64("_g"), F.col("_size") * FINE > min(quotas)
    item = F.when(large, cluster).otherwise(F.pmod(cluster, F.lit(shards * FINE)))
    sizes = materialise(sizes.select("_g", "_size", cluster.alias("cluster"), large.alias("_large"), item.alias("_item")), "shard-groups")
    # At most shards * FINE slices and as many large groups, however many rows there are.
    items = [(r["_large"], r["_item"], r["c"]) for r in sizes.groupBy("_large", "_item").agg(F.sum("_size").alias("c")).collect()]
    pieces = base.sparkSession.createDataFrame(_pack(items, quotas), "_large boolean, _item long, _lo long, _hi long, shard int")
    members = materialise(base.select("_idx", "_g").join(sizes, "_g").select("_idx", "cluster", "_large", "_item"), "shard-members")
    alone = ranked(members.filter("_large"), ["_item"], buckets, ["_idx"], "_at")
    # A slice's groups follow each other, so that a cut through it cuts one group.
    sliced = members.filter("not _large").withColumn("_at", F.row_number().over(Window.partitionBy("_item").orderBy("cluster", "_idx")).cast("long") - 1)
    ranks = alone.unionByName(sliced).alias("r")
    same = F.expr("r._large = p._large and r._item = p._item and r._at >= p._lo and r._at < p._hi")
    linked = ranks.join(F.broadcast(pieces.alias("p")), same).select("_idx", "cluster", "shard")
    linked = materialise(linked, "shard-linked")
    held = _held(linked, shards)
    for turn in count() if rounds is None else range(rounds):
        wanted = materialise(_targets(linked, quotas, held, turn), "shard-targets")
        # A cluster that no shard has room for stays where it is.
        moves = linked.join(wanted, "cluster", "left").withColumn("target", F.coalesce("target", "shard")).withColumn("slice", F.pmod(F.xxhash64("cluster", F.lit(turn)), F.lit(SLICES)).cast("int"))
        # At most shards * shards * SLICES sums, however many rows there are.
        flows = moves.filter("shard != target").groupBy("shard", "target", "slice").agg(F.count("*").alias("c")).collect()
        admitted = _admit(flows, quotas, held)
        if not admitted:
            break
        open_ = F.array_contains(F.array(*map(F.lit, sorted(admitted))), (F.col("shard") * shards + F.col("target")) * SLICES + F.col("slice"))
        linked = materialise(moves.select("_idx", "cluster", F.when((F.col("shard") != F.col("target")) & open_, F.col("target")).otherwise(F.col("shard")).alias("shard")), "shard-linked")
        held = _held(linked, shards)

    placed = base.join(linked.select("_idx", "shard"), "_idx", "left")
    ends, total = [], 0
    for q, h in zip(quotas, held, strict=True):
        total += q - h
        ends.append(total)
    fillers = ranked(placed.filter("shard is null").drop("shard"), [], buckets, ["_idx"], "_rank")
    where = F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)), lambda e: e <= F.col("_rank"))).cast("int")
    fillers = fillers.withColumn("shard", where).drop("_rank")
    return placed.filter("shard is not null").unionByName(fillers).drop("_g", "_idx")


def _pack(items: list[tuple[bool, int, int]], quotas: list[int]) -> list[tuple[bool, int, int, int, int]]:
    """Items (large, name, size) as pieces (large, name, from, to, shard): best fit, the largest first, cut only where none fits."""
    free, pieces = list(quotas), []
    for big, name, size in sorted(items, key=lambda x: (-x[2], x[:2])):
        at = 0
        while at < size:
            fits = [j for j, f in enumerate(free) if f >= size - at]
            j = min(fits, key=lambda j: free[j]) if fits else max(range(len(free)), key=lambda j: free[j])
            end = min(size, at + free[j])
            pieces.append((big, name, at, end, j))
            free[j] -= end - at
            at = end
    return pieces


def _held(linked: DataFrame, shards: int) -> list[int]:
    """Linked rows in each shard; one row a shard reaches the driver."""
    counts = {r["shard"]: r["c"] for r in linked.groupBy("shard").agg(F.count("*").alias("c")).collect()}
    return [counts.get(j, 0) for j in range(shards)]


def _targets(linked: DataFrame, quotas: list[int], held: list[int], turn: int) -> DataFrame:
    """Each cluster's best shard: most of its rows, and room for the others."""
    free = F.array(*(F.lit(q - h) for q, h in zip(quotas, held, strict=True)))
    hist = linked.groupBy("cluster", "shard").agg(F.count("*").alias("c"))
    per = hist.groupBy("cluster").agg(F.sum("c").alias("size"), F.collect_list(F.struct("c", F.xxhash64("cluster", "shard", F.lit(turn)).alias("tie"), "shard")).alias("at"))
    fits = lambda x: F.get(free, x.shard) >= F.col("size") - x.c
    best: Column = F.array_max(F.filter("at", fits))
    return per.select("cluster", best.getField("shard").alias("target")).filter("target is not null")


def _admit(flows: list, quotas: list[int], held: list[int]) -> set[int]:
    """The flows that quotas allow, whole, as codes; later passes use what earlier ones freed."""
    shards, left, admitted, now = len(quotas), sorted(flows, key=lambda r: (r["slice"], -r["c"], r["shard"], r["target"])), set(), list(held)
    while True:
        waiting = []
        for r in left:
            if now[r["target"]] + r["c"] <= quotas[r["target"]]:
                now[r["target"]] += r["c"]
                now[r["shard"]] -= r["c"]
                admitted.add((r["shard"] * shards + r["target"]) * SLICES + r["slice"])
            else:
                waiting.append(r)
        if len(waiting) == len(left):
            return admitted
        left = waiting


def shard_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, rounds: int | None = None) -> DataFrame:
    """Shard documents by row count, keeping equal texts together.

    Returns ``id_col``, ``size`` (UTF-8 bytes plus 16), ``text_crc32``,
    ``shard`` and ``slot`` (gapless from 0 in each shard).

    Null texts have no bytes and are linked with nothing; equal texts, empty
    ones included, form a group; repeated rows and null ids are rows of their
    own; an empty table gives no rows; other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    bytes_ = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = docs.select(
        F.col(id_col).alias("doc"),
        (bytes_ + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        # Equal texts: 64 hash bits, checked by the CRC and the size.
        F.when(text.isNotNull(), F.xxhash64(text)).alias("_h"),
    )
    out = balanced_shards(rows, id_col="doc", group_cols=["_h", "text_crc32", "size"], shards=shards, rounds=rounds)
    out = materialise(out, "shards")
    slots = ranked(out, ["shard"], max(1, -(-out.count() // (BUCKET_ROWS * shards)) * 8), ["doc", "size", "text_crc32"], "slot")
    return slots.select(F.col("doc").alias(id_col), "size", "text_crc32", "shard", "slot")
