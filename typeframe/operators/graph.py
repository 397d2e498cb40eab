"""The interaction-graph workflow, relational from end to end.

Graphs are edge lists, communities an attribute of both ends; matrices stay
relations of (row, column, value), so nothing is gathered on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeframe.functions.expressions import col
from typeframe.plans import schema_ops
from typeframe.plans.errors import SchemaError
from typeframe.plans.models import Graph, Model, Relation

from .construct import build_graph
from .data import Data
from .lineage import written

COMMUNITY = "community"


def _ids(graph: Data) -> Graph:
    if not isinstance(graph.model, Graph):
        raise SchemaError(f"a graph is needed, not a {graph.model.name}")
    return graph.model


def interaction_graph(data: Data, source: object, dest: object, label: str) -> Data:
    """Weighted edges between two attributes, both ends labelled alike."""
    return build_graph(data, col(source).alias(label), col(dest).alias(label))


def add_community(graph: Data, communities: Data, *, node: str, community: str = COMMUNITY, on_missing: object = "error") -> Data:
    """Add each end's community from a relation of (node, community).

    An unknown node raises while the plan runs if ``on_missing`` is
    ``"error"``, else it gets that value.  The relation is joined once for
    each end; Spark broadcasts it while it is small.
    """
    ids = _ids(graph)
    found = schema_ops.select_field(communities.schema, community)
    key = schema_ops.select_field(communities.schema, node)
    lookup = communities.to_df().select(F.col(key.name).alias("_k"), F.col(found.name).alias("_c"), F.lit(True).alias("_known"))
    df = graph.to_df()
    for side, name in (("source", ids.source_id), ("dest", ids.dest_id)):
        kind = schema_ops.select_field(graph.schema, (side, name)).dataType
        if kind != key.dataType:
            raise SchemaError(f"{side}.{name} is {kind.simpleString()}, {node} is {key.dataType.simpleString()}")
        schema_ops.add_field(graph.schema, side, community, found.dataType)
        missing = F.raise_error(F.concat(F.lit("no community of node "), F.col(f"{side}.{name}").cast("string"))).cast(found.dataType) if on_missing == "error" else F.lit(on_missing).cast(found.dataType)
        df = df.join(lookup, F.col(f"{side}.{name}") == F.col("_k"), "left")
        value = F.when(F.col("_known"), F.col("_c")).otherwise(missing)
        df = df.withColumn(side, F.col(side).withField(community, value)).drop("_k", "_c", "_known")
    return Data(df, ids)


def propagate_communities(graph: Data, rounds: int = 10) -> Data:
    """Communities by label propagation, where no relation of them is at hand.

    A node takes the label with the most weight among its neighbours, edges
    read both ways, and the smaller label on a tie; the rounds are bounded, so
    the result is the same on every run.  Gives (node, community).
    """
    ids = _ids(graph)
    links = _links(graph)
    ends = graph.to_df().select(F.col(f"source.{ids.source_id}").alias("node")).union(graph.to_df().select(F.col(f"dest.{ids.dest_id}").alias("node")))
    labels = ends.distinct().withColumn(COMMUNITY, F.col("node"))
    for _ in range(rounds):
        votes = links.join(labels, F.col("b") == F.col("node")).groupBy("a", COMMUNITY).agg(F.sum("w").alias("w"))
        # The largest weight, then the smallest label: two aggregations that combine early.
        most = votes.groupBy("a").agg(F.max("w").alias("most"))
        best = votes.join(most, "a").filter("w = most").groupBy("a").agg(F.min(COMMUNITY).alias("_new"))
        labels = labels.join(best, F.col("node") == F.col("a"), "left").select("node", F.coalesce("_new", COMMUNITY).alias(COMMUNITY))
        labels = written(labels, "labels")
    return Data(labels, Relation)


def _links(graph: Data) -> DataFrame:
    """(a, b, w): the edges read both ways, loops left out."""
    ids = _ids(graph)
    weight = F.col("edge.weight") if "weight" in graph.schema["edge"].dataType.fieldNames() else F.lit(1)
    ends = graph.to_df().select(F.col(f"source.{ids.source_id}").alias("a"), F.col(f"dest.{ids.dest_id}").alias("b"), weight.cast("double").alias("w"))
    return ends.union(ends.select("b", "a", "w")).filter("a != b").groupBy("a", "b").agg(F.sum("w").alias("w"))


def _moved(links: DataFrame, strength: DataFrame, labels: DataFrame, total: float, turn: int) -> DataFrame:
    """One round of local moves: a node goes where modularity grows most.

    Half of the nodes, by a hash of node and round, may move in a round, so
    that neighbours do not trade places for ever.
    """
    known = labels.join(strength, "node")
    size = known.groupBy(COMMUNITY).agg(F.sum("k").alias("size"))
    votes = links.filter("a != b").join(labels, F.col("b") == F.col("node")).groupBy("a", COMMUNITY).agg(F.sum("w").alias("w"))
    own = known.select(F.col("node").alias("a"), "k", F.col(COMMUNITY).alias("_own"))
    at = votes.join(own, "a").join(size, COMMUNITY)
    stays = F.col(COMMUNITY) == F.col("_own")
    gain = F.col("w") - F.col("k") * (F.col("size") - F.when(stays, F.col("k")).otherwise(0.0)) / total
    # A node with no weight to its own community would leave one of its own strength.
    alone = own.join(size, own["_own"] == size[COMMUNITY]).select("a", (-F.col("k") * (F.col("size") - F.col("k")) / total).alias("_alone"))
    judged = at.select("a", COMMUNITY, F.round(gain, 9).alias("gain"), stays.alias("stays"))
    best = judged.groupBy("a").agg(F.min(F.when(~F.col("stays"), F.struct((-F.col("gain")).alias("g"), F.col(COMMUNITY).alias("c")))).alias("to"), F.max(F.when(F.col("stays"), F.col("gain"))).alias("here"))
    better = best.join(alone, "a").filter(-F.col("to.g") > F.coalesce("here", "_alone") + 1e-9).filter(F.pmod(F.xxhash64("a", F.lit(turn // 2)), F.lit(2)) == turn % 2)
    moved = labels.join(better.select(F.col("a").alias("node"), F.col("to.c").alias("_new")), "node", "left")
    return moved.select("node", F.coalesce("_new", COMMUNITY).alias(COMMUNITY), F.col("_new").isNotNull().alias("_moved"))


def modularity_communities(graph: Data, *, levels: int = 10, rounds: int = 8) -> Data:
    """Communities of high modularity, by local moves and coarsening.

    Edges are read both ways and weighted.  On each level every node starts as
    its own community and moves to the neighbouring one that raises modularity
    most, the smaller label on a tie; then communities become nodes, until
    nothing moves.  Moves of a round are made at once, over joins on nodes and
    communities only, and are the same on every run.  Gives (node, community),
    a community named after one of its nodes.
    """
    ids = _ids(graph)
    links = written(_links(graph), "links")
    total = links.agg(F.sum("w")).first()[0] or 0.0
    ends = graph.to_df().select(F.col(f"source.{ids.source_id}").alias("node")).union(graph.to_df().select(F.col(f"dest.{ids.dest_id}").alias("node")))
    found = written(ends.distinct().withColumn(COMMUNITY, F.col("node")), "communities")
    for _ in range(levels if total else 0):
        strength = links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
        labels, any_moved, quiet = strength.select("node", F.col("node").alias(COMMUNITY)), False, 0
        for turn in range(2 * rounds):
            state = written(_moved(links, strength, labels, total, turn), "moves")
            moved = not state.filter("_moved").isEmpty()
            labels, any_moved, quiet = state.drop("_moved"), any_moved or moved, 0 if moved else quiet + 1
            if quiet == 2:
                break
        if not any_moved:
            break
        step = labels.select(F.col("node").alias("_at"), F.col(COMMUNITY).alias("_c"))
        found = written(found.join(step, F.col(COMMUNITY) == F.col("_at"), "left").select("node", F.coalesce("_c", COMMUNITY).alias(COMMUNITY)), "communities")
        a, b = (labels.select(F.col("node").alias(x), F.col(COMMUNITY).alias(f"_{x}")) for x in ("a", "b"))
        links = written(links.join(a, "a").join(b, "b").groupBy(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.sum("w").alias("w")), "links")
    return Data(found, Relation)


def modularity(graph: Data, communities: Data) -> float:
    """The modularity of a relation (node, community) on the graph, loops left out."""
    links = _links(graph)
    of = communities.to_df().select("node", COMMUNITY)
    a, b = (of.select(F.col("node").alias(x), F.col(COMMUNITY).alias(f"_{x}")) for x in ("a", "b"))
    placed = links.join(a, "a").join(b, "b")
    total, inside = placed.agg(F.sum("w"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("w")))).first()
    if not total:
        return 0.0
    squares = placed.groupBy("_a").agg(F.sum("w").alias("w")).agg(F.sum(F.col("w") * F.col("w"))).first()[0]
    return (inside or 0.0) / total - squares / total**2


def extract_nodes(graph: Data, model: Model = Relation) -> Data:
    """The distinct records of both ends, which have one schema."""
    _ids(graph)
    a, b = (graph.schema[side].dataType for side in ("source", "dest"))
    if [(f.name, f.dataType) for f in a.fields] != [(f.name, f.dataType) for f in b.fields]:
        raise SchemaError(f"the ends differ: {a.simpleString()} and {b.simpleString()}")
    model.validate(a)
    df = graph.to_df()
    return Data(df.select("source.*").union(df.select("dest.*")).distinct(), model)


def keep_significant(graph: Data, *, community: str = COMMUNITY, strict: bool = True) -> Data:
    """Edges whose ends are both in large communities.

    A community is large if its distinct nodes exceed (or, not strict, reach)
    the square root of twice the number of edges.  The limit is one row that
    joins the community sizes; nothing is counted on the driver.
    """
    ids = _ids(graph)
    schema_ops.select_field(graph.schema, ("source", community))
    sizes = extract_nodes(graph, _Any()).to_df().groupBy(community).agg(F.count("*").alias("size"))
    limit = graph.to_df().agg(F.sqrt(2.0 * F.count("*")).alias("limit"))
    # The limit is a single row.
    passes = F.col("size") > F.col("limit") if strict else F.col("size") >= F.col("limit")
    large = sizes.join(F.broadcast(limit), passes).select(F.col(community).alias("_c"))
    df = graph.to_df()
    for side in ("source", "dest"):
        df = df.join(large, F.col(f"{side}.{community}").eqNullSafe(F.col("_c")), "left_semi")
    return Data(df, ids)


class _Any(Model):
    """Accepts every schema: for records between two checked datasets."""

    def validate(self, schema) -> None:
        return None


def integrate(graph: Data, nodes: Data, *, key: str) -> Data:
    """Edges whose ends are both known nodes, with the nodes' attributes added."""
    ids = _ids(graph)
    schema_ops.select_field(nodes.schema, key)
    extra = [f for f in nodes.schema.fields if f.name != key]
    df = graph.to_df()
    for side, name in (("source", ids.source_id), ("dest", ids.dest_id)):
        kind = schema_ops.select_field(graph.schema, (side, name)).dataType
        if kind != schema_ops.select_field(nodes.schema, key).dataType:
            raise SchemaError(f"{side}.{name} and {key} have different types")
        for f in extra:
            schema_ops.add_field(graph.schema, side, f.name, f.dataType)
        lookup = nodes.to_df().select(F.col(key).alias("_k"), F.struct(*(F.col(f.name) for f in extra)).alias("_n")) if extra else nodes.to_df().select(F.col(key).alias("_k"), F.lit(None).alias("_n"))
        df = df.join(lookup, F.col(f"{side}.{name}") == F.col("_k"))
        added = F.col(side)
        for f in extra:
            added = added.withField(f.name, F.col("_n").getField(f.name))
        df = df.withColumn(side, added).drop("_k", "_n")
    return Data(df, ids)


def as_matrices(graph: Data, *, community: str = COMMUNITY, weight: str = "weight") -> tuple[DataFrame, DataFrame]:
    """The weights as (source, dest, weight) and membership as (node, community), once each."""
    ids = _ids(graph)
    schema_ops.select_field(graph.schema, ("edge", weight))
    df = graph.to_df()
    edges = df.groupBy(F.col(f"source.{ids.source_id}").alias("source"), F.col(f"dest.{ids.dest_id}").alias("dest")).agg(F.sum(f"edge.{weight}").alias("weight"))
    ends = [df.select(F.col(f"{side}.{name}").alias("node"), F.col(f"{side}.{community}").alias("community")) for side, name in (("source", ids.source_id), ("dest", ids.dest_id))]
    members = ends[0].union(ends[1]).groupBy("node").agg(F.min("community").alias("community"), F.max("community").alias("_other"))
    one = F.when(F.col("community").eqNullSafe(F.col("_other")), F.col("community")).otherwise(F.raise_error(F.concat(F.lit("two communities of node "), F.col("node").cast("string"))).cast(members.schema["community"].dataType))
    return edges, members.select("node", one.alias("community"))


def community_order(members: DataFrame) -> DataFrame:
    """Communities by falling size, then by name: the order of a matrix's rows."""
    return members.groupBy("community").agg(F.count("*").alias("size")).orderBy(F.desc("size"), F.asc("community"))


def polarisation(graph: Data, *, community: str = COMMUNITY, weight: str = "weight", full: bool = True) -> DataFrame:
    """Antagonism and porosity of every ordered pair of communities.

    For node u and community j, ``md`` is u's weight into j.  u is internal
    towards j if it is outside and has none.  ``ms`` is u's weight to members
    of its own community that are internal towards j; where both are positive
    u is a boundary node with value ms / (ms + md) - 1/2.  Antagonism is the
    mean value, porosity the percentage of negative ones; both are 0 without
    boundary nodes and on the diagonal.  The full matrix is the square of the
    communities' number; without ``full`` only pairs with boundary nodes come.
    """
    # Edges and membership both read the graph, so it is built once.
    graph = Data(written(graph.to_df(), "graph"), graph.model)
    edges, members = as_matrices(graph, community=community, weight=weight)
    source = members.select(F.col("node").alias("source"), F.col("community").alias("i"))
    dest = members.select(F.col("node").alias("dest"), F.col("community").alias("j"))
    # The sums below read the placed edges six times.
    placed = written(edges.join(source, "source").join(dest, "dest"), "placed")
    towards = placed.groupBy("source", "i", "j").agg(F.sum("weight").alias("md")).filter("md != 0")
    outward = towards.filter("i != j")
    own = towards.filter("i = j").select("source", F.col("md").alias("own"))
    # Weight to own members that are not internal towards j, since they reach j themselves.
    reaching = outward.select(F.col("source").alias("dest"), F.col("j").alias("k"))
    exposed = placed.filter("i = j").select("source", "dest", "weight").join(reaching, "dest").groupBy("source", F.col("k").alias("j")).agg(F.sum("weight").alias("exposed"))
    ms = F.coalesce("own", F.lit(0)) - F.coalesce("exposed", F.lit(0))
    boundary = outward.join(own, "source", "left").join(exposed, ["source", "j"], "left").withColumn("ms", ms).filter("ms != 0")
    cells = boundary.groupBy("i", "j").agg(
        F.avg(F.col("ms") / (F.col("ms") + F.col("md")) - 0.5).alias("antagonism"),
        (100.0 * F.sum((F.col("ms") < F.col("md")).cast("long")) / F.count("*")).alias("porosity"),
    )
    if not full:
        return cells.select("i", "j", "antagonism", "porosity")
    # The result itself is a matrix of communities; their number, not the graph's, is squared.
    names = placed.select(F.col("i").alias("community")).union(placed.select("j")).distinct()
    matrix = names.select(F.col("community").alias("i")).crossJoin(names.select(F.col("community").alias("j")))
    zero = F.lit(0.0)
    return matrix.join(cells, ["i", "j"], "left").select("i", "j", F.coalesce("antagonism", zero).alias("antagonism"), F.coalesce("porosity", zero).alias("porosity"))


@dataclass(frozen=True)
class Workflow:
    """Polarisation of one kind of interaction between the communities of another.

    ``strict`` is the significance test of the first graph; ``again`` applies
    it to the integrated graph too.
    """

    label: str = "uid"
    strict: bool = True
    again: bool = False
    on_missing: object = -1

    def run(self, first: Data, second: Data, communities: Data, *, source: object, first_dest: object, second_dest: object, node: str) -> DataFrame:
        graph = add_community(interaction_graph(first, source, first_dest, self.label), communities, node=node, on_missing=self.on_missing)
        graph = Data(written(graph.to_df(), "graph"), graph.model)
        nodes = extract_nodes(keep_significant(graph, strict=self.strict))
        nodes = Data(written(nodes.to_df(), "nodes"), nodes.model)
        other = integrate(interaction_graph(second, source, second_dest, self.label), nodes, key=self.label)
        if self.again:
            other = keep_significant(Data(written(other.to_df(), "integrated"), other.model), strict=self.strict)
        return polarisation(other)
