"""The operators' queries over the synthetic tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import JSON, Data, Relation, avg, build_graph, col, count, func, max_, median, migrate, min_, product, sum_
from .functions import register
from .operators import graph as G
from .operators.lineage import removed_at_exit, working_path
from .plans import records, schema_ops
from .plans.models import Model
from .sources import community_xml, interactions, write

Query = Callable[[SparkSession, str], DataFrame]

#: Columns that make each table a relation; times become dates.
COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"],
}


def relation(spark: SparkSession, sf_dir: str, name: str, model: Model = Relation) -> Data:
    return Data(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*COLUMNS[name]), model)


def _on(name: str, build: Callable[[Data], Data]) -> Query:
    return lambda spark, sf: build(relation(spark, sf, name)).to_df()


def _two(left: str, right: str, build: Callable[[Data, Data], Data]) -> Query:
    return lambda spark, sf: build(relation(spark, sf, left), relation(spark, sf, right)).to_df()


# Functions of attributes, for the function operators.


def _short(name: str) -> bool:
    return name is not None and len(name) <= 8


def _low(n_nationkey: int, n_name: str, n_regionkey: int) -> bool:
    return n_nationkey % 2 == 0 and n_name is not None and n_regionkey < 3


def _tag(key: int, name: str) -> str:
    return f"{key}:{name}"


def _double(key: int) -> int:
    return 2 * key


def _lower(name: str) -> str:
    return name.lower()


def _power(name: str, key: int) -> int:
    return 2 ** (40 + key % 7) + len(name)


@dataclass
class Place:
    name: str
    lat: float


@dataclass
class Visit:
    who: str
    times: int
    known: bool
    place: Place
    tags: list[str]


VISITS = [Visit("ann", 3, True, Place("quay", 1.5), ["a", "b"]), Visit("bob", 2**40, False, Place("mill", -2.0), [])]


def _nested(spark: SparkSession, sf: str) -> Data:
    df = relation(spark, sf, "customer").to_df()
    return Data(df.select("c_custkey", F.struct(F.col("c_nationkey").alias("nationkey"), F.struct(F.col("c_mktsegment").alias("name")).alias("segment")).alias("addr")), JSON)


def _saved(spark: SparkSession, data: Data, name: str, format: str, **options: object) -> str:
    path = working_path(spark, name)
    write(data, path, format=format, **options)
    removed_at_exit(spark, path)
    return path


def _interactions(kind: str) -> Query:
    """Returned and other shipments written as JSON lines of two kinds, and one kind read back."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        user = lambda c: F.struct(F.struct(F.col(c).cast("string").alias("id")).alias("user"))
        returned = F.col("l_returnflag") == "R"
        lines = shipments(spark, sf).to_df().select(F.struct(F.col("customer").cast("string").alias("id")).alias("user"), F.when(returned, user("supplier")).alias("retweeted_status"), F.when(~returned, user("supplier")).alias("quoted_status"))
        found = interactions(spark, _saved(spark, Data(lines, JSON), "interactions", "json"), kind, id_type="bigint")
        return found.group_by(col("user.id").alias("source"), col(kind) >> "user" >> col("id").alias("dest")).agg(count("user.id")).change_model(Relation).to_df()

    return run


def _community_file(spark: SparkSession, sf: str) -> DataFrame:
    """Nations and their regions written as a graph file's nodes, and read back."""
    datum = lambda key, c: F.struct(F.col(c).cast("string").alias("_VALUE"), F.lit(key).alias("_key"))
    nodes = relation(spark, sf, "nation").to_df().select(F.array(datum("label", "n_nationkey"), datum("v_community", "n_regionkey"), datum("v_name", "n_name")).alias("data"))
    return community_xml(spark, _saved(spark, Data(nodes, JSON), "communities", "xml", rootTag="graph", rowTag="node")).to_df()


def _registered(spark: SparkSession, sf: str) -> DataFrame:
    register(spark, "typeframe_power", _power)
    relation(spark, sf, "nation").to_df().createOrReplaceTempView("typeframe_nation")
    return spark.sql("SELECT n_name, typeframe_power(n_name, n_nationkey) AS power FROM typeframe_nation WHERE typeframe_power(n_name, n_nationkey) > 2199023255552")


def _models(spark: SparkSession, sf: str) -> DataFrame:
    nation = relation(spark, sf, "nation")
    found = [("table", nation), ("nested", _nested(spark, sf)), ("graph", build_graph(nation, "n_name", "n_regionkey")), ("retagged", nation.as_model(JSON))]
    return spark.createDataFrame([(k, d.model.name) for k, d in found], "kind string, model string")


def _schema_algebra(spark: SparkSession, sf: str) -> DataFrame:
    """Every schema operation on the nested customers, as text, with the value it gives for one record."""
    s = _nested(spark, sf).schema
    v = {"c_custkey": 7, "addr": {"nationkey": 3, "segment": {"name": "AUTO"}}}
    t = T.StructType([T.StructField("x", T.DateType()), T.StructField("y", T.StructType([T.StructField("z", T.ArrayType(T.DoubleType()))]))])
    w = {"x": "2026-01-01", "y": {"z": [1.5]}}
    one = lambda f: T.StructType([f])
    rows = [
        ("follow", schema_ops.follow_path(s, "addr.segment"), records.follow(v, "addr.segment")),
        ("select", one(schema_ops.select_field(s, "addr.segment", "market")), records.select(v, [{"addr.segment": "market"}])),
        ("select_many", schema_ops.select_many(s, ["addr.segment.name", "c_custkey"]), records.select(v, ["addr.segment.name", "c_custkey"])),
        ("add", schema_ops.add_field(s, "addr.segment", "rank", T.IntegerType()), records.add(v, "addr.segment", "rank", 1)),
        ("remove", schema_ops.remove_field(s, "addr.nationkey"), records.remove(v, "addr.nationkey")),
        ("replace", schema_ops.replace_field(s, "addr.nationkey", "nation", T.StringType()), records.replace(v, "addr.nationkey", "nation", "3")),
        ("merge", schema_ops.merge(s, t, "addr", "y"), records.merge(v, w, "addr", "y")),
        ("merge_left", schema_ops.merge_in_left(s, t, "addr.segment", "y"), records.merge_in_left(v, w, "addr.segment", "y")),
        ("merge_right", schema_ops.merge_in_right(s, t, "addr.segment", "y"), records.merge_in_right(v, w, "addr.segment", "y")),
    ]
    return spark.createDataFrame([(k, schema_ops.as_string(schema), str(value)) for k, schema, value in rows], "op string, schema string, value string")


def _from_records(spark: SparkSession, sf: str) -> DataFrame:
    found = Data.of(spark, VISITS, JSON, Visit)
    return found.select("who", "times", "known", col("place.name").alias("at"), "place.lat", "tags").to_df()


def _typed_exit(spark: SparkSession, sf: str) -> DataFrame:
    wanted = T.StructType([T.StructField("name", T.StringType()), T.StructField("n_regionkey", T.IntegerType())])
    return relation(spark, sf, "nation").select(col("n_name").alias("name"), "n_regionkey").to_df_as(wanted)


def _graph_ends(spark: SparkSession, sf: str) -> DataFrame:
    """A graph of nations and brands whose ends and edges all carry further attributes."""
    lines = relation(spark, sf, "lineitem").join(relation(spark, sf, "part"), col("l_partkey") == col("p_partkey")).keep_left_model()
    edges = build_graph(lines, "l_returnflag", "p_brand", source_attributes=("l_linestatus",), dest_attributes=("p_type", col("p_size").alias("size")), edge_attributes=("l_linenumber",))
    return migrate(edges, Relation, "source.l_returnflag", "source.l_linestatus", "dest.p_brand", "dest.p_type", "dest.size", "edge.l_linenumber", "edge.weight").to_df()


def shipments(spark: SparkSession, sf: str) -> Data:
    """Customer and supplier of every line item, in one id space."""
    orders = relation(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = relation(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    both = orders.join(lines, col("o_orderkey") == col("l_orderkey")).keep_left_model()
    return both.add("customer", col("o_custkey") * 2).keep_model().add("supplier", col("l_suppkey") * 2 + 1).keep_model().select("customer", "supplier", "l_returnflag")


def communities(spark: SparkSession, sf: str) -> Data:
    """The region of each customer and supplier."""
    nations = relation(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    customers = relation(spark, sf, "customer").join(nations, col("c_nationkey") == col("n_nationkey")).keep_left_model().add("node", col("c_custkey") * 2).keep_model()
    suppliers = relation(spark, sf, "supplier").join(nations, col("s_nationkey") == col("n_nationkey")).keep_left_model().add("node", col("s_suppkey") * 2 + 1).keep_model()
    pick = lambda d: d.select("node", col("n_regionkey").alias("community"))
    return pick(customers).union(pick(suppliers))


def shipment_graph(spark: SparkSession, sf: str) -> Data:
    edges = G.interaction_graph(shipments(spark, sf), "customer", "supplier", "uid")
    return G.add_community(edges, communities(spark, sf), node="node", on_missing=-1)


def _flat(graph: Data) -> DataFrame:
    return graph.to_df().select(
        F.col("source.uid").alias("source"), F.col("source.community").alias("i"), F.col("dest.uid").alias("dest"), F.col("dest.community").alias("j"), F.col("edge.weight").alias("weight")
    )


def _rounded(cells: DataFrame) -> DataFrame:
    # Adding zero turns a rounded negative zero into zero.
    return cells.select("i", "j", (F.round("antagonism", 6) + 0.0).alias("antagonism"), (F.round("porosity", 6) + 0.0).alias("porosity"))


def polarisation(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(G.polarisation(shipment_graph(spark, sf)))


def workflow(spark: SparkSession, sf: str) -> DataFrame:
    """All shipments find the communities' nodes; the returned ones are what is measured."""
    data = shipments(spark, sf)
    returned = data.filter(col("l_returnflag") == "R")
    return _rounded(G.Workflow().run(data, returned, communities(spark, sf), source="customer", first_dest="supplier", second_dest="supplier", node="node"))


def _graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = build_graph(shipments(spark, sf), "customer", "supplier")
    return edges.to_df().select(F.col("source.customer").alias("source"), F.col("dest.supplier").alias("dest"), F.col("edge.weight").alias("weight"))


def _graph_edges_attr(spark: SparkSession, sf: str) -> DataFrame:
    edges = build_graph(shipments(spark, sf), "customer", "supplier", edge_attributes=("l_returnflag",))
    return edges.to_df().select(F.col("source.customer").alias("source"), F.col("dest.supplier").alias("dest"), F.col("edge.l_returnflag").alias("flag"), F.col("edge.weight").alias("weight"))


def _graph_integrate(spark: SparkSession, sf: str) -> DataFrame:
    nodes = G.extract_nodes(G.keep_significant(shipment_graph(spark, sf)))
    returned = G.interaction_graph(shipments(spark, sf).filter(col("l_returnflag") == "R"), "customer", "supplier", "uid")
    return _flat(G.integrate(returned, nodes, key="uid"))


def _construct_project(spark: SparkSession, sf: str) -> DataFrame:
    edges = build_graph(shipments(spark, sf), "customer", "supplier")
    return migrate(edges, Relation, col("source.customer").alias("buyer"), "dest.supplier", "edge.weight").to_df()


def _matrices(spark: SparkSession, sf: str) -> DataFrame:
    _, members = G.as_matrices(shipment_graph(spark, sf))
    return G.community_order(members)


_ARITHMETIC = {"mod": (lambda c: c % 7, "p_size % 7"), "mul": (lambda c: c * c, "p_size * p_size"), "plus": (lambda c: c + 3, "p_size + 3"), "minus": (lambda c: c - 3, "p_size - 3"), "div": (lambda c: c / 4, "p_size / 4.0::DOUBLE")}
_COMPARE = {
    "eq": (col("c_nationkey") == 3, "c_nationkey = 3"), "ne": (col("c_nationkey") != 3, "c_nationkey <> 3"), "gt": (col("c_acctbal") > 5000.0, "c_acctbal > 5000"), "lt": (col("c_acctbal") < 0.0, "c_acctbal < 0"),
    "ge": (col("c_nationkey") >= 20, "c_nationkey >= 20"), "le": (col("c_nationkey") <= 2, "c_nationkey <= 2"),
    "not": (~(col("c_nationkey") > 3), "NOT c_nationkey > 3"), "in": (col("c_nationkey").is_in(1, 5, 7), "c_nationkey IN (1, 5, 7)"), "between": (col("c_nationkey").between(4, 6), "c_nationkey BETWEEN 4 AND 6"), "like": (col("c_mktsegment").like("%U%"), "c_mktsegment LIKE '%U%'"),
}
_AGGREGATE = {
    "count": (count, "l_quantity", "count(l_quantity)"), "max": (max_, "l_quantity", "max(l_quantity)"), "min": (min_, "l_quantity", "min(l_quantity)"),
    "avg": (avg, "l_quantity", "avg(l_quantity)"), "median": (median, "l_quantity", "median(l_quantity)"), "sum": (sum_, "l_linenumber", "sum(l_linenumber)::BIGINT"),
}
_JOIN = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}


def _aggregated(op: str) -> Query:
    build, path, _ = _AGGREGATE[op]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = relation(spark, sf, "lineitem").group_by("l_returnflag").agg(build(path)).keep_model().to_df()
        return df.withColumn(op, F.round(op, 6)) if op in ("avg", "median") else df

    return run


def _joined(mode: str) -> Query:
    def build(c: Data, s: Data) -> Data:
        return c.join(s, _earlier(), mode).keep_left_model().select("c_custkey", "c_nationkey", "s_suppkey", "s_nationkey")

    return _two("customer", "supplier", build)


def _earlier():
    """Suppliers of the customer's nation with a larger key: both whole tables have rows without a partner."""
    return (col("c_nationkey") == col("s_nationkey")) & (col("c_custkey") < col("s_suppkey"))


def _partnerless(null: bool) -> Query:
    """Null tests on the optional side of an outer join."""
    test = col("s_suppkey").is_null() if null else col("s_suppkey").is_not_null()
    return _two("customer", "supplier", lambda c, s: c.join(s, _earlier(), "left").keep_left_model().filter(test).select("c_custkey", "s_suppkey"))


def queries() -> dict[str, Query]:
    on, two = _on, _two
    found: dict[str, Query] = {
        "select_alias": on("customer", lambda d: d.select(col("c_name").alias("name"))),
        "select_nested": lambda spark, sf: _nested(spark, sf).select("c_custkey", col("addr") >> "nationkey", col("addr.segment.name").alias("segment"), model=Relation).to_df(),
        "filter_and_or": on("customer", lambda d: d.filter(((col("c_acctbal") > 0.0) & (col("c_nationkey") < 5)) | (col("c_mktsegment") == "BUILDING"))),
        "filter_udf": on("nation", lambda d: d.filter(func(_short, "n_name"))),
        "filter_udf_all": on("nation", lambda d: d.filter(func(_low, "*"))),
        "add_const": on("nation", lambda d: d.add("origin", "table").keep_model()),
        "add_list": on("nation", lambda d: d.add("tags", ["a", "b"]).change_model(JSON)),
        "add_nested": lambda spark, sf: _nested(spark, sf).add("addr.segment.rank", 1).keep_model().select("c_custkey", "addr.segment.rank", model=Relation).to_df(),
        "add_udf": on("region", lambda d: d.add("twice", func(_double, "r_regionkey", returns=T.IntegerType())).keep_model()),
        "add_udf_wide": on("nation", lambda d: d.add("power", func(_power, "n_name", "n_nationkey")).keep_model()),
        "register_function": _registered,
        "add_udf_all": on("region", lambda d: d.add("tag", func(_tag, "*")).keep_model()),
        "drop": on("nation", lambda d: d.drop("n_name")),
        "drop_nested": lambda spark, sf: _nested(spark, sf).drop("addr.nationkey").select("c_custkey", "addr.segment.name", model=Relation).to_df(),
        "rename": on("nation", lambda d: d.rename("n_name", "name")),
        "rename_nested": lambda spark, sf: _nested(spark, sf).rename("addr.segment.name", "market").select("c_custkey", "addr.segment.market", model=Relation).to_df(),
        "update": on("nation", lambda d: d.update("n_name", func(_lower, "n_name")).keep_model()),
        "update_rename": on("nation", lambda d: d.update("n_nationkey", func(_double, "n_nationkey", returns=T.IntegerType()), "twice").keep_model()),
        "join_cross": two("nation", "region", lambda n, r: n.join(r, col("n_regionkey") != col("r_regionkey"), "cross").keep_left_model()),
        "join_semi": two("customer", "supplier", lambda c, s: c.join(s, _earlier(), "left_semi").select("c_custkey")),
        "join_anti": two("customer", "supplier", lambda c, s: c.join(s, _earlier(), "left_anti").select("c_custkey")),
        "join_prefixed": two("nation", "nation", lambda a, b: a.join(b, (col("n_regionkey") == col("n_regionkey")) & (col("n_nationkey") < col("n_nationkey")), right_prefix="other_").keep_left_model().select("n_name", "other_n_name")),
        "join_theta": two("nation", "region", lambda n, r: n.join(r, col("n_regionkey") > col("r_regionkey")).keep_left_model()),
        "join_and": two("supplier", "customer", lambda s, c: s.join(c, (col("s_nationkey") == col("c_nationkey")) & (col("s_acctbal") < col("c_acctbal"))).keep_left_model().group_by("s_suppkey").agg(count("c_custkey")).keep_model()),
        "join_or": two("nation", "region", lambda n, r: n.join(r, (col("n_regionkey") == col("r_regionkey")) | (col("n_nationkey") < col("r_regionkey"))).keep_left_model()),
        "agg_multi": on("orders", lambda d: d.group_by("o_orderstatus", "o_orderpriority").agg(count("o_orderkey"), min_("o_totalprice").alias("low"), max_("o_totalprice").alias("high")).keep_model()),
        "agg_product": on("nation", lambda d: d.group_by("n_regionkey").agg(product("n_nationkey")).keep_model()),
        "segment_balance": lambda spark, sf: relation(spark, sf, "customer").filter(col("c_acctbal") > 0.0).group_by("c_mktsegment").agg(count("c_custkey"), avg("c_acctbal")).keep_model().to_df().withColumn("avg", F.round("avg", 4)),
        "order_multi": on("orders", lambda d: d.order_by(col("o_orderstatus").asc(), col("o_totalprice").desc(), "o_orderkey").select("o_orderstatus", "o_totalprice", "o_orderkey")),
        "union_distinct": two("customer", "supplier", lambda c, s: c.select(col("c_nationkey").alias("k")).union(s.select(col("s_nationkey").alias("k"))).distinct()),
        "retag": on("nation", lambda d: d.as_model(JSON).add("names", ["a"]).keep_model()),
        "typed_exit": _typed_exit,
        "count_rows": lambda spark, sf: spark.createDataFrame([(relation(spark, sf, "lineitem").count(),)], "n long"),
        "models": _models,
        "from_records": _from_records,
        "schema_algebra": _schema_algebra,
        "source_retweets": _interactions("retweeted_status"),
        "source_quotes": _interactions("quoted_status"),
        "source_communities": _community_file,
        "construct_migrate": on("customer", lambda d: migrate(d, JSON).add("tags", ["x"]).keep_model()),
        "construct_project": _construct_project,
        "graph_edges_ends": _graph_ends,
        "graph_edges": _graph_edges,
        "graph_edges_attr": _graph_edges_attr,
        "graph_community": lambda spark, sf: _flat(shipment_graph(spark, sf)),
        "graph_nodes": lambda spark, sf: G.extract_nodes(shipment_graph(spark, sf)).to_df(),
        "graph_significant": lambda spark, sf: _flat(G.keep_significant(shipment_graph(spark, sf))),
        "graph_integrate": _graph_integrate,
        "graph_sizes": _matrices,
        "polarisation": polarisation,
        "workflow": workflow,
    }
    found |= {f"filter_cmp_{k}": on("customer", lambda d, p=p: d.filter(p)) for k, (p, _) in _COMPARE.items()}
    found |= {f"add_arith_{k}": on("part", lambda d, f=f: d.add("x", f(col("p_size"))).keep_model().select("p_partkey", "x")) for k, (f, _) in _ARITHMETIC.items()}
    found |= {f"agg_{k}": _aggregated(k) for k in _AGGREGATE}
    found |= {f"join_{k}": _joined(k) for k in _JOIN}
    found |= {"filter_cmp_null": _partnerless(True), "filter_cmp_not_null": _partnerless(False)}
    return found


#: What each schema operation gives, written out by hand.
_ALGEBRA = ", ".join(
    "('{}', '{}', '{}')".format(op, schema, value.replace("'", "''"))
    for op, schema, value in (
        ("follow", "- nationkey: Int\n- segment:\n  - name: String\n", "{'nationkey': 3, 'segment': {'name': 'AUTO'}}"),
        ("select", "- market:\n  - name: String\n", "{'market': {'name': 'AUTO'}}"),
        ("select_many", "- name: String\n- c_custkey: Long\n", "{'name': 'AUTO', 'c_custkey': 7}"),
        ("add", "- c_custkey: Long\n- addr:\n  - nationkey: Int\n  - segment:\n    - name: String\n    - rank: Int\n", "{'c_custkey': 7, 'addr': {'nationkey': 3, 'segment': {'name': 'AUTO', 'rank': 1}}}"),
        ("remove", "- c_custkey: Long\n- addr:\n  - segment:\n    - name: String\n", "{'c_custkey': 7, 'addr': {'segment': {'name': 'AUTO'}}}"),
        ("replace", "- c_custkey: Long\n- addr:\n  - nation: String\n  - segment:\n    - name: String\n", "{'c_custkey': 7, 'addr': {'nation': '3', 'segment': {'name': 'AUTO'}}}"),
        ("merge", "- nationkey: Int\n- segment:\n  - name: String\n- z: List[Double]\n", "{'nationkey': 3, 'segment': {'name': 'AUTO'}, 'z': [1.5]}"),
        ("merge_left", "- c_custkey: Long\n- addr:\n  - nationkey: Int\n  - segment:\n    - name: String\n    - z: List[Double]\n", "{'c_custkey': 7, 'addr': {'nationkey': 3, 'segment': {'name': 'AUTO', 'z': [1.5]}}}"),
        ("merge_right", "- x: LocalDate\n- y:\n  - z: List[Double]\n  - name: String\n", "{'x': '2026-01-01', 'y': {'z': [1.5], 'name': 'AUTO'}}"),
    )
)
_CELLS = """
own AS (SELECT source, i, sum(md) AS own FROM toward WHERE i = j GROUP BY source, i),
expo AS (SELECT p.source, t.j, sum(p.weight) AS e FROM placed p JOIN toward t ON p.dest = t.source AND t.i <> t.j WHERE p.i = p.j GROUP BY p.source, t.j),
b AS (SELECT t.i, t.j, t.md, coalesce(o.own, 0) - coalesce(x.e, 0) AS ms FROM toward t LEFT JOIN own o ON t.source = o.source LEFT JOIN expo x ON t.source = x.source AND t.j = x.j WHERE t.i <> t.j),
c AS (SELECT i, j, avg(ms::DOUBLE / (ms + md) - 0.5) AS antagonism, 100.0 * sum(CASE WHEN ms < md THEN 1 ELSE 0 END)::DOUBLE / count(*) AS porosity FROM b WHERE ms <> 0 GROUP BY i, j),
k AS (SELECT DISTINCT i AS name FROM placed UNION SELECT DISTINCT j FROM placed)
SELECT x.name AS i, y.name AS j, round(coalesce(antagonism, 0), 6) + 0.0 AS antagonism, round(coalesce(porosity, 0), 6) + 0.0 AS porosity
FROM k x CROSS JOIN k y LEFT JOIN c ON c.i = x.name AND c.j = y.name"""
_SHIP = "ship AS (SELECT o_custkey * 2 AS customer, l_suppkey * 2 + 1 AS supplier, l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_COMM = "comm AS (SELECT c_custkey * 2 AS node, n_regionkey AS community FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_suppkey * 2 + 1, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_EDGES = f"{_SHIP}, {_COMM}, e AS (SELECT customer AS source, supplier AS dest, count(*)::INT AS weight FROM ship GROUP BY ALL)"
_GRAPH = f"{_EDGES}, g AS (SELECT source, coalesce(a.community, -1) AS i, dest, coalesce(b.community, -1) AS j, weight FROM e LEFT JOIN comm a ON source = a.node LEFT JOIN comm b ON dest = b.node)"
_NODES = f"{_GRAPH}, nodes AS (SELECT source AS uid, i AS community FROM g UNION SELECT dest, j FROM g)"
_BIG = f"{_NODES}, big AS (SELECT community FROM nodes GROUP BY community HAVING count(*) > sqrt(2.0 * (SELECT count(*) FROM g))), sig AS (SELECT * FROM g WHERE i IN (SELECT community FROM big) AND j IN (SELECT community FROM big))"
_INTEG = f"""{_BIG}, known AS (SELECT source AS uid, i AS community FROM sig UNION SELECT dest, j FROM sig),
r AS (SELECT customer AS source, supplier AS dest, count(*)::INT AS weight FROM ship WHERE l_returnflag = 'R' GROUP BY ALL),
placed AS (SELECT source, a.community AS i, dest, b.community AS j, weight FROM r JOIN known a ON source = a.uid JOIN known b ON dest = b.uid)"""
_TOWARD = "toward AS (SELECT source, i, j, sum(weight) AS md FROM placed GROUP BY ALL)"


def oracle_sql() -> dict[str, str]:
    found = {
        "select_alias": "SELECT c_name AS name FROM customer",
        "select_nested": "SELECT c_custkey, c_nationkey AS nationkey, c_mktsegment AS segment FROM customer",
        "filter_and_or": "SELECT * FROM customer WHERE (c_acctbal > 0 AND c_nationkey < 5) OR c_mktsegment = 'BUILDING'",
        "filter_udf": "SELECT * FROM nation WHERE length(n_name) <= 8",
        "filter_udf_all": "SELECT * FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey < 3",
        "add_const": "SELECT *, 'table' AS origin FROM nation",
        "add_list": "SELECT *, ['a', 'b'] AS tags FROM nation",
        "add_nested": "SELECT c_custkey, 1 AS rank FROM customer",
        "add_udf": "SELECT *, 2 * r_regionkey AS twice FROM region",
        "add_udf_wide": "SELECT *, (1::BIGINT << (40 + n_nationkey % 7)) + length(n_name) AS power FROM nation",
        "register_function": "SELECT n_name, (1::BIGINT << (40 + n_nationkey % 7)) + length(n_name) AS power FROM nation WHERE (1::BIGINT << (40 + n_nationkey % 7)) + length(n_name) > 2199023255552",
        "add_udf_all": "SELECT *, r_regionkey || ':' || r_name AS tag FROM region",
        "drop": "SELECT n_nationkey, n_regionkey FROM nation",
        "drop_nested": "SELECT c_custkey, c_mktsegment AS name FROM customer",
        "rename": "SELECT n_nationkey, n_name AS name, n_regionkey FROM nation",
        "rename_nested": "SELECT c_custkey, c_mktsegment AS market FROM customer",
        "update": "SELECT n_nationkey, lower(n_name) AS n_name, n_regionkey FROM nation",
        "update_rename": "SELECT 2 * n_nationkey AS twice, n_name, n_regionkey FROM nation",
        "join_cross": "SELECT * FROM nation CROSS JOIN region WHERE n_regionkey <> r_regionkey",
        "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE c_nationkey = s_nationkey AND c_custkey < s_suppkey)",
        "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE c_nationkey = s_nationkey AND c_custkey < s_suppkey)",
        "join_prefixed": "SELECT a.n_name, b.n_name AS other_n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
        "join_theta": "SELECT * FROM nation JOIN region ON n_regionkey > r_regionkey",
        "join_and": "SELECT s_suppkey, count(c_custkey) AS count FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal < c_acctbal GROUP BY s_suppkey",
        "join_or": "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey OR n_nationkey < r_regionkey",
        "agg_multi": "SELECT o_orderstatus, o_orderpriority, count(o_orderkey) AS count, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY ALL",
        "agg_product": "SELECT n_regionkey, product(n_nationkey) AS product FROM nation GROUP BY ALL",
        "segment_balance": "SELECT c_mktsegment, count(c_custkey) AS count, round(avg(c_acctbal), 4) AS avg FROM customer WHERE c_acctbal > 0 GROUP BY ALL",
        "order_multi": "SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders ORDER BY 1, 2 DESC, 3",
        "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
        "retag": "SELECT *, ['a'] AS names FROM nation",
        "typed_exit": "SELECT n_name AS name, n_regionkey FROM nation",
        "count_rows": "SELECT count(*) AS n FROM lineitem",
        "models": "SELECT * FROM (VALUES ('table', 'Relation'), ('nested', 'JSON'), ('graph', 'Graph'), ('retagged', 'JSON')) v(kind, model)",
        "from_records": "SELECT * FROM (VALUES ('ann', 3::BIGINT, true, 'quay', 1.5::DOUBLE, ['a', 'b']), ('bob', 1099511627776, false, 'mill', -2.0, [])) v(who, times, known, \"at\", lat, tags)",
        "schema_algebra": f"SELECT * FROM (VALUES {_ALGEBRA}) v(op, schema, value)",
        "source_retweets": f"WITH {_SHIP} SELECT customer AS source, supplier AS dest, count(*) AS count FROM ship WHERE l_returnflag = 'R' GROUP BY ALL",
        "source_quotes": f"WITH {_SHIP} SELECT customer AS source, supplier AS dest, count(*) AS count FROM ship WHERE l_returnflag <> 'R' GROUP BY ALL",
        "source_communities": "SELECT n_name AS node, n_regionkey AS community FROM nation",
        "construct_migrate": "SELECT *, ['x'] AS tags FROM customer",
        "graph_edges_ends": "SELECT l_returnflag, l_linestatus, p_brand, p_type, p_size AS size, l_linenumber, count(*)::INT AS weight FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
        "construct_project": f"WITH {_EDGES} SELECT source AS buyer, dest AS supplier, weight FROM e",
        "graph_edges": f"WITH {_EDGES} SELECT source, dest, weight FROM e",
        "graph_edges_attr": f"WITH {_SHIP} SELECT customer AS source, supplier AS dest, l_returnflag AS flag, count(*)::INT AS weight FROM ship GROUP BY ALL",
        "graph_community": f"WITH {_GRAPH} SELECT * FROM g",
        "graph_nodes": f"WITH {_NODES} SELECT * FROM nodes",
        "graph_significant": f"WITH {_BIG} SELECT * FROM sig",
        "graph_integrate": f"WITH {_INTEG} SELECT * FROM placed",
        "graph_sizes": f"WITH {_NODES} SELECT community, count(*) AS size FROM nodes GROUP BY community ORDER BY size DESC, community",
        "polarisation": f"WITH {_GRAPH}, placed AS (SELECT * FROM g), {_TOWARD}, {_CELLS}",
        "workflow": f"WITH {_INTEG}, {_TOWARD}, {_CELLS}",
    }
    found |= {f"filter_cmp_{k}": f"SELECT * FROM customer WHERE {sql}" for k, (_, sql) in _COMPARE.items()}
    found |= {f"add_arith_{k}": f"SELECT p_partkey, {sql} AS x FROM part" for k, (_, sql) in _ARITHMETIC.items()}
    found |= {f"agg_{k}": f"SELECT l_returnflag, {f'round({sql}, 6)' if k in ('avg', 'median') else sql} AS \"{k}\" FROM lineitem GROUP BY ALL" for k, (_, _, sql) in _AGGREGATE.items()}
    sides = "customer {} supplier ON c_nationkey = s_nationkey AND c_custkey < s_suppkey"
    found |= {f"join_{k}": f"SELECT c_custkey, c_nationkey, s_suppkey, s_nationkey FROM {sides.format(sql)}" for k, sql in _JOIN.items()}
    found |= {f"filter_cmp_{k}": f"SELECT c_custkey, s_suppkey FROM {sides.format('LEFT JOIN')} WHERE s_suppkey IS {sql}" for k, sql in (("null", "NULL"), ("not_null", "NOT NULL"))}
    return found

