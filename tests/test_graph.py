"""Graphs, the workflow against a dense matrix form, sources and streams."""

import itertools
import json
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeframe import JSON, Data, Graph, ModelError, Relation, SchemaError, build_graph, col, migrate
from typeframe.operators import graph as G
from typeframe.sources import community_xml, interactions, read, write
from typeframe.streaming import read_stream, windowed_edges

from .helpers import schema

EDGES = [(0, 0, 1, 0, 5), (1, 0, 2, 0, 1), (0, 0, 3, 1, 2), (2, 0, 1, 0, 3), (3, 1, 4, 1, 2), (4, 1, 0, 0, 1), (4, 1, 3, 1, 1), (1, 0, 0, 0, 2)]


def graph(spark, edges):
    df = spark.createDataFrame(edges, "a int, i int, b int, j int, w int")
    return Data(df.select(F.struct(F.col("a").alias("uid"), F.col("i").alias("community")).alias("source"), F.struct(F.col("b").alias("uid"), F.col("j").alias("community")).alias("dest"), F.struct(F.col("w").alias("weight")).alias("edge")), Graph("uid", "uid", "weight"))


def dense(edges):
    """The definition, cell by cell."""
    of, w = {}, {}
    for a, i, b, j, x in edges:
        of[a], of[b] = i, j
        w[a, b] = w.get((a, b), 0) + x
    names = sorted(set(of.values()))
    md = {(u, k): sum(x for (a, b), x in w.items() if a == u and of[b] == k) for u in of for k in names}
    cells = {}
    for i, j in itertools.product(names, names):
        values = []
        for u in of:
            if of[u] != i or i == j or not md[u, j]:
                continue
            ms = sum(x for (a, b), x in w.items() if a == u and of[b] == i and md[b, j] == 0)
            if ms:
                values.append(ms / (ms + md[u, j]) - 0.5)
        cells[i, j] = (sum(values) / len(values), 100 * sum(v < 0 for v in values) / len(values)) if values else (0.0, 0.0)
    return cells


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_polarisation(spark, seed):
    edges = EDGES
    if seed:
        r = random.Random(seed)
        edges = [(a, a % 3, b, b % 3, r.randint(1, 4)) for a in range(14) for b in range(14) if a != b and r.random() < 0.25]
    got = {(r["i"], r["j"]): (r["antagonism"], r["porosity"]) for r in G.polarisation(graph(spark, edges)).collect()}
    want = dense(edges)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_build(spark):
    people = Data(spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("b", "a", 1), (None, "a", 1)], "x string, y string, k int"), Relation)
    d = build_graph(people, "x", "y")
    assert d.model == Graph("x", "y", "weight") and d.schema["edge"].dataType["weight"].dataType == T.IntegerType()
    assert {(r["source"]["x"], r["dest"]["y"]): r["edge"]["weight"] for r in d.to_df().collect()} == {("a", "b"): 2, ("b", "a"): 1, (None, "a"): 1}
    assert build_graph(people, "x", "y", edge_attributes=("k",)).count() == 4
    assert migrate(d, Relation, col("source.x").alias("from"), "edge.weight").count() == 3
    with pytest.raises(ModelError):
        migrate(d, Relation)
    with pytest.raises(SchemaError):
        G.extract_nodes(people)
    assert d.rename("source.x", "id").model == Graph("id", "y", "weight")
    with pytest.raises(ModelError):
        d.drop("source.x")


def test_steps(spark):
    g = graph(spark, EDGES)
    assert G.extract_nodes(g).count() == 5
    # Five nodes, eight edges: the limit is 4, so no community of three or two is large.
    assert G.keep_significant(g).count() == 0
    few = graph(spark, EDGES[:4])
    assert G.keep_significant(few).count() == 3
    nodes = Data(spark.createDataFrame([(0, 7), (1, 8)], "uid int, rank int"), Relation)
    got = G.integrate(g, nodes, key="uid").to_df().collect()
    assert {(r["source"]["rank"], r["dest"]["rank"]) for r in got} == {(7, 8), (8, 7)}
    bare = build_graph(Data(g.to_df().select(F.col("source.uid").alias("a"), F.col("dest.uid").alias("b")), Relation), col("a").alias("uid"), col("b").alias("uid"))
    found = Data(spark.createDataFrame([(0, 1)], "node int, community int"), Relation)
    filled = G.add_community(bare, found, node="node", on_missing=-1)
    assert {r["source"]["community"] for r in filled.to_df().collect()} == {1, -1}
    with pytest.raises(Exception, match="no community"):
        G.add_community(bare, found, node="node").to_df().collect()
    with pytest.raises(Exception, match="two communities"):
        G.as_matrices(graph(spark, [*EDGES, (0, 1, 1, 0, 1)]))[1].collect()
    labels = {r["node"]: r["community"] for r in G.propagate_communities(g, rounds=3).to_df().collect()}
    assert set(labels) == {0, 1, 2, 3, 4}


def test_sources(spark, tmp_path):
    lines = [{"user": {"id": "1"}, "retweeted_status": {"user": {"id": "2"}}}, {"user": {"id": "1"}, "quoted_status": {"user": {"id": "3"}}}, {"user": {"id": "2"}, "retweeted_status": None}]
    (tmp_path / "cs.json").write_text("\n".join(map(json.dumps, lines)))
    nodes = "".join(f'<node><data key="v_name">{n}</data><data key="v_community">{c}</data></node>' for n, c in ((1, 0), (2, 1)))
    (tmp_path / "g.xml").write_text(f"<graphml><graph>{nodes}</graph></graphml>")
    posts = interactions(spark, str(tmp_path / "cs.json"), "retweeted_status")
    assert posts.count() == 1
    assert interactions(spark, str(tmp_path / "cs.json"), "quoted_status", id_type="double").schema["user"].dataType["id"].dataType == T.DoubleType()
    found = community_xml(spark, str(tmp_path / "g.xml"))
    assert sorted(tuple(r) for r in found.to_df().collect()) == [("1", 0), ("2", 1)]
    edges = G.add_community(G.interaction_graph(posts, "user.id", "retweeted_status.user.id", "uid"), found, node="node")
    assert edges.to_df().first().asDict(True) == {"source": {"uid": "1", "community": 0}, "dest": {"uid": "2", "community": 1}, "edge": {"weight": 1}}
    for kind in ("parquet", "orc", "json", "csv"):
        path = str(tmp_path / kind)
        write(found, path, format=kind)
        assert read(spark, path, Relation, format=kind, schema=found.schema).count() == 2
    with pytest.raises(ModelError):
        read(spark, "nowhere", Relation, schema=schema("a float"))


def test_stream(spark, tmp_path):
    fields = schema("ts timestamp, n struct<a:int>, b int")
    rows = [("2026-01-01 00:00:01", (1,), 2), ("2026-01-01 00:00:02", (1,), 2), ("2026-01-01 01:00:00", (1,), 2), (None, (1,), 2)]
    spark.createDataFrame(rows, "ts string, n struct<a:int>, b int").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    with pytest.raises(ModelError):
        read_stream(spark, str(tmp_path / "in"), fields, JSON)
    data = read_stream(spark, str(tmp_path / "in"), fields, JSON, time="ts")
    assert data.model == JSON and data.schema["ts"].dataType == T.LongType()
    text = Data(data.to_df().withColumn("ts", F.timestamp_micros("ts").cast("string")), JSON)
    for name, stream in (("micros", data), ("texts", text)):
        with pytest.raises(SchemaError):
            windowed_edges(stream, "b", "n.a", "b", window="1 minute", late="1 minute")
        query = windowed_edges(stream, "ts", "n.a", "b", window="1 minute", late="1 minute").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        assert [(r["source"], r["dest"], r["weight"]) for r in spark.table(name).collect()] == [(1, 2, 2)]


def test_workflow(spark):
    # Two communities of five pass the first graph's limit, that of node 10 does not.
    of = {n: n // 5 for n in range(11)}
    first = [(n, n + 1) for n in range(10) if n != 4]
    r = random.Random(8)
    second = [(a, b) for a in range(11) for b in range(12) if a != b and r.random() < (0.5 if a // 5 == b // 5 else 0.08) for _ in range(r.randint(1, 3))]
    posts = Data(spark.createDataFrame([(a, b, None) for a, b in first] + [(a, None, b) for a, b in second], "a int, b int, c int"), Relation)
    found = Data(spark.createDataFrame(list(of.items()), "node int, community int"), Relation)
    got = G.Workflow(strict=False).run(posts.filter(col("b").is_not_null()), posts.filter(col("c").is_not_null()), found, source="a", first_dest="b", second_dest="c", node="node")
    pairs, ends = set(first), {n for p in first for n in p}
    large = {c for c in of.values() if sum(of[n] == c for n in ends) >= (2 * len(pairs)) ** 0.5}
    kept = {n for a, b in pairs if of[a] in large and of[b] in large for n in (a, b)}
    assert large == {0, 1} and kept == set(range(10))
    weights = {p: second.count(p) for p in second if set(p) <= kept}
    want = dense([(a, of[a], b, of[b], w) for (a, b), w in weights.items()])
    rows = {(r["i"], r["j"]): (r["antagonism"], r["porosity"]) for r in got.collect()}
    assert rows.keys() == want.keys() and all(rows[k] == pytest.approx(want[k]) for k in want)
    assert any(v != (0.0, 0.0) for v in want.values())


def planted(spark, sizes, bridges):
    """Cliques joined by single edges, nodes named apart from their clique."""
    nodes = {(k, i): 100 * i + k for k, n in enumerate(sizes) for i in range(n)}
    edges = [(nodes[k, i], nodes[k, j]) for k, n in enumerate(sizes) for i in range(n) for j in range(i)]
    edges += [(nodes[k, 0], nodes[(k + 1) % len(sizes), 1]) for k in range(bridges)]
    rows = Data(spark.createDataFrame([e for e in edges for _ in range(2)], "a int, b int"), Relation)
    return build_graph(rows, col("a").alias("uid"), col("b").alias("uid")), {v: k for (k, _), v in nodes.items()}


def groups(communities):
    out = {}
    for n, c in communities.items():
        out.setdefault(c, set()).add(n)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize(("sizes", "bridges"), [([5, 6, 7], 3), ([4, 4, 4, 4, 4, 9], 6)])
def test_communities_of_planted_cliques(spark, sizes, bridges):
    g, of = planted(spark, sizes, bridges)
    found = G.modularity_communities(g)
    assert groups({r["node"]: r["community"] for r in found.to_df().collect()}) == groups(of)
    best = G.modularity(g, Data(spark.createDataFrame(list(of.items()), "node int, community int"), Relation))
    assert G.modularity(g, found) == pytest.approx(best)
    # Label propagation is the cheaper and coarser way.
    assert 0.6 * best < G.modularity(g, G.propagate_communities(g)) <= best + 1e-9
    alone = Data(spark.createDataFrame([(n, n) for n in of], "node int, community int"), Relation)
    assert G.modularity(g, alone) < 0 < best


def test_modularity_is_the_definition(spark):
    g = graph(spark, EDGES)
    w = {}
    for a, _, b, _, x in EDGES:
        w[a, b] = w.get((a, b), 0) + x
        w[b, a] = w.get((b, a), 0) + x
    of = {0: 0, 1: 0, 2: 0, 3: 1, 4: 1}
    m2, k = sum(w.values()), {n: sum(x for (a, _), x in w.items() if a == n) for n in of}
    want = sum(w.get((a, b), 0) - k[a] * k[b] / m2 for a in of for b in of if of[a] == of[b]) / m2
    given = Data(spark.createDataFrame(list(of.items()), "node int, community int"), Relation)
    assert G.modularity(g, given) == pytest.approx(want)
    assert G.modularity(g, G.modularity_communities(g)) >= want - 1e-9
    assert G.modularity_communities(Data(g.to_df().filter("false"), g.model)).count() == 0


def test_cluster_needs_a_shared_folder():
    from typeframe.operators import lineage

    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=SimpleNamespace(master=master))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            lineage.shared_dir(session(master))
        assert lineage.shared_dir(session(master, "hdfs://shared/")) == "hdfs://shared"
    assert lineage.shared_dir(session("local[4]"))
