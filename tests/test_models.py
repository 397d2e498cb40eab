"""Conformance of schemas to models: the type matrix, structure and negatives. No session is needed."""

import pytest
from pyspark.sql import types as T

from typeframe import JSON, Graph, ModelError, Relation
from typeframe.plans.models import as_model

from .helpers import schema as parse


EVERY = "a string, b int, c double, d bigint, e boolean"


@pytest.mark.parametrize(
    ("model", "schema", "fits"),
    [
        (Relation, f"{EVERY}, f date", True),
        (Relation, "a float", False),
        (Relation, "a array<int>", False),
        (Relation, "a struct<b:int>", False),
        (Relation, "", False),
        *((Relation, f"a {t}", False) for t in ("tinyint", "smallint", "decimal(10,2)", "binary", "timestamp", "timestamp_ntz", "map<string,int>")),
        (JSON, EVERY, True),
        (JSON, "", True),
        (JSON, "a date", False),
        (JSON, "a float", False),
        (JSON, "a array<date>", False),
        (JSON, "a array<struct<b:array<double>,c:struct<d:int>>>", True),
        (JSON, "a struct<b:struct<c:date>>", False),
        (Graph("id", "id", "weight"), "source struct<id:int>, dest struct<id:int>, edge struct<weight:int>", True),
        (Graph("x", "y", "z"), "source struct<x:string,i:int>, dest struct<y:double,l:bigint>, edge struct<z:boolean>", True),
        (Graph("id", "id", "w"), "source struct<id:int>, dest struct<id:int>, edge struct<w:int,d:date>", False),
        (Graph("id", "id", "w"), "source struct<id:int,n:struct<a:int>>, dest struct<id:int>, edge struct<w:int>", False),
        (Graph("id", "id", "w"), "source struct<id:int,n:array<int>>, dest struct<id:int>, edge struct<w:int>", True),
        (Graph("no", "id", "w"), "source struct<id:int>, dest struct<id:int>, edge struct<w:int>", False),
        (Graph("id", "no", "w"), "source struct<id:int>, dest struct<id:int>, edge struct<w:int>", False),
        (Graph("id", "id", "w"), "dest struct<id:int>, source struct<id:int>, edge struct<w:int>", False),
        (Graph("id", "id", "w"), "source struct<id:int>, dest struct<id:int>, edge struct<w:int>, more int", False),
    ],
)
def test_matrix(model, schema, fits):
    assert model.conforms(parse(schema)) is fits
    if not fits:
        with pytest.raises(ModelError):
            model.validate(parse(schema))


def test_empty_graph_records():
    whole = {n: T.StructType([T.StructField("id", T.IntegerType())]) for n in Graph.RECORDS}
    for n in Graph.RECORDS:
        cut = {**whole, n: T.StructType([])}
        assert not Graph("id", "id", "id").conforms(T.StructType([T.StructField(k, v) for k, v in cut.items()]))


def test_graph_needs_ids():
    with pytest.raises(ModelError):
        as_model(Graph)


def test_names():
    assert [Relation.name, JSON.name, Graph("a", "b", "c").name] == ["Relation", "JSON", "Graph"]
    assert Graph("a", "b", "c").renamed(("dest", "b"), "x") == Graph("a", "x", "c")
