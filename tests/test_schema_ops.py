"""Golden schemas of the algebra, on schemas and on values. No session is needed."""

from __future__ import annotations

from dataclasses import dataclass

import pytest
from pyspark.sql import types as T

from typeframe import SchemaError
from typeframe.plans import records as R
from typeframe.plans import schema_ops as X
from typeframe.plans.paths import decompose

from .helpers import schema

FLAT = schema("_a int, _b string")
DEEP = schema("a struct<aa:string,ab:int>, b struct<ba:string,bb:struct<bba:boolean>>, c array<boolean>")
VALUE = {"a": {"aa": "x", "ab": 1}, "b": {"ba": "y", "bb": {"bba": True}}, "c": [True]}


def text(s: T.StructType) -> str:
    return s.simpleString()


def test_follow_and_select():
    assert X.follow_path(DEEP, "") == DEEP
    assert text(X.follow_path(DEEP, "b.bb")) == text(DEEP["b"].dataType)
    assert X.follow_path(DEEP, "c") == DEEP
    assert X.select_field(DEEP, "b.bb.bba").simpleString() == "bba:boolean"
    assert X.select_field(DEEP, "a.aa", "n").simpleString() == "n:string"
    assert text(X.select_many(DEEP, ["a.ab", (("b", "ba"), "n"), "c"])) == "struct<ab:int,n:string,c:array<boolean>>"
    for bad in ("x", "a.x", "c.x", "a.aa.x"):
        with pytest.raises(SchemaError):
            X.select_field(DEEP, bad)
    for bad in ([], [""]):
        with pytest.raises(SchemaError):
            X.select_many(DEEP, bad)
    with pytest.raises(SchemaError):
        X.select_field(FLAT, "")
    assert decompose("a.b.c") == (("a", "b"), "c")


def test_add_remove_replace():
    assert text(X.add_field(FLAT, "", "n", T.LongType())) == "struct<_a:int,_b:string,n:bigint>"
    assert text(X.add_field(DEEP, "b.bb", "n", T.LongType())["b"].dataType) == "struct<ba:string,bb:struct<bba:boolean,n:bigint>>"
    assert X.add_many(FLAT, [("", "x", T.LongType()), ("", "y", T.LongType())]).fieldNames() == ["_a", "_b", "x", "y"]
    assert text(X.remove_field(DEEP, "b.bb.bba")["b"].dataType) == "struct<ba:string,bb:struct<>>"
    assert text(X.replace_field(DEEP, "a.aa", "n", T.DoubleType())["a"].dataType) == "struct<n:double,ab:int>"
    assert text(X.replace_field(FLAT, "_a", "n")) == "struct<n:int,_b:string>"
    for bad in (lambda: X.add_field(FLAT, "", "_a", T.LongType()), lambda: X.add_field(FLAT, "_a", "n", T.LongType()), lambda: X.remove_field(FLAT, "n"), lambda: X.replace_field(FLAT, "n", "m"), lambda: X.replace_field(FLAT, "_a", "_b")):
        with pytest.raises(SchemaError):
            bad()


def test_merge():
    assert text(X.merge(FLAT, DEEP, "", "a")) == "struct<_a:int,_b:string,aa:string,ab:int>"
    assert X.merge(FLAT, FLAT).fieldNames() == ["_a", "_b", "_a", "_b"]
    assert text(X.merge_in_left(DEEP, FLAT, "a", "")["a"].dataType) == "struct<aa:string,ab:int,_a:int,_b:string>"
    assert text(X.merge_in_right(FLAT, DEEP, "", "b.bb")["b"].dataType) == "struct<ba:string,bb:struct<bba:boolean,_a:int,_b:string>>"
    with pytest.raises(SchemaError):
        X.field_of(X.merge(FLAT, FLAT), "_a")


def test_text():
    assert X.as_string(T.StructType([])) == ""
    assert X.as_string(DEEP) == "- a:\n  - aa: String\n  - ab: Int\n- b:\n  - ba: String\n  - bb:\n    - bba: Boolean\n- c: List[Boolean]\n"


def test_dataclasses():
    @dataclass
    class Inner:
        x: float

    @dataclass
    class Outer:
        name: str
        inner: Inner
        many: list[int]

    globals().update(Inner=Inner)
    assert text(X.struct_of(Outer)) == "struct<name:string,inner:struct<x:double>,many:array<bigint>>"
    with pytest.raises(SchemaError):
        X.type_of(object)


def test_values_follow_schemas():
    assert R.follow(VALUE, "b.bb") == VALUE["b"]
    assert R.select(VALUE, ["a.ab", {"b.ba": "n"}]) == {"ab": 1, "n": "y"}
    assert R.add(VALUE, "b.bb", "n", 5)["b"]["bb"] == {"bba": True, "n": 5}
    assert R.remove(VALUE, "a.aa")["a"] == {"ab": 1}
    assert list(R.replace(VALUE, "a.aa", "n", 2.0)["a"].items()) == [("n", 2.0), ("ab", 1)]
    assert R.merge({"x": 1}, VALUE, "", "a") == {"x": 1, "aa": "x", "ab": 1}
    assert R.merge_in_left(VALUE, {"x": 1}, "a")["a"] == {"aa": "x", "ab": 1, "x": 1}
    assert list(R.merge_in_right({"x": 1}, VALUE, "", "a")["a"]) == ["aa", "ab", "x"]
    with pytest.raises(SchemaError):
        R.remove(VALUE, "a.x")
