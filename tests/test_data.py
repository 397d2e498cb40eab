"""Every operator of ``Data`` on rows, and every refusal before a job starts."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeframe import JSON, Data, ModelError, Relation, SchemaError, avg, col, count, func, lit, max_, median, min_, product, sum_, timed
from typeframe.functions import register

from .helpers import schema


@pytest.fixture(scope="module")
def base(spark):
    return Data(spark.createDataFrame([("A", 1, True), ("B", 2, False), ("C", 3, True)], "att1 string, att2 int, att3 boolean"), Relation)


@pytest.fixture(scope="module")
def nested(spark):
    rows = [("A", 1, True, ("B", 2, False)), ("C", 3, True, ("D", 4, False)), ("E", 5, True, ("E", 6, False)), ("G", 7, None, None)]
    return Data(spark.createDataFrame(rows, "att4 string, att5 int, att6 boolean, att7 struct<att1:string,att2:int,att3:boolean>"), JSON)


@pytest.fixture(scope="module")
def other(base):
    d = base.drop("att3").add("test", col("att2") % 2).keep_model()
    return d.drop("att2").rename("att1", "truc")


def rows(d):
    return sorted(tuple(r) for r in d.to_df().collect())


def test_select(base, nested):
    assert rows(base.select(col("att1").alias("n"), "att2")) == [("A", 1), ("B", 2), ("C", 3)]
    d = nested.select(col("att7") >> "att2", col("att4").alias("k"), model=Relation)
    assert d.schema.fieldNames() == ["att2", "k"] and d.count() == 4


def test_filters(base, nested):
    assert rows(base.filter(col("att2") >= 2)) == [("B", 2, False), ("C", 3, True)]
    assert nested.filter(col("att4") == col("att7.att1")).count() == 1
    assert nested.filter(col("att7").is_null() | (col("att5") < 2)).count() == 2
    assert base.filter((col("att2") > 1) & ~(col("att3") == True) & col("att1").is_in("B", "C")).count() == 1  # noqa: E712
    assert base.filter(col("att2").between(2, 3) & col("att1").like("C%")).count() == 1

    def odd(x: int) -> bool:
        return x % 2 == 1

    def every(a: str, b: int, c: bool) -> bool:
        return a == "A" and b == 1 and c

    assert base.filter(func(odd, "att2")).count() == 2
    assert base.filter(func(every, "*")).count() == 1


def test_add(base, nested):
    assert rows(base.add("x", lit(2)).keep_model())[0] == ("A", 1, True, 2)
    assert base.add("x", [1.5, 2.5]).change_model(JSON).schema["x"].dataType == T.ArrayType(T.DoubleType(), False)
    assert [r[-1] for r in rows(base.add("x", col("att2") / 2).keep_model())] == [0.5, 1.0, 1.5]
    d = nested.add("att7.new", col("att5") * 2).keep_model()
    got = {r["att4"]: r["att7"] for r in d.to_df().collect()}
    assert got["A"]["new"] == 2 and got["G"] is None

    def label(a: str, b: int) -> str:
        return f"{a}{b}"

    assert rows(base.add("x", func(label, "att1", "att2")).keep_model())[2][-1] == "C3"


def test_change(base, nested):
    assert nested.drop("att7.att2").schema["att7"].dataType.fieldNames() == ["att1", "att3"]
    assert nested.rename("att7.att2", "n").schema["att7"].dataType.fieldNames() == ["att1", "n", "att3"]
    assert {r["att4"]: r["att7"] for r in nested.rename("att7.att2", "n").to_df().collect()}["G"] is None

    def text(x: int) -> str:
        return str(x)

    d = base.update("att2", func(text, "att2"), "t").keep_model()
    assert d.schema.fieldNames() == ["att1", "t", "att3"] and rows(d)[0] == ("A", "1", True)
    assert rows(base.update("att2", col("att2") + 1).keep_model())[0] == ("A", 2, True)


def test_join(base, other):
    d = base.join(other, col("att1") == col("truc")).keep_left_model()
    assert d.schema.fieldNames() == ["att1", "att2", "att3", "truc", "test"] and d.count() == 3
    assert base.join(other, (col("att2") == col("test")) | (col("att1") > col("truc")), "left").keep_right_model().count() == 5
    assert base.join(base, col("att2") < col("att2")).keep_left_model().count() == 3
    assert base.join(other, col("att2") == col("test"), "left_anti").count() == 2
    for mode in ("cross", "outer", "full", "fullouter", "full_outer", "leftouter", "left_outer", "right", "rightouter", "right_outer"):
        assert base.join(other, col("att1") == col("truc"), mode).change_model(JSON).count() == 3


def test_aggregates(base):
    d = base.group_by("att3").agg(count("att1"), max_("att2"), min_("att2"), avg("att2"), median("att2"), sum_("att2"), product("att2")).keep_model()
    assert d.schema.fieldNames() == ["att3", "count", "max", "min", "avg", "median", "sum", "product"]
    assert rows(d) == [(False, 1, 2, 2, 2.0, 2.0, 2, 2.0), (True, 2, 3, 1, 2.0, 2.0, 4, 3.0)]
    two = base.group_by("att3").agg(max_("att2").alias("a"), max_("att1").alias("b")).keep_model()
    assert rows(two) == [(False, 2, "B"), (True, 3, "C")]


def test_order(nested):
    got = [r[0] for r in nested.order_by(col("att6").asc(), col("att5").desc()).to_df().collect()]
    assert got == ["G", "E", "C", "A"]
    assert [r[0] for r in nested.order_by(col("att6").desc(), "att5").to_df().collect()] == ["A", "C", "E", "G"]


def test_entry_and_exit(spark, base, nested, capsys):
    assert base.as_model(JSON).model is JSON and base.to_df_as(base.schema).count() == 3
    assert Data.of(spark, [("a", 1)], Relation, schema("x string, y int")).count() == 1
    assert base.union(base).distinct().count() == 3 and base.select_all() == ["att1", "att2", "att3"]
    nested.describe("N", True)
    base.print_dataset("B")
    base.show(2, False, True)
    with timed("block"):
        pass
    out = capsys.readouterr().out
    assert "Model: JSON" in out and "  - att2: Int" in out and "att1='A'" in out and " ns, " in out


def _two(a: int, b: int) -> int:
    return a + b


def _text(a: str) -> bool:
    return bool(a)


def _plain(a):
    return a


REFUSED = {
    "unknown select": lambda b, n, o: b.select("nope"),
    "no select": lambda b, n, o: b.select(),
    "select leaves model": lambda b, n, o: n.select("att7", model=Relation),
    "types differ": lambda b, n, o: b.filter(col("att1") == col("att2")),
    "literal type": lambda b, n, o: b.filter(col("att1") == 2),
    "double to int": lambda b, n, o: b.filter(col("att2") == 2.0),
    "bool to int": lambda b, n, o: b.filter(col("att2") == True),  # noqa: E712
    "filter is no predicate": lambda b, n, o: b.filter(func(_two, "att2", "att2")),
    "function type": lambda b, n, o: b.filter(func(_text, "att2")),
    "function arity": lambda b, n, o: b.filter(func(_text, "att1", "att1")),
    "function bare": lambda b, n, o: b.filter(func(_plain, "att1")),
    "filter unknown": lambda b, n, o: b.filter(col("nope").is_null()),
    "like of int": lambda b, n, o: b.filter(col("att2").like("a")),
    "list in relation": lambda b, n, o: b.add("x", [1]).keep_model(),
    "mixed list": lambda b, n, o: b.add("x", [1, "a"]),
    "add not numeric": lambda b, n, o: b.add("x", col("att1") + col("att1")),
    "add unknown": lambda b, n, o: b.add("x", col("nope") + 1),
    "add taken": lambda b, n, o: b.add("att1", 1),
    "add under scalar": lambda b, n, o: b.add("att1.x", 1),
    "drop unknown": lambda b, n, o: b.drop("nope"),
    "drop everything": lambda b, n, o: b.select("att1").drop("att1"),
    "rename unknown": lambda b, n, o: b.rename("nope", "x"),
    "rename taken": lambda b, n, o: b.rename("att1", "att2"),
    "update unknown": lambda b, n, o: b.update("nope", 1),
    "update leaves model": lambda b, n, o: b.update("att1", [1]).keep_model(),
    "order unknown": lambda b, n, o: b.order_by("nope"),
    "join mode": lambda b, n, o: b.join(o, col("att1") == col("truc"), "sideways"),
    "join types": lambda b, n, o: b.join(o, col("att2") == col("truc")),
    "join sides": lambda b, n, o: b.join(o, col("truc") == col("att1")),
    "join literal": lambda b, n, o: b.join(o, col("att1") == "A"),
    "join model": lambda b, n, o: b.join(n, col("att1") == col("att4")).keep_left_model(),
    "ambiguous": lambda b, n, o: b.join(b, col("att1") == col("att1")).keep_left_model().select("att1"),
    "agg not numeric": lambda b, n, o: b.group_by("att3").agg(sum_("att1")),
    "median not numeric": lambda b, n, o: b.group_by("att3").agg(median("att1")),
    "agg unknown": lambda b, n, o: b.group_by("att3").agg(count("nope")),
    "agg twice": lambda b, n, o: b.group_by("att3").agg(max_("att1"), max_("att2")),
    "agg none": lambda b, n, o: b.group_by("att3").agg(),
    "group unknown": lambda b, n, o: b.group_by("nope"),
    "retag": lambda b, n, o: n.as_model(Relation),
    "union": lambda b, n, o: b.union(o),
    "to record": lambda b, n, o: b.to_df_as(T.StructType([])),
}


@pytest.mark.parametrize("case", REFUSED)
def test_refused_before_any_job(case, base, nested, other, no_jobs):
    with pytest.raises((SchemaError, ModelError)):
        REFUSED[case](base, nested, other)


def test_pushdown_and_pruning(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(F.col("id"), (F.col("id") * 2).alias("x"), F.lit("a").alias("y")).write.parquet(path)
    d = Data(spark.read.parquet(path), Relation).filter(col("x") > 10).select("id")
    plan = d.to_df()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,10)" in plan and "ReadSchema: struct<id:bigint,x:bigint>" in plan


def test_long_lists(base):
    names = [f"n{i}" for i in range(5000)]
    assert base.filter(col("att1").is_in(*names, "A")).count() == 1
    assert base.filter(col("att1").is_in("x", col("att1"))).count() == base.count()
    with pytest.raises(SchemaError):
        base.filter(col("att1").is_in("A", 1))
    with pytest.raises(SchemaError):
        base.filter(col("att1").is_in())


def test_int_functions_are_long(spark, base):
    def wide(name: str) -> int:
        return 2**40 + len(name)

    got = base.add("w", func(wide, "att1")).keep_model()
    assert got.schema["w"].dataType == T.LongType() and {r["w"] for r in got.to_df().collect()} == {2**40 + 1}
    assert base.add("w", func(lambda_of_int, "att2", returns=T.IntegerType())).schema["w"].dataType == T.IntegerType()
    register(spark, "test_wide", wide)
    assert spark.sql("SELECT test_wide('abc') AS w").first()["w"] == 2**40 + 3


def lambda_of_int(x: int) -> int:
    return x + 1


def test_prefixed_join(base):
    both = base.join(base, col("att1") == col("att1"), right_prefix="r_").keep_left_model()
    assert both.schema.fieldNames() == ["att1", "att2", "att3", "r_att1", "r_att2", "r_att3"]
    assert both.filter(col("att1") == col("r_att1")).count() == base.count()
    with pytest.raises(SchemaError):
        base.join(both, col("att1") == col("att1"), right_prefix="r_")


def test_prints(base, capsys):
    base.show(2, False)
    assert "|A   |1   |true |" in capsys.readouterr().out
    base.describe("B", show_data=True)
    out = capsys.readouterr().out
    assert "B" in out and "Relation" in out and "- att2: Int" in out and "only" not in out and "|   A|" in out
    base.print_dataset("few")
    assert "att1='A'" in capsys.readouterr().out
    many = base.union(base).union(base).union(base)
    many.print_dataset("many")
    out = capsys.readouterr().out
    assert "many" in out and "att1='A'" not in out
