"""``Data``: a DataFrame tagged with a model, checked when its plan is built.

Every operator derives its output schema from the input's before it touches
Spark, and leaves execution to one declarative plan.  Operators that can leave
the model give a ``Pending`` result, to be kept or changed.
"""

from __future__ import annotations

import contextlib
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeframe.functions.aggregates import Aggregate
from typeframe.functions.expressions import Expression, Literal, Order, Path, Predicate, col, operand
from typeframe.functions.udfs import Function
from typeframe.plans import schema_ops
from typeframe.plans.errors import ModelError, SchemaError
from typeframe.plans.models import Model, as_model
from typeframe.plans.paths import decompose, parts, quoted

#: Fixed spellings of join modes.
MODES = ("inner", "cross", "outer", "full", "fullouter", "full_outer", "left", "leftouter", "left_outer", "right", "rightouter", "right_outer")
#: Joins that only filter the left side.
FILTER_MODES = ("semi", "leftsemi", "left_semi", "anti", "leftanti", "left_anti")


class Data:
    """A dataset whose schema conforms to its model."""

    def __init__(self, df: DataFrame, model: Model) -> None:
        self.model = as_model(model)
        self.schema: T.StructType = df.schema
        self.model.validate(self.schema)
        self._df = df

    # Entry and exit

    @classmethod
    def of(cls, spark: SparkSession, rows: list, model: Model, record: object) -> Data:
        """Build from rows and their record type, a dataclass or a schema."""
        schema = record if isinstance(record, T.StructType) else schema_ops.struct_of(record)
        as_model(model).validate(schema)
        return cls(spark.createDataFrame([_as_row(r) for r in rows], schema), model)

    def as_model(self, model: Model) -> Data:
        """The same rows under another model."""
        return Data(self._df, model)

    def to_df(self) -> DataFrame:
        return self._df

    def to_df_as(self, record: object) -> DataFrame:
        """The rows, if their schema is exactly the given record type."""
        wanted = record if isinstance(record, T.StructType) else schema_ops.struct_of(record)
        if _plain(wanted) != _plain(self.schema):
            raise SchemaError(f"the schema is not {wanted.simpleString()} but {self.schema.simpleString()}")
        return self._df

    # Inspection

    def show(self, n: int = 20, truncate: bool | int = True, vertical: bool = False) -> None:
        self._df.show(n, truncate, vertical)

    def describe(self, name: str = "Dataset", show_data: bool = False) -> None:
        """Print a banner, the model, the schema and on demand some rows."""
        print(f"==== {name} ====\nModel: {self.model.name}\nSchema:\n{schema_ops.as_string(self.schema)}", end="")
        if show_data:
            self._df.show()

    def print_dataset(self, name: str = "Dataset") -> None:
        """Print a banner, and the rows if there are fewer than ten."""
        # Ten rows at most reach the driver: enough to know that there are fewer.
        rows = self._df.limit(10).collect()
        print(f"==== {name} ({self.model.name}) ====\n{schema_ops.as_string(self.schema)}", end="")
        if len(rows) < 10:
            print(*rows, sep="\n")

    def count(self) -> int:
        return self._df.count()

    # Projection and filters

    def select(self, *paths: object, model: Model | None = None) -> Data:
        """Attributes under their last or a new name, flat and in order."""
        chosen = [col(p) for p in paths]
        schema = schema_ops.select_many(self.schema, chosen)
        (model or self.model).validate(schema)
        return Data(self._df.select(*(p.column().alias(f.name) for p, f in zip(chosen, schema.fields, strict=True))), model or self.model)

    def select_all(self) -> list[str]:
        """The names of the top-level attributes."""
        return self.schema.fieldNames()

    def filter(self, condition: Predicate | Function) -> Data:
        """Rows for which a predicate, or a Boolean function of attributes, holds."""
        kind = _checked(condition, self.schema)
        if kind != T.BooleanType():
            raise SchemaError(f"a filter is Boolean, not {kind.simpleString()}")
        return Data(self._df.filter(_column(condition, self.schema)), self.model)

    # Change of attributes

    def add(self, path: object, value: object) -> Pending:
        """Append an attribute: a constant, an attribute, arithmetic or a function."""
        init, last = decompose(path)
        value = value if isinstance(value, Expression) else operand(value)
        schema_ops.add_field(self.schema, init, last, _checked(value, self.schema))
        c = _column(value, self.schema)
        df = self._df.withColumn(init[0], F.col(quoted(init[:1])).withField(quoted((*init[1:], last)), c)) if init else self._df.withColumn(last, c)
        return Pending(df, self.model)

    def drop(self, path: object) -> Data:
        """Remove an attribute at any depth; what is left conforms to the model."""
        names = parts(path)
        self.model.validate(schema_ops.remove_field(self.schema, names))
        if len(names) == 1:
            return Data(self._df.drop(F.col(quoted(names))), self.model)
        return Data(self._df.withColumn(names[0], F.col(quoted(names[:1])).dropFields(quoted(names[1:]))), self.model)

    def update(self, path: object, value: Expression | object, new: str | None = None) -> Pending:
        """Replace an attribute in its place, perhaps under a new name and type."""
        names = parts(path)
        value = value if isinstance(value, Expression) else operand(value)
        schema_ops.replace_field(self.schema, names, new, _checked(value, self.schema))
        c = _column(value, self.schema)
        if len(names) == 1:
            return Pending(self._df.withColumn(names[0], c).withColumnRenamed(names[0], new or names[0]), self.model)
        changed = self._df.withColumn(names[0], F.col(quoted(names[:1])).withField(quoted(names[1:]), c))
        return Pending(_renamed(changed, names, new) if new else changed, self.model.renamed(names, new) if new else self.model)

    def rename(self, path: object, new: str) -> Data:
        """Rename an attribute at any depth; a graph's ids follow."""
        names = parts(path)
        model = self.model.renamed(names, new)
        model.validate(schema_ops.replace_field(self.schema, names, new))
        return Data(_renamed(self._df, names, new), model)

    # Several rows at once

    def join(self, other: Data, on: Predicate, mode: str = "inner", *, right_prefix: str | None = None) -> JoinPending | Data:
        """Join by predicates whose left side is here and right side there.

        All attributes of both sides stay, repeated names included; with
        ``right_prefix`` a right attribute whose name the left has gets that
        prefix, so that both can be named.  Semi and anti joins filter this side.
        """
        if mode not in MODES + FILTER_MODES:
            raise SchemaError(f"unknown join mode {mode}; there are {', '.join(MODES + FILTER_MODES)}")
        _only_attributes(on)
        on.check(self.schema, other.schema)
        left, right = self._df.alias("_left"), other._df.alias("_right")
        df = left.join(right, on.column("_left.", "_right."), mode)
        if mode in FILTER_MODES:
            return Data(df, self.model)
        if right_prefix is not None:
            left_names, right_names = self.schema.fieldNames(), other.schema.fieldNames()
            new = [right_prefix + n if n in left_names else n for n in right_names]
            if len({*left_names, *new}) < len(left_names) + len(new):
                raise SchemaError(f"the prefix {right_prefix} does not tell {', '.join(new)} from {', '.join(left_names)}")
            df = df.toDF(*left_names, *new)
        return JoinPending(df, self.model, other.model)

    def group_by(self, *paths: object) -> Grouped:
        keys = [col(p) for p in paths]
        schema_ops.select_many(self.schema, keys)
        return Grouped(self, keys)

    def order_by(self, *keys: object) -> Data:
        """Sort by keys; ascending puts nulls first, descending last."""
        orders = [k if isinstance(k, Order) else col(k).asc() for k in keys]
        for o in orders:
            o.check(self.schema, self.schema)
        return Data(self._df.orderBy(*(o.column() for o in orders)), self.model)

    def union(self, other: Data) -> Data:
        """All rows of both; their schemas must be equal."""
        if _plain(self.schema) != _plain(other.schema):
            raise SchemaError(f"union of {self.schema.simpleString()} and {other.schema.simpleString()}")
        return Data(self._df.union(other._df), self.model)

    def distinct(self) -> Data:
        return Data(self._df.distinct(), self.model)


class Pending:
    """A result whose model is still to be kept or changed."""

    def __init__(self, df: DataFrame, model: Model) -> None:
        self._df, self._model = df, model
        self.schema: T.StructType = df.schema

    def keep_model(self) -> Data:
        return Data(self._df, self._model)

    def change_model(self, model: Model) -> Data:
        return Data(self._df, model)


class JoinPending:
    """A join's result, which keeps either side's model or takes a new one."""

    def __init__(self, df: DataFrame, left: Model, right: Model) -> None:
        self._df, self._left, self._right = df, left, right
        self.schema: T.StructType = df.schema

    def keep_left_model(self) -> Data:
        return Data(self._df, self._left)

    def keep_right_model(self) -> Data:
        return Data(self._df, self._right)

    def change_model(self, model: Model) -> Data:
        return Data(self._df, model)


class Grouped:
    """Rows grouped by attributes."""

    def __init__(self, data: Data, keys: list[Path]) -> None:
        self._data, self._keys = data, keys

    def agg(self, *aggregates: Aggregate) -> Pending:
        """The keys, then one attribute per aggregate, in the order given."""
        schema = self._data.schema
        for a in aggregates:
            a.check(schema, schema)
        keys = schema_ops.select_many(schema, self._keys).fieldNames()
        names = [*keys, *(a.name for a in aggregates)]
        if not aggregates or len(set(names)) < len(names):
            raise SchemaError(f"results need one name each, not {', '.join(names)}; give an alias")
        grouped = self._data.to_df().groupBy(*(k.column().alias(n) for k, n in zip(self._keys, keys, strict=True)))
        return Pending(grouped.agg(*(a.column() for a in aggregates)), self._data.model)


def _checked(value: Expression, schema: T.StructType) -> T.DataType:
    return value.check(schema, schema)


def _column(value: Expression, schema: T.StructType):
    return value.column_for(schema) if isinstance(value, Function) else value.column()


def _only_attributes(on: Predicate) -> None:
    """Join conditions compare attributes with attributes."""
    for p in getattr(on, "items", [on]):
        if hasattr(p, "items"):
            _only_attributes(p)
        elif not getattr(p, "attributes_only", lambda: False)():
            raise SchemaError("a join compares an attribute of the left with one of the right")


def _renamed(df: DataFrame, names: tuple[str, ...], new: str) -> DataFrame:
    if len(names) == 1:
        return df.withColumnRenamed(names[0], new)

    def rebuilt(c, record: T.StructType, path: tuple[str, ...]):
        inner = {f.name: rebuilt(c.getField(f.name), f.dataType, path[1:]) if f.name == path[0] and len(path) > 1 else c.getField(f.name) for f in record.fields}
        fields = [v.alias(new if len(path) == 1 and n == path[0] else n) for n, v in inner.items()]
        return F.when(c.isNotNull(), F.struct(*fields))

    return df.withColumn(names[0], rebuilt(F.col(quoted(names[:1])), df.schema[names[0]].dataType, names[1:]))


def _plain(kind: T.DataType):
    """A type without nullability, which models do not know."""
    if isinstance(kind, T.StructType):
        return tuple((f.name, _plain(f.dataType)) for f in kind.fields)
    return ("list", _plain(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def _as_row(value: object) -> object:
    if hasattr(value, "__dataclass_fields__"):
        return tuple(_as_row(getattr(value, n)) for n in value.__dataclass_fields__)
    return [_as_row(x) for x in value] if isinstance(value, list) else value


@contextlib.contextmanager
def timed(name: str = "elapsed") -> Iterator[None]:
    """Print the block's time in ns, ms and s."""
    began = time.perf_counter_ns()
    try:
        yield
    finally:
        ns = time.perf_counter_ns() - began
        print(f"{name}: {ns} ns, {ns / 1e6:.3f} ms, {ns / 1e9:.3f} s")


__all__ = ["Data", "Grouped", "JoinPending", "Literal", "ModelError", "Pending", "timed"]
