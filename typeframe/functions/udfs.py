"""Python functions over attributes, checked by their annotations.

Prefer expressions: a function is opaque to the optimiser, and over ``"*"`` it
reads every column.  Rows travel in Arrow batches.
"""

from __future__ import annotations

import inspect
import typing
from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeframe.plans import schema_ops
from typeframe.plans.errors import SchemaError

from .expressions import Expression, Path, col

MAX_ARITY = 10


class Function(Expression):
    def __init__(self, f: Callable, paths: list[Path] | None, returns: T.DataType | None = None) -> None:
        self.f, self.paths = f, paths
        self.hints = typing.get_type_hints(f)
        self.parameters = [p.name for p in inspect.signature(f).parameters.values()]
        self.returns = returns
        if not 1 <= len(self.parameters) <= MAX_ARITY:
            raise SchemaError(f"a function takes 1 to {MAX_ARITY} attributes, not {len(self.parameters)}")
        if missing := [n for n in [*self.parameters, *([] if returns else ["return"])] if n not in self.hints]:
            raise SchemaError(f"no annotation for {', '.join(missing)}")

    def over(self, schema: T.StructType) -> list[Path]:
        return [Path((n,)) for n in schema.fieldNames()] if self.paths is None else self.paths

    def check(self, left, right):
        paths = self.over(left)
        if len(paths) != len(self.parameters):
            raise SchemaError(f"the function takes {len(self.parameters)} attributes, {len(paths)} are given")
        for path, name in zip(paths, self.parameters, strict=True):
            kind, wanted = path.check(left, right), schema_ops.type_of(self.hints[name])
            if not (kind == wanted or (wanted == T.LongType() and isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)))):
                raise SchemaError(f"{path!r} is {schema_ops.type_name(kind)}, the function takes {schema_ops.type_name(wanted)}")
        # An int annotation is Long, whatever the attributes are; ``returns`` narrows it.
        return self.returns or schema_ops.type_of(self.hints["return"])

    def column_for(self, schema: T.StructType):
        return F.udf(self.f, self.check(schema, schema), useArrow=True)(*(p.column() for p in self.over(schema)))


def func(f: Callable, *paths: object, returns: T.DataType | None = None) -> Function:
    """``f`` over the given attributes, or over all top-level ones for ``"*"``.

    The result has the annotated type (int is Long), or ``returns``.
    """
    return Function(f, None if paths == ("*",) else [col(p) for p in paths], returns)


def register(spark, name: str, f: Callable, *, returns: T.DataType | None = None):
    """Register an annotated function for SQL text under ``name``."""
    result = returns or schema_ops.type_of(typing.get_type_hints(f)["return"])
    return spark.udf.register(name, F.udf(f, result, useArrow=True))
