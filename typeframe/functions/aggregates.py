"""Aggregates: their input rule, their result type and their column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeframe.plans.errors import SchemaError

from .expressions import NUMERIC, Expression, Path, col


def _sum_type(kind: T.DataType) -> T.DataType:
    return T.DoubleType() if isinstance(kind, (T.DoubleType, T.FloatType)) else T.LongType()


#: Name: whether it needs numbers, the type Spark gives, and the function.
AGGREGATES: dict[str, tuple[bool, Callable[[T.DataType], T.DataType], Callable]] = {
    "count": (False, lambda _: T.LongType(), F.count),
    "max": (False, lambda k: k, F.max),
    "min": (False, lambda k: k, F.min),
    "avg": (True, lambda _: T.DoubleType(), F.avg),
    "median": (True, lambda _: T.DoubleType(), F.median),
    "sum": (True, _sum_type, F.sum),
    "product": (True, lambda _: T.DoubleType(), F.product),
}


class Aggregate(Expression):
    """An aggregate of one attribute, named after its operation unless renamed."""

    def __init__(self, op: str, path: Path, new: str | None = None) -> None:
        self.op, self.path, self.name = op, path, new or op

    def alias(self, new: str) -> Aggregate:
        return Aggregate(self.op, self.path, new)

    def check(self, left, right):
        needs_number, result, _ = AGGREGATES[self.op]
        kind = self.path.check(left, right)
        if needs_number and not isinstance(kind, NUMERIC):
            raise SchemaError(f"{self.op} of {self.path!r}: {kind.simpleString()} is not numeric")
        return result(kind)

    def column(self, left="", right=""):
        return AGGREGATES[self.op][2](self.path.column(left, right)).alias(self.name)


def _named(op: str) -> Callable[[object], Aggregate]:
    def build(path: object) -> Aggregate:
        return Aggregate(op, col(path))

    build.__name__ = op
    build.__doc__ = f"The {op} of an attribute's values that are not null."
    return build


count, max_, min_, avg, median, sum_, product = map(_named, AGGREGATES)
