"""Expression trees that check themselves against schemas before they become columns."""

from __future__ import annotations

import datetime
import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeframe.plans import schema_ops
from typeframe.plans.errors import SchemaError
from typeframe.plans.paths import parts, quoted

#: Where a path is looked up: its schema, and the prefix of its columns.
Scope = tuple[T.StructType, str]

NUMERIC = (T.IntegerType, T.DoubleType, T.LongType, T.ShortType, T.FloatType)
#: Bits of the integer types.
INTEGRAL = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


class Expression:
    """A tree over the attributes of one scope, or of a left and a right one."""

    def check(self, left: T.StructType, right: T.StructType) -> T.DataType:
        raise NotImplementedError

    def column(self, left: str = "", right: str = "") -> Column:
        raise NotImplementedError


class Operand(Expression):
    """What arithmetic and comparisons take and give."""

    def __eq__(self, other):  # noqa: PLW3201
        return Compare("=", self, operand(other))

    def __ne__(self, other):
        return Compare("!=", self, operand(other))

    def __gt__(self, other):
        return Compare(">", self, operand(other))

    def __lt__(self, other):
        return Compare("<", self, operand(other))

    def __ge__(self, other):
        return Compare(">=", self, operand(other))

    def __le__(self, other):
        return Compare("<=", self, operand(other))

    def __mod__(self, other):
        return Arithmetic("%", self, operand(other))

    def __mul__(self, other):
        return Arithmetic("*", self, operand(other))

    def __add__(self, other):
        return Arithmetic("+", self, operand(other))

    def __sub__(self, other):
        return Arithmetic("-", self, operand(other))

    def __truediv__(self, other):
        return Arithmetic("/", self, operand(other))

    def __hash__(self) -> int:
        return id(self)

    def is_null(self):
        return NullTest(self, True)

    def is_not_null(self):
        return NullTest(self, False)

    def is_in(self, *values):
        return In(self, [operand(v) for v in values])

    def between(self, low, high):
        return Compare(">=", self, operand(low)) & Compare("<=", self, operand(high))

    def like(self, pattern: str):
        return Like(self, pattern)


class Path(Operand):
    """An attribute, nested by dots or by ``>>``, perhaps under a new name."""

    def __init__(self, names: object, new: str | None = None) -> None:
        self.names, self.new = parts(names), new

    def __rshift__(self, name: object) -> Path:
        return Path((*self.names, *parts(name)), getattr(name, "new", None))

    def alias(self, new: str) -> Path:
        return Path(self.names, new)

    def asc(self) -> Order:
        return Order(self, True)

    def desc(self) -> Order:
        return Order(self, False)

    def check(self, left, right):
        return schema_ops.select_field(left, self).dataType

    def column(self, left="", right=""):
        return F.col(f"{left}{quoted(self)}")

    def __repr__(self) -> str:
        return ".".join(self.names)


def col(path: object) -> Path:
    return path if isinstance(path, Path) else Path(path)


class Literal(Operand):
    """A constant, whose type fits itself to the attribute it meets."""

    def __init__(self, value: object) -> None:
        self.value = value

    def type(self, beside: T.DataType | None = None) -> T.DataType:
        v = self.value
        if isinstance(v, bool):
            return T.BooleanType()
        if isinstance(v, int):
            bits = INTEGRAL.get(type(beside))
            if bits and -(1 << bits - 1) <= v < 1 << bits - 1:
                return beside
            return T.IntegerType() if -(1 << 31) <= v < 1 << 31 else T.LongType()
        if isinstance(v, list):
            kinds = {Literal(x).type() for x in v}
            if len(kinds) != 1:
                raise SchemaError(f"a list constant has elements of one type: {v!r}")
            return T.ArrayType(kinds.pop())
        for kind, spark in ((str, T.StringType()), (float, T.DoubleType()), (datetime.datetime, T.TimestampType()), (datetime.date, T.DateType())):
            if isinstance(v, kind):
                return spark
        raise SchemaError(f"no type for the constant {v!r}")

    def check(self, left, right):
        return self.type()

    def column(self, left="", right=""):
        return F.array(*map(F.lit, self.value)) if isinstance(self.value, list) else F.lit(self.value)

    def __repr__(self) -> str:
        return repr(self.value)


def lit(value: object) -> Literal:
    return value if isinstance(value, Literal) else Literal(value)


def operand(value: object) -> Operand:
    """Expressions stay; everything else is a constant."""
    return value if isinstance(value, Operand) else lit(value)


def common_type(what: str, a: Operand, b: Operand, left: T.StructType, right: T.StructType) -> T.DataType:
    """The one type of two operands; Spark would coerce, this refuses."""
    if isinstance(a, Literal) and not isinstance(b, Literal):
        kind_b = b.check(right, right)
        kind_a = a.type(kind_b)
    else:
        kind_a = a.check(left, left)
        kind_b = b.type(kind_a) if isinstance(b, Literal) else b.check(right, right)
    if kind_a != kind_b:
        raise SchemaError(f"{a!r} {what} {b!r}: {kind_a.simpleString()} and {kind_b.simpleString()}")
    return kind_a


def combined(columns: list[Column], op: Callable) -> Column:
    """The columns under one operator, as a balanced tree: its depth grows with their number's logarithm."""
    while len(columns) > 1:
        columns = [op(*columns[i : i + 2]) if i + 1 < len(columns) else columns[i] for i in range(0, len(columns), 2)]
    return columns[0]


class Predicate(Expression):
    def __and__(self, other: Predicate) -> Predicate:
        return All_([self, other])

    def __or__(self, other: Predicate) -> Predicate:
        return Any_([self, other])

    def __invert__(self) -> Predicate:
        return Not(self)

    def __bool__(self) -> bool:
        raise SchemaError("combine predicates with &, | and ~")


#: Fixed operators of Spark columns.
COMPARISONS: dict[str, Callable] = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
ARITHMETIC: dict[str, Callable] = {"%": lambda a, b: a % b, "*": lambda a, b: a * b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "/": lambda a, b: a / b}


@dataclass(eq=False)
class Compare(Predicate):
    op: str
    a: Operand
    b: Operand

    def check(self, left, right):
        common_type(self.op, self.a, self.b, left, right)
        return T.BooleanType()

    def column(self, left="", right=""):
        return COMPARISONS[self.op](self.a.column(left, left), self.b.column(right, right))

    def attributes_only(self) -> bool:
        return isinstance(self.a, Path) and isinstance(self.b, Path)


@dataclass(eq=False)
class NullTest(Predicate):
    a: Operand
    null: bool

    def check(self, left, right):
        self.a.check(left, left)
        return T.BooleanType()

    def column(self, left="", right=""):
        c = self.a.column(left, left)
        return c.isNull() if self.null else c.isNotNull()


@dataclass(eq=False)
class In(Predicate):
    a: Operand
    values: list[Operand]

    def check(self, left, right):
        if not self.values:
            raise SchemaError(f"{self.a!r} is compared with no value")
        # A constant's type depends on its value, so each is checked; constants of one type are one membership test.
        for v in self.values:
            common_type("in", self.a, v, left, right)
        return T.BooleanType()

    def column(self, left="", right=""):
        a = self.a.column(left, left)
        constants = [v.value for v in self.values if isinstance(v, Literal) and not isinstance(v.value, list)]
        tests = [a.isin(constants)] if constants else []
        tests += [a == v.column(right, right) for v in self.values if not isinstance(v, Literal) or isinstance(v.value, list)]
        return combined(tests, operator.or_)


@dataclass(eq=False)
class Like(Predicate):
    a: Operand
    pattern: str

    def check(self, left, right):
        if self.a.check(left, left) != T.StringType():
            raise SchemaError(f"{self.a!r} is not a string")
        return T.BooleanType()

    def column(self, left="", right=""):
        return self.a.column(left, left).like(self.pattern)


class _Many(Predicate):
    def __init__(self, items: list[Predicate]) -> None:
        self.items = items
        if not items or not all(isinstance(p, Predicate) for p in items):
            raise SchemaError("predicates combine with predicates")

    def check(self, left, right):
        for p in self.items:
            p.check(left, right)
        return T.BooleanType()


class All_(_Many):
    def column(self, left="", right=""):
        return combined([p.column(left, right) for p in self.items], operator.and_)


class Any_(_Many):
    def column(self, left="", right=""):
        return combined([p.column(left, right) for p in self.items], operator.or_)


@dataclass(eq=False)
class Not(Predicate):
    p: Predicate

    def check(self, left, right):
        return self.p.check(left, right)

    def column(self, left="", right=""):
        return ~self.p.column(left, right)


class Arithmetic(Operand):
    def __init__(self, op: str, a: Operand, b: Operand) -> None:
        self.op, self.a, self.b = op, a, b

    def check(self, left, right):
        kind = common_type(self.op, self.a, self.b, left, right)
        if not isinstance(kind, NUMERIC):
            raise SchemaError(f"{self!r}: {kind.simpleString()} is not numeric")
        return T.DoubleType() if self.op == "/" else kind

    def column(self, left="", right=""):
        a, b = self.a.column(left, left), self.b.column(right, right)
        return ARITHMETIC[self.op](a, b)

    def __repr__(self) -> str:
        return f"{self.a!r} {self.op} {self.b!r}"


@dataclass(eq=False)
class Order(Expression):
    path: Path
    up: bool

    def check(self, left, right):
        return self.path.check(left, right)

    def column(self, left="", right=""):
        c = self.path.column(left, right)
        return c.asc() if self.up else c.desc()
