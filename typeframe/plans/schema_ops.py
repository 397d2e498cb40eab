"""Schema algebra: functions from ``StructType`` to ``StructType``.

A bare name is a path of one step and an empty path is the schema itself.
Unknown and ambiguous attributes raise ``SchemaError``.
"""

from __future__ import annotations

import dataclasses
import datetime
import typing
from collections.abc import Iterable

from pyspark.sql import types as T

from .errors import SchemaError
from .paths import decompose, parts


def field_of(schema: T.StructType, name: str) -> T.StructField:
    """The one attribute of that name."""
    found = [f for f in schema.fields if f.name == name]
    if len(found) != 1:
        raise SchemaError(f"{'unknown' if not found else 'ambiguous'} attribute {name}; there are {', '.join(schema.fieldNames()) or 'none'}")
    return found[0]


def record_at(schema: T.StructType, path: object) -> T.StructType:
    """The record that ``path`` names."""
    for name in parts(path):
        kind = field_of(schema, name).dataType
        if not isinstance(kind, T.StructType):
            raise SchemaError(f"{name} is not a record")
        schema = kind
    return schema


def follow_path(schema: T.StructType, path: object) -> T.StructType:
    """The record that contains the path's last attribute; the schema for an empty path."""
    if not parts(path):
        return schema
    init, last = decompose(path)
    found = record_at(schema, init)
    field_of(found, last)
    return found


def select_field(schema: T.StructType, path: object, new: str | None = None) -> T.StructField:
    """The path's last attribute, under its own or a new name."""
    init, last = decompose(path)
    found = field_of(record_at(schema, init), last)
    return T.StructField(new or found.name, found.dataType, found.nullable)


def select_many(schema: T.StructType, paths: Iterable[object]) -> T.StructType:
    """A flat record of the paths' last attributes, in order; an item may be (path, new name)."""
    fields = [select_field(schema, *(p if isinstance(p, tuple) and len(p) == 2 and not isinstance(p[0], str) else (p, getattr(p, "new", None)))) for p in paths]
    if not fields:
        raise SchemaError("nothing is selected")
    return T.StructType(fields)


def _rebuilt(schema: T.StructType, path: tuple[str, ...], change: typing.Callable[[T.StructType], T.StructType]) -> T.StructType:
    if not path:
        return change(schema)
    own = field_of(schema, path[0])
    if not isinstance(own.dataType, T.StructType):
        raise SchemaError(f"{path[0]} is not a record")
    inner = _rebuilt(own.dataType, path[1:], change)
    return T.StructType([T.StructField(f.name, inner, f.nullable) if f is own else f for f in schema.fields])


def add_field(schema: T.StructType, path: object, name: str, kind: T.DataType) -> T.StructType:
    """Append an attribute to the record at ``path``; a name that is taken is refused."""

    def change(record: T.StructType) -> T.StructType:
        if name in record.fieldNames():
            raise SchemaError(f"attribute {name} exists; update it instead")
        return T.StructType([*record.fields, T.StructField(name, kind)])

    return _rebuilt(schema, parts(path), change)


def add_many(schema: T.StructType, added: Iterable[tuple[object, str, T.DataType]]) -> T.StructType:
    """Append several attributes, in the order given."""
    for path, name, kind in added:
        schema = add_field(schema, path, name, kind)
    return schema


def remove_field(schema: T.StructType, path: object) -> T.StructType:
    init, last = decompose(path)

    def change(record: T.StructType) -> T.StructType:
        gone = field_of(record, last)
        return T.StructType([f for f in record.fields if f is not gone])

    return _rebuilt(schema, init, change)


def replace_field(schema: T.StructType, path: object, new: str | None = None, kind: T.DataType | None = None) -> T.StructType:
    """Rename and retype an attribute in its place."""
    init, last = decompose(path)

    def change(record: T.StructType) -> T.StructType:
        own = field_of(record, last)
        if new and new != last and new in record.fieldNames():
            raise SchemaError(f"attribute {new} exists")
        return T.StructType([T.StructField(new or f.name, kind or f.dataType, f.nullable) if f is own else f for f in record.fields])

    return _rebuilt(schema, init, change)


def merge(left: T.StructType, right: T.StructType, left_path: object = (), right_path: object = ()) -> T.StructType:
    """The left record's attributes, then the right one's; repeated names stay."""
    return T.StructType([*record_at(left, left_path).fields, *record_at(right, right_path).fields])


def merge_in_left(left: T.StructType, right: T.StructType, left_path: object = (), right_path: object = ()) -> T.StructType:
    """The merged record written back at its place in the left schema."""
    return _rebuilt(left, parts(left_path), lambda _: merge(left, right, left_path, right_path))


def merge_in_right(left: T.StructType, right: T.StructType, left_path: object = (), right_path: object = ()) -> T.StructType:
    """The right record's attributes first, written back at their place in the right schema."""
    return _rebuilt(right, parts(right_path), lambda _: merge(right, left, right_path, left_path))


# Fixed names of types in printed schemas.
TYPE_NAMES = {
    T.StringType: "String", T.IntegerType: "Int", T.DoubleType: "Double", T.LongType: "Long", T.BooleanType: "Boolean",
    T.DateType: "LocalDate", T.FloatType: "Float", T.ShortType: "Short", T.ByteType: "Byte",
}


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"List[{type_name(kind.elementType)}]"
    return TYPE_NAMES.get(type(kind), kind.simpleString())


def as_string(schema: T.StructType, depth: int = 0) -> str:
    """One line an attribute, records indented by two blanks a level."""
    lines = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            lines.append(f"{'  ' * depth}- {f.name}:\n{as_string(f.dataType, depth + 1)}")
        else:
            lines.append(f"{'  ' * depth}- {f.name}: {type_name(f.dataType)}\n")
    return "".join(lines)


# Fixed Spark types of Python types.
PYTHON_TYPES = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), datetime.date: T.DateType(), bytes: T.BinaryType(), datetime.datetime: T.TimestampType()}


def type_of(annotation: object) -> T.DataType:
    """The Spark type of a Python annotation; dataclasses become records, at any depth."""
    if isinstance(annotation, T.DataType):
        return annotation
    if dataclasses.is_dataclass(annotation):
        return struct_of(annotation)
    args = typing.get_args(annotation)
    if typing.get_origin(annotation) is list and len(args) == 1:
        return T.ArrayType(type_of(args[0]))
    if typing.get_origin(annotation) is dict and len(args) == 2:
        return T.MapType(type_of(args[0]), type_of(args[1]))
    optional = [a for a in args if a is not type(None)]
    if len(args) == 2 and len(optional) == 1:
        return type_of(optional[0])
    if annotation in PYTHON_TYPES:
        return PYTHON_TYPES[annotation]
    raise SchemaError(f"no Spark type for {annotation!r}")


def struct_of(record: type) -> T.StructType:
    """The nested record type of a dataclass."""
    hints = typing.get_type_hints(record)
    return T.StructType([T.StructField(f.name, type_of(hints[f.name])) for f in dataclasses.fields(record)])
