"""Data models and their conformance rules, which see a ``StructType`` only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import ModelError

SCALARS = (T.StringType, T.IntegerType, T.DoubleType, T.LongType, T.BooleanType)


class Model:
    """A named rule about schemas."""

    name = "Model"

    def validate(self, schema: T.StructType) -> None:
        raise NotImplementedError

    def conforms(self, schema: T.StructType) -> bool:
        try:
            self.validate(schema)
        except ModelError:
            return False
        return True

    def renamed(self, path: tuple[str, ...], new: str) -> Model:
        """The model after a rename of the attribute at ``path``."""
        return self

    def _reject(self, what: str) -> None:
        raise ModelError(f"{self.name}: {what}")

    def __repr__(self) -> str:
        return self.name


class _Relation(Model):
    """Flat, at least one attribute, scalars and dates."""

    name = "Relation"

    def validate(self, schema: T.StructType) -> None:
        if not schema.fields:
            self._reject("a relation has at least one attribute")
        for f in schema.fields:
            if not isinstance(f.dataType, (*SCALARS, T.DateType)):
                self._reject(f"attribute {f.name} has type {f.dataType.simpleString()}")


class _JSON(Model):
    """Nested and multivalued, possibly empty, without dates."""

    name = "JSON"

    def validate(self, schema: T.StructType) -> None:
        for f in schema.fields:
            self._value(f.name, f.dataType)

    def _value(self, name: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            self.validate(kind)
        elif isinstance(kind, T.ArrayType):
            self._value(name, kind.elementType)
        elif not isinstance(kind, SCALARS):
            self._reject(f"attribute {name} has type {kind.simpleString()}")


@dataclass(frozen=True, repr=False)
class Graph(Model):
    """An edge list: records source, dest and edge, each with an id attribute."""

    source_id: str
    dest_id: str
    edge_id: str

    name = "Graph"
    RECORDS = ("source", "dest", "edge")

    def validate(self, schema: T.StructType) -> None:
        if tuple(schema.fieldNames()) != self.RECORDS:
            self._reject(f"top-level records are {', '.join(self.RECORDS)}, not {', '.join(schema.fieldNames())}")
        for f, key in zip(schema.fields, (self.source_id, self.dest_id, self.edge_id), strict=True):
            if not isinstance(f.dataType, T.StructType) or not f.dataType.fields:
                self._reject(f"{f.name} is not a record with attributes")
            if key not in f.dataType.fieldNames():
                self._reject(f"{f.name} has no id attribute {key}")
            for x in f.dataType.fields:
                self._value(f"{f.name}.{x.name}", x.dataType)

    def _value(self, name: str, kind: T.DataType) -> None:
        if isinstance(kind, T.ArrayType):
            self._value(name, kind.elementType)
        elif not isinstance(kind, SCALARS):
            self._reject(f"attribute {name} has type {kind.simpleString()}")

    def renamed(self, path: tuple[str, ...], new: str) -> Graph:
        ids = dict(zip(self.RECORDS, (self.source_id, self.dest_id, self.edge_id), strict=True))
        if len(path) == 2 and ids.get(path[0]) == path[1]:
            ids[path[0]] = new
        return Graph(*ids.values())


Relation = _Relation()
JSON = _JSON()


def as_model(model: object) -> Model:
    """A usable model; a graph without its ids is not one."""
    if isinstance(model, Model):
        return model
    raise ModelError(f"{model!r} is not a model; a graph needs the names of its three ids")
