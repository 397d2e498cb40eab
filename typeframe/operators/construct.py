"""Model migration, and graphs built by aggregating interactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from typeframe.functions.expressions import Path, col
from typeframe.plans import schema_ops
from typeframe.plans.errors import SchemaError
from typeframe.plans.models import Graph, Model
from typeframe.plans.paths import decompose

from .data import Data


def migrate(data: Data, model: Model, *attributes: object) -> Data:
    """The rows under another model, whole or only the given attributes."""
    return data.select(*attributes, model=model) if attributes else data.as_model(model)


def build_graph(data: Data, source: object, dest: object, *, source_attributes: tuple = (), dest_attributes: tuple = (), edge_attributes: tuple = ()) -> Data:
    """One edge per pair of labels, weighted by how many rows have the pair.

    Further attributes of the ends and the edge widen the key.  Null labels
    form a group like any other.  The count combines before it shuffles, so a
    hot pair costs one row a task.
    """
    sides = {"source": [source, *source_attributes], "dest": [dest, *dest_attributes], "edge": list(edge_attributes)}
    keys, records = [], {}
    for side, paths in sides.items():
        fields = schema_ops.select_many(data.schema, [col(p) for p in paths]).fields if paths else []
        names = [f.name for f in fields] + ["weight"] * (side == "edge")
        if len(set(names)) < len(names):
            raise SchemaError(f"{side} has an attribute twice: {', '.join(names)}")
        keys += [col(p).column().alias(f"{side}.{f.name}") for p, f in zip(paths, fields, strict=True)]
        records[side] = [F.col(f"`{side}.{f.name}`").alias(f.name) for f in fields]
    counted = data.to_df().groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("weight"))
    edges = counted.select(*(F.struct(*(["weight"] if side == "edge" else []), *columns).alias(side) for side, columns in records.items()))
    return Data(edges, Graph(_last(source), _last(dest), "weight"))


def _last(path: object) -> str:
    p = path if isinstance(path, Path) else col(path)
    return p.new or decompose(p)[1]
