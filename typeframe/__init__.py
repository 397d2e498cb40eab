"""A PySpark engine whose datasets carry a data model checked at plan time."""

from .functions import avg, col, count, func, lit, max_, median, min_, product, sum_
from .operators.construct import build_graph, migrate
from .operators.data import Data, timed
from .plans.errors import ModelError, PlanError, SchemaError
from .plans.models import JSON, Graph, Relation

__all__ = [
    "JSON", "Data", "Graph", "ModelError", "PlanError", "Relation", "SchemaError", "avg", "build_graph", "col", "count", "func",
    "lit", "max_", "median", "migrate", "min_", "product", "sum_", "timed",
]
