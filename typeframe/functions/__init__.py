"""Typed expressions: paths, predicates, arithmetic, aggregates, sort keys and functions."""

from .expressions import Path, col, lit
from .aggregates import avg, count, max_, median, min_, product, sum_
from .udfs import func, register

__all__ = ["Path", "avg", "col", "count", "func", "lit", "max_", "median", "min_", "product", "register", "sum_"]
