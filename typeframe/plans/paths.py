"""Paths to nested attributes."""

from __future__ import annotations

from collections.abc import Iterable

from .errors import SchemaError

PathLike = "str | tuple[str, ...] | Path"


def parts(path: object) -> tuple[str, ...]:
    """A path's names: dotted text, a tuple of names, or anything with ``names``."""
    names = getattr(path, "names", path)
    names = tuple(names.split(".")) if isinstance(names, str) and names else tuple(names or ())
    if not all(isinstance(n, str) and n for n in names):
        raise SchemaError(f"not a path: {path!r}")
    return names


def decompose(path: object) -> tuple[tuple[str, ...], str]:
    """The record that holds the attribute, and the attribute's own name."""
    names = parts(path)
    if not names:
        raise SchemaError("an empty path names no attribute")
    return names[:-1], names[-1]


def as_list(value: object) -> list:
    """One item or many, as a list."""
    return list(value) if isinstance(value, Iterable) and not isinstance(value, (str, tuple)) else [value]


def quoted(path: object) -> str:
    """The path as Spark resolves it, whatever characters its names have."""
    return ".".join(f"`{n.replace('`', '``')}`" for n in parts(path))
