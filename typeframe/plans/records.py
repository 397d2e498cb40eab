"""The schema algebra on values: records are dicts, nested as their schema is."""

from __future__ import annotations

from collections.abc import Callable

from .errors import SchemaError
from .paths import decompose, parts


def value_at(record: dict, path: object) -> object:
    for name in parts(path):
        if not isinstance(record, dict) or name not in record:
            raise SchemaError(f"unknown attribute {name}")
        record = record[name]
    return record


def _changed(record: dict, path: tuple[str, ...], change: Callable[[dict], dict]) -> dict:
    if not path:
        return change(record)
    return {**record, path[0]: _changed(value_at(record, path[:1]), path[1:], change)}


def follow(record: dict, path: object) -> dict:
    value_at(record, path)
    return value_at(record, parts(path)[:-1])


def select(record: dict, paths: list) -> dict:
    """Last attributes of paths, flat; an item may be a dict from path to new name."""
    pairs = [next(iter(p.items())) if isinstance(p, dict) else (p, decompose(p)[1]) for p in paths]
    return {new: value_at(record, path) for path, new in pairs}


def add(record: dict, path: object, name: str, value: object) -> dict:
    return _changed(record, parts(path), lambda r: {**r, name: value})


def remove(record: dict, path: object) -> dict:
    init, last = decompose(path)
    value_at(record, path)
    return _changed(record, init, lambda r: {k: v for k, v in r.items() if k != last})


def replace(record: dict, path: object, new: str, value: object) -> dict:
    init, last = decompose(path)
    value_at(record, path)
    return _changed(record, init, lambda r: {new if k == last else k: value if k == last else v for k, v in r.items()})


def merge(left: dict, right: dict, left_path: object = (), right_path: object = ()) -> dict:
    return {**value_at(left, left_path), **value_at(right, right_path)}


def merge_in_left(left: dict, right: dict, left_path: object = (), right_path: object = ()) -> dict:
    return _changed(left, parts(left_path), lambda _: merge(left, right, left_path, right_path))


def merge_in_right(left: dict, right: dict, left_path: object = (), right_path: object = ()) -> dict:
    return _changed(right, parts(right_path), lambda _: merge(right, left, right_path, left_path))
