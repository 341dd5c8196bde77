"""Literal maps and lists as one parsed expression, however many entries they have."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value)


@lru_cache(maxsize=256)
def _map_text(items: tuple) -> str:
    return "map(" + ", ".join(_sql(x) for pair in items for x in pair) + ")"


def map_literal(mapping: dict) -> Column:
    return F.expr(_map_text(tuple(mapping.items())))


def list_literal(values) -> Column:
    return F.expr("array(" + ", ".join(_sql(v) for v in values) + ")")
