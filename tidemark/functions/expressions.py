"""Column helpers used by several operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once and written once into the plan."""
    return F.transform(F.array(value), body)[0]


def literal_map(entries: dict) -> Column:
    """A constant map; values are scalars or equally typed sequences."""
    parts = []
    for key, value in entries.items():
        parts += [F.lit(key), F.array(*map(F.lit, value)) if isinstance(value, (tuple, list)) else F.lit(value)]
    return F.create_map(*parts)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)
