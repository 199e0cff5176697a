"""Naming a value inside a column expression, so that it is evaluated once and the expression stays small."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once a row."""
    return F.get(F.transform(F.array(value), body), 0)


def numbers(values: list[int]) -> Column:
    """An array of whole numbers as one literal, made in one call."""
    return F.expr(f"array({', '.join(map(str, values))})")
