"""Small helpers for long column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def constant_doubles(values: list[float]) -> Column:
    """An array of doubles that is a single literal in the optimised plan."""
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast("array<double>")
