"""Null-safe arithmetic used by every delta/percentage column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """``n / d``, NULL when ``d`` is 0 or NULL (never an error under ANSI mode)."""
    return F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double"))


def delta(current: Column | str, previous: Column | str) -> Column:
    """``current - previous``; NULL when either side is NULL."""
    return _c(current) - _c(previous)


def pct_change(current: Column | str, previous: Column | str) -> Column:
    return safe_ratio(delta(current, previous), previous)


def sum_money(amount: Column | str, scale: int | None) -> Column:
    """Sum an amount column.

    ``scale=None`` sums doubles as they are. With a scale, every amount is
    first cast to ``DECIMAL(28, scale)`` so the sum is exact and does not
    depend on partitioning or task order; the result is cast back to double.
    Use :func:`money_value` to turn the sum into a double.
    """
    c = _c(amount)
    if scale is None:
        return F.sum(c.cast("double"))
    return F.sum(c.cast(f"decimal(28,{scale})"))


def money_value(col: Column | str) -> Column:
    return _c(col).cast("double")
