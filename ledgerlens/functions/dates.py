"""Calendar expressions: month start, month shift, month index, day caps."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(col: Column | str) -> Column:
    """First day of the month, kept as DATE (``date_trunc`` would give a timestamp)."""
    return F.trunc(F.col(col) if isinstance(col, str) else col, "MM")


def shift_month_start(col: Column | str, months: int | Column) -> Column:
    return F.add_months(month_start(col), months)


def month_index(col: Column | str) -> Column:
    """Months since year 0: ``year * 12 + month - 1``; differences give month offsets."""
    c = F.col(col) if isinstance(col, str) else col
    return F.year(c) * 12 + F.month(c) - 1


def day_of_month(col: Column | str) -> Column:
    return F.dayofmonth(F.col(col) if isinstance(col, str) else col)


def py_month_start(value: dt.date) -> dt.date:
    return value.replace(day=1)


def py_shift_month_start(value: dt.date, months: int) -> dt.date:
    """First day of the month ``months`` after (or before) the date's month."""
    return (pd.Period(value, freq="M") + months).start_time.date()


def as_date(value: str | dt.date | dt.datetime) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value)[:10])
