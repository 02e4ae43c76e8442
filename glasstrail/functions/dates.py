"""Date arithmetic for windows and labels. All days are UTC."""
from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F


def epoch_seconds(day: Column) -> Column:
    return F.unix_date(day).cast("bigint") * 86400


def day_window(first: Column, last: Column) -> Column:
    """Half-open ``struct<start_s, end_s>`` of whole days."""
    return F.struct(epoch_seconds(first).alias("start_s"), (epoch_seconds(last) + 86400).alias("end_s"))


def week_start(day: Column) -> Column:
    """Monday of the week."""
    return F.date_sub(day, F.weekday(day))


def month_bounds(day: Column) -> tuple[Column, Column]:
    return F.trunc(day, "month"), F.last_day(day)


def year_bounds(day: Column) -> tuple[Column, Column]:
    return F.trunc(day, "year"), F.date_sub(F.add_months(F.trunc(day, "year"), 12), 1)


def day_label(day: Column, today: date) -> Column:
    t = F.lit(today)
    return F.when(day == t, "Today").when(day == F.date_sub(t, 1), "Yesterday").otherwise(F.date_format(day, "d MMM yyyy"))
