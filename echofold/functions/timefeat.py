"""Features of a timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month(ts: Column) -> Column:
    return F.month(ts)


def hour(ts: Column) -> Column:
    return F.hour(ts)


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def time_of_day(ts: Column) -> Column:
    """A quarter of the day: night from 0, morning from 6, afternoon from 12, evening from 18 o'clock."""
    h = F.hour(ts)
    return F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").when(h < 24, "evening")


def time_features(ts: Column | str) -> list[Column]:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return [month(ts).alias("month"), hour(ts).alias("hour"), is_weekend(ts).alias("is_weekend"), time_of_day(ts).alias("time_of_day")]
