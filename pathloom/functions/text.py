"""Small text and time functions of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"


def first_line(text: Column) -> Column:
    """Up to the first line end; null is empty."""
    return F.coalesce(F.substring_index(text, "\n", 1), F.lit(""))


def brief(error: Column) -> Column:
    """An error's first line without the request's URL."""
    return F.regexp_replace(first_line(error), " for url '[^']*'", "")


def shorten(text: Column, limit: int = 160) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit - 3)), F.lit("...")))


def eastern(ts: Column) -> Column:
    """``Sep 10, 11:30 AM``."""
    return F.date_format(F.from_utc_timestamp(ts, ZONE), "MMM d, h:mm a")


def eastern_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def epoch_millis(ms: Column) -> Column:
    """0 and null are null."""
    return F.timestamp_millis(F.nullif(ms, F.lit(0)))
