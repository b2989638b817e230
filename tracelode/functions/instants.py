"""Instants of time that arrive as strings in several notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Only full dates with a time of day count as an instant: a bare clock time would be read as today's.
_READABLE = r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"


def instant_micros(raw: Column) -> Column:
    """Microseconds since 1970 UTC of an ISO-like string, null where it can't be read.

    A string without an offset is taken as UTC (the session time zone is expected to be UTC).
    """
    return F.when(raw.rlike(_READABLE), F.unix_micros(F.try_to_timestamp(F.trim(raw))))


def instant(raw: Column) -> Column:
    """The same as a TIMESTAMP."""
    return F.when(raw.rlike(_READABLE), F.try_to_timestamp(F.trim(raw)))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds from one raw instant to another, never negative, 0 where either is unreadable."""
    return F.coalesce(F.greatest(F.lit(0.0), (instant_micros(end) - instant_micros(start)) / F.lit(1000.0)), F.lit(0.0))
