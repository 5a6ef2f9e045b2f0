"""Times in UTC, run ids, elapsed times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(at: Column) -> Column:
    """A timestamp of UTC as text to the second."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def run_id(at: Column, label: Column) -> Column:
    """A run's id: its time and its label, fit for a file name; runs sort by time."""
    return F.concat_ws("__", F.date_format(at, "yyyyMMdd_HHmmss"), F.nullif(F.regexp_replace(F.coalesce(label, F.lit("")), r"[^A-Za-z0-9_.-]+", "_"), F.lit("")))


def elapsed_ms(began: Column, ended: Column) -> Column:
    """Milliseconds between two timestamps, none below 0; null where one is missing."""
    at = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.when(began.isNotNull() & ended.isNotNull(), F.greatest(F.lit(0), F.floor((at(ended) - at(began)) / 1000)).cast("long"))
