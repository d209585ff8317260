"""Date and time functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name parts of start and end columns; starts are tested first.
START_NAMES = "start|begin|created|issued|effective|opened"
END_NAMES = "end|finish|stop|closed|completed|expir"


def parse_iso(s: Column) -> Column:
    """DTM-01: ISO date or datetime; null for anything else."""
    return F.when(s.contains("T"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss"))).otherwise(F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))


def role(name: Column) -> Column:
    """DTM-04: start, end or null by a column's name."""
    n = F.lower(name)
    return F.when(n.rlike(START_NAMES), "start").when(n.rlike(END_NAMES), "end")


def end_of(start: Column, seconds: Column) -> Column:
    """DTM-03: a start plus a duration of at least one second."""
    return F.timestamp_add("SECOND", F.greatest(F.lit(1), seconds), start)


def quarter_start(day: Column) -> Column:
    """DTM-05."""
    return F.trunc(day, "quarter")


def archive_key(day: Column, today: Column) -> Column:
    """DTM-06: ``<year>Q<n>`` of days before the quarter of ``today``; null for the others."""
    return F.when(day < F.trunc(today, "quarter"), F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string")))
