"""Time buckets: a fixed width from 1970 UTC, or calendar units of a zone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def seconds_of(width: str) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*(second|minute|hour|day|week)s?\s*", width)
    if not m or int(m[1]) == 0:
        raise ValueError(f"no width of a bucket: {width!r}")
    return int(m[1]) * _UNITS[m[2]]


def bucket_start(at: Column, width: str) -> Column:
    """The start of the bucket that holds a timestamp without zone."""
    s = seconds_of(width)
    at = at.cast("timestamp_ntz")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    n = F.floor(F.timestamp_diff("MICROSECOND", epoch, at) / F.lit(s * 1_000_000))
    return F.timestamp_add("SECOND", (n * s), epoch).cast("timestamp_ntz")


def calendar_start(at: Column, unit: str, zone: str = "UTC") -> Column:
    """The start, in UTC, of the zone's day, week (Monday) or month that holds a UTC timestamp."""
    if unit not in ("day", "week", "month"):
        raise ValueError(f"no calendar unit: {unit!r}")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), at.cast("timestamp_ntz"))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), F.date_trunc(unit, local).cast("timestamp_ntz"))


def calendar_end(start: Column, unit: str, zone: str = "UTC") -> Column:
    """Where the calendar unit that begins at start (UTC) ends, in UTC; as long as the zone makes it."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), start.cast("timestamp_ntz"))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), F.timestamp_add(unit.upper(), F.lit(1), local).cast("timestamp_ntz"))
