"""Cron expressions of five fields on a zone's wall clock, and fixed intervals with a phase."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Shorthands, names, and the least and greatest value of each field.
SHORTHANDS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
WEEKDAYS = "sun mon tue wed thu fri sat".split()
RANGES = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]

#: Days looked through for the next time: two leap years are eight years apart at most.
HORIZON = 366 * 8


def _values(text: str, low: int, high: int, names: dict[str, int]) -> set[int]:
    out: set[int] = set()
    for item in text.lower().split(","):
        span, slash, step = item.partition("/")
        if slash and (not step.isdigit() or int(step) == 0):
            raise ValueError(f"no step: {item!r}")
        a, dash, b = span.partition("-")
        ends = [names.get(x, int(x) if x.isdigit() else -1) for x in ((a, b) if dash else (a,))] if span != "*" else [low, high]
        if len(ends) == 1:
            ends = [ends[0], high if slash else ends[0]]
        if not low <= ends[0] <= ends[1] <= high:
            raise ValueError(f"not within {low} to {high}: {item!r}")
        out |= set(range(ends[0], ends[1] + 1, int(step or 1)))
    return out


class Cron:
    """When both the day of the month and the weekday are given, either is enough."""

    def __init__(self, text: str):
        fields = SHORTHANDS.get(text.strip().lower(), text).split()
        if len(fields) != 5:
            raise ValueError(f"five fields, not {len(fields)}: {text!r}")
        names = [{}, {}, {}, {n: i for i, n in enumerate(MONTHS, 1)}, {n: i for i, n in enumerate(WEEKDAYS)}]
        minutes, hours, self.days, self.months, weekdays = (_values(f, *r, n) for f, r, n in zip(fields, RANGES, names))
        self.times = [(h, m) for h in sorted(hours) for m in sorted(minutes)]
        self.weekdays = {d % 7 for d in weekdays}
        self.any_day, self.any_weekday = fields[2] == "*", fields[4] == "*"

    def runs_on(self, day: date) -> bool:
        if day.month not in self.months:
            return False
        by_day, by_weekday = day.day in self.days, day.isoweekday() % 7 in self.weekdays
        return by_day or by_weekday if not self.any_day and not self.any_weekday else by_day and by_weekday

    def next(self, zone: ZoneInfo, after: datetime) -> datetime | None:
        """The first time (UTC) after another one. A wall time that is skipped runs when the skip ends; one that comes twice, the first time."""
        day = after.astimezone(zone).date()
        for _ in range(HORIZON):
            if self.runs_on(day):
                found = [t for h, m in self.times if (t := instant(zone, datetime(day.year, day.month, day.day, h, m))) > after]
                if found:
                    return min(found)
            day += timedelta(days=1)
        return None


def instant(zone: ZoneInfo, wall: datetime) -> datetime:
    """The UTC time of a wall time; the end of the skip for one that is skipped."""
    early, late = (wall.replace(tzinfo=zone, fold=f).astimezone(UTC) for f in (0, 1))
    if early.astimezone(zone).replace(tzinfo=None) == wall:
        return early
    # In a skip the first reading uses the offset before it, so that it lies after the end; the end is where the offset changes.
    low, high = sorted((early, late))
    before = low.astimezone(zone).utcoffset()
    while high - low > timedelta(seconds=1):
        mid = low + (high - low) // 2
        low, high = (mid, high) if mid.astimezone(zone).utcoffset() == before else (low, mid)
    return high.replace(microsecond=0)


def next_column(text: str, zone: str):
    """A function of a UTC timestamp column: the next time that a cron expression names. Times of one minute are worked out once."""
    cron = Cron(text)

    @F.pandas_udf("timestamp_ntz")
    def run(at: pd.Series) -> pd.Series:
        where = ZoneInfo(zone)

        @lru_cache(100_000)
        def one(minute: pd.Timestamp):
            found = cron.next(where, minute.to_pydatetime().replace(tzinfo=UTC))
            return pd.NaT if found is None else pd.Timestamp(found.replace(tzinfo=None))

        # Whole minutes only run: the next after any second of a minute is the next after its start.
        return pd.Series([pd.NaT if pd.isna(t) else one(t.floor("min")) for t in at], dtype="datetime64[us]")

    return run


def every(at: Column, key: Column, seconds: int) -> Column:
    """The next run of a fixed interval, at a phase of the key's own within it."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    phase = F.pmod(F.xxhash64(key), F.lit(seconds))
    now = F.timestamp_diff("SECOND", epoch, at.cast("timestamp_ntz"))
    return F.timestamp_add("SECOND", (F.floor((now - phase) / seconds) + 1) * seconds + phase, epoch)
