"""Lists of jobs, their states, rates of starts, and requests that repeat one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timegrid
from .state import folded


def state_of(now: str) -> Column:
    """The state of a job (next, until: its lease) that has not failed."""
    t = F.lit(now).cast("timestamp_ntz")
    return F.when(F.coalesce(F.col("until") > t, F.lit(False)), "running").when(F.col("next") <= t, "waiting").otherwise("scheduled")


def all_jobs(jobs: DataFrame, failed: DataFrame, leases: DataFrame, now: str) -> DataFrame:
    """Jobs (id, next...) and failed ones (id...) as one list with their state. Two tables, merged by key in a list's order."""
    live = leases.groupBy("id").agg(F.max("until").alias("until"))
    held = jobs.join(live, "id", "left").withColumn("state", state_of(now)).drop("until")
    return held.unionByName(failed.withColumn("state", F.lit("failed")), allowMissingColumns=True)


def listed(everything: DataFrame, prefix: str = "", states: tuple[str, ...] = (), after: str | None = None, limit: int = 1000) -> DataFrame:
    """A page in the byte order of ids: below a prefix, in one of the states, after an id."""
    found = everything.where(F.startswith("id", F.lit(prefix)))
    if states:
        found = found.where(F.col("state").isin(*states))
    if after is not None:
        found = found.where(F.col("id") > after)
    return found.orderBy("id").limit(limit)


def counts(everything: DataFrame) -> DataFrame:
    """One row: scheduled, waiting, running and failed."""
    return everything.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("scheduled", "waiting", "running", "failed")))


def may_start(due: DataFrame, starts: DataFrame, now: str, most: int, seconds: int, group: str = "grp") -> DataFrame:
    """The due jobs (id, next, group) that a rate of `most` starts of a group in so many seconds leaves room for, first ones first."""
    t = F.lit(now).cast("timestamp_ntz")
    recent = starts.where((F.col("at") > F.timestamp_add("SECOND", F.lit(-seconds), t)) & (F.col("at") <= t)).groupBy(group).agg(F.count("*").alias("_started"))
    ranked = due.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("next", "id"))).where(F.col("_n") <= most)
    return ranked.join(recent, group, "left").where(F.col("_n") + F.coalesce("_started", F.lit(0)) <= most).select(*due.columns)


def deduped(requests: DataFrame, key: str, order: list[str], at: str, span: str | None = None, unit: str | None = None, zone: str = "UTC") -> DataFrame:
    """The requests that become jobs: one keeps others of its key away for a span, or until the zone's day, week or month ends."""
    if (span is None) == (unit is None):
        raise ValueError("a span, or a calendar unit")
    t = F.col(at).cast("timestamp_ntz")
    until = F.timestamp_add("SECOND", F.lit(timegrid.seconds_of(span)), t) if span else timegrid.calendar_end(timegrid.calendar_start(t, unit, zone), unit, zone)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))

    def step(state: int, row):
        now, ends = row
        return (ends, (True,)) if now >= state else (state, (False,))

    rows = requests.withColumns({"_at": micros(t), "_until": micros(until)})
    return folded(rows, key, order, ["_at", "_until"], lambda: -(2**62), step, "runs boolean").where("runs").select(key, *order)
