"""Timers and instruments: the parts of a timer by its name, bounds that members share, and what instruments write."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timegrid
from .metrics import COUNTER, GAUGE, Metrics, interval

#: The label set that series beyond a bound are counted under.
OVERFLOW = "__overflow"


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a with b's other columns, where their keys are the same; null is a key like any other."""
    named = b.withColumnsRenamed({k: f"_b_{k}" for k in keys})
    return a.join(named, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys)), "left").drop(*(f"_b_{k}" for k in keys))


def timer(m: Metrics, name: str) -> DataFrame:
    """Of the timer `name`, for each group and bucket: count, rate, sum, avg (null where it measured nothing) and max.

    m's samples have a column `name`; a timer's parts are name_count and name_sum, which are counters, name_max, and
    name_bucket with the label le.
    """
    part = lambda end, kind: replace(m, samples=m.samples.where(F.col("name") == name + end), kind=kind)
    keys = [*m.groups, "bucket"]
    out = part("_count", COUNTER).aggregate("increase", "rate").select(*keys, F.col("increase").alias("count"), "rate", "resets", "partial")
    out = _same(out, part("_sum", COUNTER).aggregate("increase").select(*keys, F.col("increase").alias("sum")), keys)
    out = _same(out, part("_max", GAUGE).aggregate("max").select(*keys, "max"), keys)
    return out.withColumn("avg", F.when(F.col("count") > 0, F.col("sum") / F.col("count")))


def heatmap(m: Metrics, name: str) -> DataFrame:
    """The increase of each bound's counter (le; null is +Inf) for each group and bucket, over the bounds that all members share."""
    buckets = replace(m, samples=m.samples.where(F.col("name") == name + "_bucket"), kind=COUNTER, groups=m.labels)
    each = buckets.aggregate("increase").select(*m.labels, "bucket", "increase", "samples")
    members = [x for x in m.labels if x != "le"]
    each = each.withColumn("le", F.when(F.col("le") != "+Inf", F.col("le").cast("double"))).withColumnRenamed("increase", "c")
    return shared_bounds(each, [*m.groups, "bucket"], members)


def shared_bounds(each: DataFrame, keys: list[str], members: list[str]) -> DataFrame:
    """(keys, le, c): counts by the bounds that every member with counts holds. each: keys, members, le, c, samples.

    A member holds a bound if that has as many samples as its +Inf (le null): one that it began to write later, or no
    longer writes, is not held.
    """
    whole = each.where("le IS NULL AND c > 0").select(*{*keys, *members}, F.col("samples").alias("_all"))
    held = _same(each, whole, [*dict.fromkeys([*keys, *members])]).where("_all = samples")
    counted = held.groupBy(*keys, "le").agg(F.sum("c").alias("c"), F.count("*").alias("_n"))
    most = whole.groupBy(*keys).agg(F.count("*").alias("_members"))
    return _same(counted, most, keys).where("_n = _members").select(*keys, "le", F.col("c").cast("long").alias("c"))


def percentile(m: Metrics, name: str, p: str) -> DataFrame:
    """The interval that holds a percentile of a timer's durations, for each group and bucket: lower, upper, samples and an estimate."""
    return interval(heatmap(m, name), [*m.groups, "bucket"], p)


# --- instruments -----------------------------------------------------------------------------------------


def bounded(measured: DataFrame, labels: list[str], most: int) -> DataFrame:
    """measured (at, labels, value) with the label sets beyond the first `most` counted under OVERFLOW. Sets come in the order of their first measurement."""
    sets = measured.groupBy(*labels).agg(F.min("at").alias("_first"))
    first = sets.orderBy("_first", *labels).limit(most).drop("_first").withColumn("_kept", F.lit(True))
    met = _same(measured, first, labels)
    return met.withColumns({x: F.when(F.col("_kept"), F.col(x)).otherwise(F.lit(OVERFLOW)) for x in labels}).drop("_kept")


def totals(measured: DataFrame, labels: list[str], every: str = "15 seconds", idle: str = "1 hour") -> DataFrame:
    """The samples (labels, at, value) of a counter that is written every so often: its running total at each time it changed.

    Each run begins with a zero, one interval before its first sample, so that a restart reads as a reset and its first
    count is counted; a series that was idle for so long begins a new run.
    """
    step = timegrid.seconds_of(every)
    tick = F.timestamp_add("SECOND", F.lit(step), timegrid.bucket_start(F.col("at"), every)).cast("timestamp_ntz")
    sums = measured.groupBy(*labels, tick.alias("at")).agg(F.sum("value").alias("n"))
    series = Window.partitionBy(*labels).orderBy("at")
    gap = F.timestamp_diff("SECOND", F.lag("at").over(series), F.col("at"))
    begins = sums.withColumn("_new", F.when(F.coalesce(gap >= timegrid.seconds_of(idle), F.lit(True)), 1).otherwise(0))
    runs = begins.withColumn("_run", F.sum("_new").over(series.rowsBetween(Window.unboundedPreceding, 0)))
    running = Window.partitionBy(*labels, "_run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    written = runs.select(*labels, "at", F.sum("n").over(running).alias("value"), "_new")
    zeros = written.where("_new = 1").select(*labels, F.timestamp_add("SECOND", F.lit(-step), F.col("at")).cast("timestamp_ntz").alias("at"), F.lit(0).cast(written.schema["value"].dataType).alias("value"))
    return written.drop("_new").unionByName(zeros)


def durations(measured: DataFrame, labels: list[str], name: str, bounds: list[float], every: str = "15 seconds") -> DataFrame:
    """The series of a timer from its durations (at, labels, value): samples (name, le, labels, at, value) of its parts. Cumulative, as counters are."""
    step = timegrid.seconds_of(every)
    tick = F.timestamp_add("SECOND", F.lit(step), timegrid.bucket_start(F.col("at"), every)).cast("timestamp_ntz")
    counts = [F.count_if(F.col("value") <= b).cast("double").alias(f"b{i}") for i, b in enumerate(bounds)]
    sums = measured.groupBy(*labels, tick.alias("at")).agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"), *counts)
    running = Window.partitionBy(*labels).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.sum(c).over(running)
    of = lambda end, le, value: F.struct(F.lit(name + end).alias("name"), F.lit(le).cast("string").alias("le"), value.alias("value"))
    parts = [of("_count", None, run("n")), of("_sum", None, run("total")), of("_max", None, F.col("most")), of("_bucket", "+Inf", run("n"))]
    parts += [of("_bucket", repr(float(b)), run(f"b{i}")) for i, b in enumerate(bounds)]
    return sums.select(*labels, "at", F.array(*parts).alias("x")).select(*labels, "at", F.explode("x").alias("x")).select("x.name", "x.le", *labels, "at", "x.value")
