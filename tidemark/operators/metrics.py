"""Exact, time-bucketed aggregation of labelled samples.

Everything is partial aggregation by (series, bucket) and then by (group, bucket). Steps between samples
come from a window over each series, which sees the newest sample before the range as well.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact, timegrid
from .tablequery import TableQuery

GAUGE, COUNTER = "gauge", "counter"
ALLOWED = {GAUGE: {"count", "sum", "avg", "min", "max", "first", "last", "delta"}, COUNTER: {"count", "first", "last", "increase", "rate"}}


@dataclass(frozen=True)
class Metrics:
    """A question about samples (at, value, labels...). Every call returns a new one."""

    samples: DataFrame
    labels: tuple[str, ...]
    kind: str = GAUGE
    conditions: tuple[Column, ...] = ()
    start: str | None = None
    end: str | None = None
    width: str | None = None
    unit: tuple[str, str] | None = None
    groups: tuple[str, ...] = ()
    nan: bool = False
    keep: str | None = None
    extra: dict = field(default_factory=dict)

    # -- conditions

    def one_of(self, label: str, *values: str) -> Metrics:
        return replace(self, conditions=(*self.conditions, F.col(label).isin(*values) if values else F.lit(False)))

    def none_of(self, label: str, *values: str) -> Metrics:
        """A series without the label is found, too."""
        return replace(self, conditions=(*self.conditions, F.col(label).isNull() | ~F.col(label).isin(*values)))

    def prefix(self, label: str, text: str) -> Metrics:
        return replace(self, conditions=(*self.conditions, F.startswith(label, F.lit(text))))

    def between(self, start: str | None, end: str | None) -> Metrics:
        """From start on, before end."""
        if start and end and start >= end:
            raise ValueError(f"an inverted range: {start} to {end}")
        return replace(self, start=start, end=end)

    def every(self, width: str) -> Metrics:
        timegrid.seconds_of(width)
        return replace(self, width=width, unit=None)

    def calendar(self, unit: str, zone: str = "UTC") -> Metrics:
        return replace(self, unit=(unit, zone), width=None)

    def by(self, *labels: str) -> Metrics:
        return replace(self, groups=labels)

    def without(self, *labels: str) -> Metrics:
        return replace(self, groups=tuple(x for x in self.labels if x not in labels))

    def skip_nan(self) -> Metrics:
        return replace(self, nan=True)

    def retain(self, since: str) -> Metrics:
        """Samples before `since` are past retention, and hidden from everything."""
        return replace(self, keep=since)

    # -- rows

    def _time(self, text: str) -> Column:
        return F.lit(text).cast("timestamp_ntz")

    def _found(self) -> DataFrame:
        df = self.samples
        for c in self.conditions:
            df = df.where(c)
        if self.keep:
            df = df.where(F.col("at") >= self._time(self.keep))
        if self.end:
            df = df.where(F.col("at") < self._time(self.end))
        if self.nan:
            df = df.where(~F.isnan("value"))
        return df

    def read(self) -> DataFrame:
        """Samples in the range, by series and time."""
        df = self._found()
        df = df.where(F.col("at") >= self._time(self.start)) if self.start else df
        return df.select(*self.labels, "at", "value").orderBy(*self.labels, "at")

    def latest(self) -> DataFrame:
        df = self._found()
        df = df.where(F.col("at") >= self._time(self.start)) if self.start else df
        return df.groupBy(*self.labels).agg(F.max("at").alias("at"), F.max_by("value", "at").alias("value"))

    def names(self) -> DataFrame:
        """For the metric: its series, its samples, the oldest and the newest."""
        key = F.struct(*self.labels)
        return self._found().agg(F.countDistinct(key).alias("series"), F.count("*").alias("samples"), F.min("at").alias("retained_from"), F.max("at").alias("newest"))

    def label_values(self, label: str, prefix: str = "", after: str = "", limit: int = 1000) -> DataFrame:
        c = F.col(label)
        return self._found().where(c.isNotNull() & F.startswith(c, F.lit(prefix)) & (c > after)).select(c.alias("value")).distinct().orderBy("value").limit(min(limit, 10_000))

    def label_names(self) -> DataFrame:
        """The labels that any series has, in byte order."""
        df = self._found()
        df = df.where(F.col("at") >= self._time(self.start)) if self.start else df
        named = F.array(*(F.when(F.col(x).isNotNull(), F.lit(x)) for x in self.labels))
        return df.select(F.explode(F.filter(named, lambda x: x.isNotNull())).alias("label")).distinct().orderBy("label")

    def deleted(self) -> DataFrame:
        """The samples that are left when the series that the conditions find are deleted, whole; without a condition it is refused."""
        if not self.conditions:
            raise ValueError("a delete needs a condition")
        hit = reduce(lambda a, c: a & F.coalesce(c, F.lit(False)), self.conditions, F.lit(True))
        return self.samples.where(~hit)

    def page(self, limit: int, after: str | None = None) -> tuple[DataFrame, TableQuery]:
        """Samples after a cursor, by series and time; the cursor is of this question alone."""
        order = reduce(lambda q, c: q.order_by(c), (*self.labels, "at"), TableQuery.table(self.read(), repr((self.start, self.end, self.keep, [str(c) for c in self.conditions]))))
        return order.page(limit, after)[0], order

    def bucket_page(self, *ops: str, buckets: int, after: str | None = None) -> tuple[DataFrame, str | None]:
        """aggregate() over the next so many buckets of the range, whole ones, and where the page after it begins; None if no sample lies there."""
        if not (self.width or self.unit) or not self.start:
            raise ValueError("pages need buckets, and a range with a start")
        at = self.samples.sparkSession.range(1).select(replace(self, start=None)._bucket_of(self._time(after or self.start)).alias("t"))
        for _ in range(buckets):
            at = at.select(self._end(F.col("t")).alias("t"))
        stop = at.select(F.col("t").cast("string")).first()[0]
        stop = min(stop, self.end) if self.end else stop
        here = replace(self, start=max(after, self.start) if after else self.start, end=stop)
        rest = replace(self, start=stop)
        more = rest._found().where(F.col("at") >= self._time(stop)).limit(1).count() if not self.end or stop < self.end else 0
        return here.aggregate(*ops), stop if more else None

    def _bucket_of(self, at: Column) -> Column:
        return timegrid.bucket_start(at, self.width) if self.width else timegrid.calendar_start(at, *self.unit)

    def _bucket(self) -> Column:
        if self.width:
            return timegrid.bucket_start(F.col("at"), self.width)
        if self.unit:
            return timegrid.calendar_start(F.col("at"), *self.unit)
        return self._time(self.start or "1970-01-01")

    def _end(self, start: Column) -> Column:
        """Where the bucket that begins at start ends; null if the range has no end."""
        if self.width:
            return F.timestamp_add("SECOND", F.lit(timegrid.seconds_of(self.width)), start).cast("timestamp_ntz")
        if self.unit:
            return timegrid.calendar_end(start, *self.unit)
        return self._time(self.end) if self.end else F.lit(None).cast("timestamp_ntz")

    def _before(self, start: Column) -> Column:
        """Where the bucket before the one that begins at start begins."""
        if self.width:
            return F.timestamp_add("SECOND", F.lit(-timegrid.seconds_of(self.width)), start).cast("timestamp_ntz")
        if self.unit:
            return timegrid.calendar_start(F.timestamp_add("MILLISECOND", F.lit(-1), start), *self.unit)
        return F.timestamp_add("MICROSECOND", -F.timestamp_diff("MICROSECOND", start, self._end(start)), start).cast("timestamp_ntz")

    def aggregate(self, *ops: str, now: str | None = None) -> DataFrame:
        """A row for each group and bucket that has samples: the ops, then samples, skipped (with skip_nan), and of steps resets and gap, and partial.

        Sums are exact and rounded once, whatever the values: a step counts as its two samples, so that the steps of
        a range add up. A NaN is refused, or skipped and counted; an infinity, and a counter below zero, are refused.
        gap: the first step of a series into the bucket began before the bucket before it (for a range that is one
        bucket: more than its length before it). partial: the range cuts the bucket, `now` has not reached its end,
        retention begins within it, or a first step is unknown although the series had samples before.
        """
        bad = [o for o in ops if o not in ALLOWED[self.kind]]
        if bad:
            raise ValueError(f"a {self.kind} has no {', '.join(bad)}")
        if "rate" in ops and not (self.width or self.unit or (self.start and self.end)):
            raise ValueError("a rate needs buckets, or a range with a start and an end")
        steps, ends = bool({"increase", "rate", "delta"} & set(ops)), bool({"first", "last"} & set(ops))
        df = self.samples
        for c in self.conditions:
            df = df.where(c)
        if self.end:
            df = df.where(F.col("at") < self._time(self.end))
        kept = F.col("at") >= self._time(self.keep) if self.keep else F.lit(True)
        taken = kept & ~F.isnan("value") if self.nan else kept
        if steps or ends:
            series = Window.partitionBy(*self.labels).orderBy("at")
            past = series.rowsBetween(Window.unboundedPreceding, -1)
            plain = not self.keep and not self.nan  # then the sample before is simply the last row
            ago = lambda c: F.lag(c).over(series) if plain else F.last(F.when(taken, c), ignorenulls=True).over(past)
            then = F.lead("at").over(series) if plain else F.first(F.when(taken, F.col("at")), ignorenulls=True).over(series.rowsBetween(1, Window.unboundedFollowing))
            df = df.select("*", ago(F.col("value")).alias("prev"), ago(F.col("at")).alias("prev_at"), then.alias("next_at"), F.lag("at").over(series).isNotNull().alias("older"))
        if self.start:
            df = df.where(F.col("at") >= self._time(self.start))
        df = df.where(kept).withColumn("bucket", self._bucket())
        stop = self._end(F.col("bucket"))
        since = F.greatest(F.col("bucket"), self._time(self.start)) if self.start else F.col("bucket")
        until = F.least(stop, self._time(self.end)) if self.end else stop
        value = F.when(taken, self._checked(F.col("value")))
        own = exact.own
        parts = {"n": F.count(own(value)), "low": F.min(own(value)), "high": F.max(own(value)), "rows": F.count(own(F.lit(1)))}
        merged = {"n": F.sum("n"), "low": F.min("low"), "high": F.max("high"), "rows": F.sum("rows")}
        terms: dict[str, list[Column]] = {}
        if {"sum", "avg"} & set(ops):
            terms["total"] = [exact.split(value)]
        if steps or ends:
            first = taken & (F.col("prev_at").isNull() | (F.col("prev_at") < since))
            last = taken & (F.col("next_at").isNull() | (F.coalesce(F.col("next_at") >= until, F.lit(False))))
            known = taken & F.col("prev").isNotNull()
            prev = F.when(known, self._checked(F.col("prev")))
            reset = F.when(known, F.col("value") < F.col("prev"))
            if {"increase", "rate"} & set(ops):
                terms["steps"] = [exact.split(F.when(known, value)), exact.split(F.when(~reset, prev), -1)]
            if "delta" in ops:
                terms["moved"] = [exact.split(F.when(known, value)), exact.split(prev, -1), exact.split(F.when(taken & ~known, F.lit(0.0)))]
            for name, mark in (("first", first), ("last", last)):
                if name in ops:
                    terms[name] = [exact.split(F.when(mark, value))]
                    parts |= {f"n_{name}": F.count(own(F.when(mark, value))), f"one_{name}": F.max(own(F.when(mark, value)))}
                    merged |= {f"n_{name}": F.sum(f"n_{name}"), f"one_{name}": F.max(f"one_{name}")}
            early = F.coalesce(first & (F.col("prev_at") < self._before(F.col("bucket"))), F.lit(False))
            unknown = F.coalesce(taken & F.col("prev").isNull() & F.col("older"), F.lit(False))
            parts |= {"resets": F.count_if(own(reset)), "gap": F.bool_or(own(early)), "unknown": F.bool_or(own(unknown))}
            merged |= {"resets": F.sum("resets"), "gap": F.bool_or("gap"), "unknown": F.bool_or("unknown")}
        keys = (*self.groups, "bucket")
        out = exact.summed(df, keys, terms, parts, merged)
        since = F.greatest(F.col("bucket"), self._time(self.start)) if self.start else F.col("bucket")
        cut = F.lit(False)
        if self.width or self.unit:
            cut = (since > F.col("bucket")) | (until < stop)
        if now:
            cut = cut | F.coalesce(until > F.timestamp_add("MILLISECOND", F.lit(1), self._time(now)), F.lit(False))
        if self.keep:
            cut = cut | (since < self._time(self.keep))
        if steps:
            cut = cut | F.col("unknown")
        of_one = lambda name: F.when(F.col(f"n_{name}") == 1, F.col(f"one_{name}")).otherwise(exact.joined(F.col(name)))  # noqa: E731  a single one, bit for bit
        micros = F.timestamp_diff("MICROSECOND", since, until)
        makes = {
            "count": lambda: F.col("n"), "min": lambda: F.col("low"), "max": lambda: F.col("high"),
            "sum": lambda: exact.joined(F.col("total")), "avg": lambda: exact.joined(F.col("total"), over=F.col("n")),
            "first": lambda: of_one("first"), "last": lambda: of_one("last"), "delta": lambda: exact.joined(F.col("moved")),
            # Steps that are all unknown add up to nothing.
            "increase": lambda: F.when(F.col("n") > 0, F.coalesce(exact.joined(F.col("steps")), F.lit(0.0))),
            "rate": lambda: F.when(F.col("n") > 0, F.coalesce(exact.joined(F.col("steps"), F.lit(1_000_000), micros), F.lit(0.0))),
        }
        more = [F.col("n").alias("samples")] + ([(F.col("rows") - F.col("n")).alias("skipped")] if self.nan else [])
        more += [F.col("resets"), F.col("gap")] if steps else []
        return out.select(*keys, *(makes[o]().alias(o) for o in ops), *more, cut.alias("partial"))

    def _checked(self, value: Column) -> Column:
        """value; an error where no aggregate takes it."""
        wrong = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
        out = F.when(wrong, F.raise_error(F.lit("an aggregate over a NaN or an infinity")).cast("double"))
        if self.kind == COUNTER:
            out = out.when(value < 0, F.raise_error(F.lit("an aggregate over a counter below zero")).cast("double"))
        return out.otherwise(value)

    def percentile(self, p: str) -> DataFrame:
        """The nearest rank of a gauge: an actual sample. Equal values are counted first, so that groups arrive condensed."""
        if self.kind != GAUGE:
            raise ValueError("percentiles are of gauges and timers")
        df = self._found()
        df = df.where(F.col("at") >= self._time(self.start)) if self.start else df
        keys = (*self.groups, "bucket")
        # Equal values first, then cells of neighbouring values, by exponent and leading bits: the cell that holds the rank
        # is found from the cells' counts, and only its values are sorted, so that no task sorts a group.
        rows = df.select(*keys[:-1], self._bucket().alias("bucket"), "value", exact.split(F.col("value")).alias("x"))
        size = F.when(F.col("x.m") == 0, F.lit(0).cast("long")).otherwise((F.col("x.e") + 1075).cast("long") * 4096 + F.shiftright(F.abs("x.m"), 41))
        counts = rows.groupBy(*keys, F.when(F.col("x.m") < 0, -size).otherwise(size).alias("cell"), "value").agg(F.count("*").alias("c"))
        w = Window.partitionBy(*keys)
        upto = F.sum("c").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        cells = counts.groupBy(*keys, "cell").agg(F.sum("c").alias("c")).withColumn("upto", upto).withColumn("n", F.sum("c").over(w))
        rank = exact.nearest_rank(F.col("n"), p)
        held = cells.where((F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank)).select(*(F.col(k).alias(f"_k_{k}") for k in (*keys, "cell")), (F.col("upto") - F.col("c")).alias("under"), "n")
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, "cell")))
        inside = counts.join(held, same).withColumn("place", F.col("under") + F.sum("c").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
        return inside.where(F.col("place") >= rank).groupBy(*keys).agg(F.min("value").alias("value"), F.first("n").alias("samples"))

    def histogram(self, bounds: list[float]) -> DataFrame:
        """Cumulative counts by bound (le; null: +Inf), as a timer keeps them, for each group and bucket."""
        df = self._found().withColumn("bucket", self._bucket())
        counts = [F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
        keys = (*self.groups, "bucket")
        out = df.groupBy(*keys).agg(*counts, F.count("*").alias("whole"))
        rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("c")) for i, b in enumerate(bounds)), F.struct(F.lit(None).cast("double").alias("le"), F.col("whole").alias("c")))
        return out.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")

    def fill(self, answer: DataFrame, start: str, end: str, most: int = 100_000) -> DataFrame:
        """answer with every bucket of the range for each of its groups; a bucket without samples has nulls."""
        step = timegrid.seconds_of(self.width)
        first, last = timegrid.bucket_start(self._time(start), self.width), self._time(end)
        grid = F.explode(F.sequence(first, F.timestamp_add("MICROSECOND", F.lit(-1), last), F.expr(f"interval {step} seconds"))).alias("bucket")
        spark = answer.sparkSession
        n = spark.range(1).select(F.timestamp_diff("SECOND", first, last)).first()[0]
        if n / step > most:
            raise ValueError(f"{n // step} buckets; the bound is {most}")
        groups = answer.select(*self.groups).distinct() if self.groups else spark.range(1).select()
        return groups.select(*self.groups, grid).join(answer, [*self.groups, "bucket"], "left")


def interval(histogram: DataFrame, keys: list[str], p: str) -> DataFrame:
    """The interval that holds a percentile of a histogram (keys, le, c): lower, upper (null: open) and an estimate."""
    parts, whole = exact.rank_parts(p)
    w = Window.partitionBy(*keys).orderBy(F.col("le").asc_nulls_last())
    h = histogram.withColumn("lower", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("under", F.coalesce(F.lag("c").over(w), F.lit(0).cast("long")))
    h = h.withColumn("total", F.max("c").over(Window.partitionBy(*keys)))
    # The first bound that so many values don't exceed, without a division.
    h = h.where((F.col("c") * whole >= F.col("total") * parts) & (F.col("under") * whole < F.col("total") * parts))
    share = (F.col("total") * (parts / whole) - F.col("under")) / (F.col("c") - F.col("under"))
    estimate = F.when(F.col("le").isNull(), F.col("lower")).otherwise(F.col("lower") + (F.col("le") - F.col("lower")) * share)
    return h.select(*keys, "lower", F.col("le").alias("upper"), F.col("total").alias("samples"), estimate.alias("estimate"))


def ingest(held: DataFrame, new: DataFrame, labels: list[str], sealed: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(what is added, what is refused): a resent sample adds nothing, one behind the seal is refused unless it is held."""
    key = [*labels, "at"]
    fresh = new.dropDuplicates(key).join(held.select(*key, F.col("value").alias("_held")), key, "left_anti")
    if not sealed:
        return fresh, fresh.limit(0)
    late = F.col("at") < F.lit(sealed).cast("timestamp_ntz")
    return fresh.where(~late), fresh.where(late)


def replace_range(held: DataFrame, new: DataFrame, series: dict[str, str], start: str, end: str) -> DataFrame:
    """One series' samples of a range give way to new ones."""
    inside = (F.col("at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("at") < F.lit(end).cast("timestamp_ntz"))
    for k, v in series.items():
        inside = inside & F.col(k).eqNullSafe(F.lit(v))
    return held.where(~inside).unionByName(new)


# --- exponential grids -------------------------------------------------------------------------------

# 2**(j/8 - 1), the fractions of the published table of bounds of schema 3.
FRACTIONS = [
    0.5,
    0.5452538663326288,
    0.5946035575013605,
    0.6484197773255048,
    0.7071067811865475,
    0.7711054127039704,
    0.8408964152537144,
    0.9170040432046711,
]
FINEST = 3


def grid_index(value: Column, schema: int) -> Column:
    """The interval (bound(i - 1), bound(i)] of the grid that holds a value above 0; null for 0, an error below it."""
    least = 2.0**-1022
    v = F.greatest(value, F.lit(least))
    # value = fraction * 2**e with a fraction from 0.5 to under 1; a logarithm that is off by one is set right.
    e = F.floor(F.log2(v)) + 1
    e = F.when(v >= F.pow(F.lit(2.0), F.least(e, F.lit(1023))), e + 1).otherwise(e)
    e = F.when(v < F.pow(F.lit(2.0), e - 1), e - 1).otherwise(e)
    fraction = v / F.pow(F.lit(2.0), e - 1) / 2
    count = 1 << schema
    steps = reduce(add, (F.when(fraction > f, 1).otherwise(0) for f in FRACTIONS[:: 1 << (FINEST - schema)]))
    index = ((e - 1) * count + steps).cast("int")
    return F.when(value > 0, index).when(value < 0, F.raise_error(F.lit("a timer holds no value below 0")))


def grid_bound(index: Column, schema: Column) -> Column:
    """bound(index) of a grid, from the table."""
    finest = index * F.pow(F.lit(2), FINEST - schema).cast("int")
    octave, j = F.floor(finest / 8), F.pmod(finest, F.lit(8))
    return F.element_at(F.array(*(F.lit(f) for f in FRACTIONS)), (j + 1).cast("int")) * F.pow(F.lit(2.0), octave + 1)


def merged_grids(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Bins (keys, schema, index, c) of several grids on the coarsest of each group: interval i lies in ceil(i / 2).

    A bin that counts nothing doesn't coarsen the others.
    """
    held = bins.where("c > 0").groupBy(*keys, "schema", "index").agg(F.sum("c").alias("c"))
    coarsest = held.groupBy(*keys).agg(F.min("schema").alias("_least"))
    both = held.join(coarsest, keys)
    shift = F.pow(F.lit(2), F.col("schema") - F.col("_least"))
    return both.select(*keys, F.col("_least").alias("schema"), F.ceil(F.col("index") / shift).cast("int").alias("index"), "c").groupBy(*keys, "schema", "index").agg(F.sum("c").alias("c"))


def grid_interval(bins: DataFrame, keys: list[str], p: str) -> DataFrame:
    """The interval of merged bins that holds a percentile: lower, upper and samples. The bin of 0 is its own interval."""
    parts, whole = exact.rank_parts(p)
    w = Window.partitionBy(*keys)
    ranked = bins.withColumn("upto", F.sum("c").over(w.orderBy(F.col("index").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("c").over(w))
    at = ranked.where((F.col("upto") * whole >= F.col("total") * parts) & ((F.col("upto") - F.col("c")) * whole < F.col("total") * parts))
    zero = F.lit(0.0)
    return at.select(*keys, F.coalesce(grid_bound(F.col("index") - 1, F.col("schema")), zero).alias("lower"), F.coalesce(grid_bound(F.col("index"), F.col("schema")), zero).alias("upper"), F.col("total").alias("samples"))
