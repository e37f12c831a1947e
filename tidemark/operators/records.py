"""Filtering, paging and aggregation of events with JSON fields and context."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact, jsontext, timegrid

#: A number as JSON spells it.
NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"

#: Keys that are the event's own before they are a field's.
OWN = ("stream", "name", "level", "message")


@dataclass(frozen=True)
class Records:
    """A question about events (at, id, stream, name, level, message, fields, context)."""

    events: DataFrame
    conditions: tuple[Column, ...] = ()

    def _with(self, c: Column) -> Records:
        return replace(self, conditions=(*self.conditions, c))

    def streams(self, *names: str) -> Records:
        return self._with(F.col("stream").isin(*names))

    def names(self, *names: str) -> Records:
        return self._with(F.col("name").isin(*names))

    def between(self, start: str, end: str) -> Records:
        return self._with((F.col("at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("at") < F.lit(end).cast("timestamp_ntz")))

    def min_level(self, level: int) -> Records:
        """An event without a level is not found."""
        return self._with(F.col("level") >= level)

    def where(self, key: str, *values: str) -> Records:
        """The key's value, in fields or else in context, is spelled like one of the JSON texts."""
        return self._with(self.value(key).isin(*values))

    def where_not(self, key: str, *values: str) -> Records:
        v = self.value(key)
        return self._with(v.isNull() | ~v.isin(*values))

    def where_prefix(self, key: str, text: str) -> Records:
        return self._with(F.startswith(self.value(key), F.lit(text)))

    def search(self, text: str) -> Records:
        """A text in the message, the name or any JSON value, in any case; only JSON that holds it, or an escape, is parsed."""
        low = text.lower()
        has = lambda c: F.contains(F.lower(c), F.lit(low))
        might = lambda c: F.when(has(c) | F.contains(F.col(c), F.lit("\\")), F.col(c))
        said = jsontext.says_column(text)
        return self._with(has("message") | has("name") | F.coalesce(said(might("fields")), F.lit(False)) | F.coalesce(said(might("context")), F.lit(False)))

    def trace(self, trace_id: str) -> Records:
        """Events of one trace (a column trace_id of 32 hexadecimal digits)."""
        if not re.fullmatch("[0-9a-f]{32}", trace_id):
            raise ValueError(f"no trace: {trace_id!r}")
        return self._with(F.col("trace_id") == trace_id)

    def after(self, at: str, id_) -> Records:
        """Events after a place in the order of time and arrival."""
        t = F.lit(at).cast("timestamp_ntz")
        return self._with((F.col("at") > t) | ((F.col("at") == t) & (F.col("id") > F.lit(id_))))

    def value(self, key: str) -> Column:
        """The JSON text of a key as it is spelled; null if it is absent."""
        if key in OWN:
            return F.col(key).cast("string")
        return F.coalesce(jsontext.value_of(F.col("fields"), key), jsontext.value_of(F.col("context"), key))

    def found(self) -> DataFrame:
        df = self.events
        for c in self.conditions:
            df = df.where(c)
        return df

    def list(self, newest: bool = False, limit: int = 1000) -> DataFrame:
        """In event time, ties by arrival. A page never splits one time: rows of the last time all come."""
        df = self.found()
        order = [F.col("at").desc() if newest else F.col("at").asc(), F.col("id").desc() if newest else F.col("id").asc()]
        edge = df.orderBy(*order).select("at").limit(limit).agg((F.min if newest else F.max)("at").alias("edge"))
        page = df.join(F.broadcast(edge), (F.col("at") >= F.col("edge")) if newest else (F.col("at") <= F.col("edge")))  # one row
        return page.drop("edge").orderBy(*order)

    def count(self) -> DataFrame:
        return self.found().agg(F.count("*").alias("events"))

    def top(self, key: str, limit: int = 10) -> DataFrame:
        v = self.value(key)
        return self.found().select(v.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "value").limit(min(limit, 1000))

    def largest(self, key: str, limit: int = 10) -> DataFrame:
        """Events by the key's number (a double, `number`); integers and floats are compared exactly: where doubles are equal, the wholes decide."""
        df = self.found().withColumn("_v", self.value(key))
        whole, number = _whole(F.col("_v")), F.when(F.col("_v").rlike(NUMBER), F.col("_v").try_cast("double"))
        # Floats from 2**53 on are whole, and have the exact value m * 2**e; below that, equal doubles are equal numbers.
        of_float = lambda x: (x["m"].cast("decimal(20,0)") * F.pow(F.lit(2.0), F.greatest(x["e"], F.lit(0))).cast("decimal(18,0)")).cast("decimal(38,0)")
        wide = F.abs(F.col("number")).between(2.0**53, 2.0**65)
        df = df.withColumns({"number": number, "_i": whole}).where("number IS NOT NULL")
        df = df.withColumn("_exact", F.when(wide, F.coalesce(F.col("_i").cast("decimal(38,0)"), F.get(F.transform(F.array(exact.split(F.col("number"))), of_float), 0))))
        return df.orderBy(F.desc("number"), F.desc("_exact"), "at", "id").limit(min(limit, 1000)).drop("_v", "_i", "_exact")

    def aggregate(self, by: tuple[str, ...] = (), every: str | None = None, stats: str | None = None, distinct: tuple[str, ...] = ()) -> DataFrame:
        """A row for each group: events; of a key's numbers samples, sum, min, max, avg and whole (the exact sum, if all are integers); and how many values other keys have.

        Sums are exact, whatever the order, and rounded once.
        """
        keys = {k: self.value(k) for k in by} | ({"span": timegrid.bucket_start(F.col("at"), every)} if every else {})
        more = {f"_d_{d}": self.value(d) for d in distinct} | ({"_v": self.value(stats)} if stats else {})
        df = self.found().select(*(c.alias(k) for k, c in {**keys, **more}.items()))
        out = df.groupBy(*keys).agg(F.count("*").alias("events"), *(F.countDistinct(f"_d_{d}").alias(f"distinct_{d}") for d in distinct))
        if not stats:
            return out
        whole = _whole(F.col("_v"))
        df = df.withColumn("_i", whole).withColumn("_f", F.when(F.col("_i").isNull() & F.col("_v").rlike(NUMBER), F.col("_v").try_cast("double")))
        number = F.coalesce(F.col("_f"), F.col("_i").cast("double"))
        low = F.pmod(F.col("_i"), F.lit(2**32).cast("decimal(20,0)"))  # an integer is two doubles, exactly
        terms = [exact.split((F.col("_i") - low).cast("double")), exact.split(low.cast("double")), exact.split(F.col("_f"))]
        own = exact.own
        parts = {"samples": F.count(own(number)), "min": F.min(own(number)), "max": F.max(own(number)), "floats": F.count(own(F.col("_f"))), "whole": F.sum(own(F.col("_i")))}
        merged = {"samples": F.sum("samples"), "min": F.min("min"), "max": F.max("max"), "floats": F.sum("floats"), "whole": F.sum("whole")}
        numbers = exact.summed(df, tuple(keys), {"sum": terms}, parts, merged)
        numbers = numbers.withColumn("avg", exact.joined(F.col("sum"), over=F.col("samples"))).withColumn("sum", exact.joined(F.col("sum")))
        numbers = numbers.withColumn("whole", F.when(F.col("floats") == 0, F.col("whole").cast("decimal(38,0)"))).drop("floats")
        named = numbers.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "samples", "sum", "min", "max", "avg", "whole")
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys), F.lit(True))
        return out.join(named, same, "left").drop(*(f"_k_{k}" for k in keys))

    def fields(self) -> DataFrame:
        """For each key of the fields: its events, and the kinds of its values."""
        kinds = jsontext.kinds_column()
        each = self.found().select(F.explode(kinds(F.col("fields"))).alias("key", "kind"))
        return each.groupBy("key", "kind").agg(F.count("*").alias("events"))

    def field_names(self, prefix: str = "") -> DataFrame:
        """Keys of fields and contexts in byte order."""
        spelled = jsontext.members_column()
        both = F.concat(F.map_keys(spelled(F.col("fields"))), F.map_keys(spelled(F.col("context"))))
        return self.found().select(F.explode(both).alias("key")).where(F.startswith("key", F.lit(prefix))).distinct().orderBy("key")

    def stream_list(self) -> DataFrame:
        return self.found().groupBy("stream").agg(F.count("*").alias("events"), F.min("at").alias("retained_from"), F.max("at").alias("newest"))

    def deleted(self) -> DataFrame:
        """What is left when the events that are found are deleted; refuses to delete all by having no condition."""
        if not self.conditions:
            raise ValueError("a delete needs a condition")
        hit = F.lit(True)
        for c in self.conditions:
            hit = hit & F.coalesce(c, F.lit(False))
        return self.events.where(~hit)


def appended(held: DataFrame, new: DataFrame) -> DataFrame:
    """The events of new that are not held: an id names one event of a stream. An event without an id is always one of its own."""
    named = new.where("id IS NOT NULL").dropDuplicates(["stream", "id"]).join(held.select("stream", "id"), ["stream", "id"], "left_anti")
    return named.select(*new.columns).unionByName(new.where("id IS NULL"))


def poll(events: DataFrame, cursor: int, limit: int, kept_from: int = 0) -> tuple[DataFrame, DataFrame]:
    """(the next events after a cursor, by their arrival number; one row: the next cursor, and expired, how many went before they were read)."""
    start = max(cursor, kept_from - 1)
    page = events.where(F.col("arrival") > start).orderBy("arrival").limit(limit)
    after = page.agg(F.coalesce(F.max("arrival"), F.lit(start)).cast("long").alias("cursor")).withColumn("expired", F.lit(max(0, kept_from - 1 - cursor)).cast("long"))
    return page, after


def filled(answer: DataFrame, by: list[str], every: str, counts: list[str], most: int = 10_000) -> DataFrame:
    """answer with every span between its first and last for each of its groups; counts are 0 where nothing was. At most `most` rows."""
    seconds = timegrid.seconds_of(every)
    ends = answer.agg(F.min("span").alias("a"), F.max("span").alias("b"))
    first = ends.select(F.timestamp_diff("SECOND", F.col("a"), F.col("b"))).first()[0]
    groups = answer.select(*by).distinct() if by else answer.sparkSession.range(1).select()
    spans = 0 if first is None else first // seconds + 1
    if spans > most or spans * groups.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    grid = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {seconds} seconds"))).alias("span"))
    same = reduce(and_, (F.col(f"_g_{k}").eqNullSafe(F.col(k)) for k in by), F.col("_span") == F.col("span"))
    whole = groups.select(*(F.col(k).alias(f"_g_{k}") for k in by)).join(F.broadcast(grid.withColumnRenamed("span", "_span")))  # `most` rows at most
    out = whole.join(answer, same, "left").drop(*by, "span")
    return out.withColumnsRenamed({f"_g_{k}": k for k in by} | {"_span": "span"}).fillna(0, counts)


def _whole(text: Column) -> Column:
    """An integer of 64 bits, signed or not, by its spelling; null for other texts."""
    n = F.when(text.rlike(r"^-?(?:0|[1-9][0-9]{0,19})$"), text.try_cast("decimal(20,0)"))
    return F.when(n.between(F.lit(Decimal(-(2**63))), F.lit(Decimal(2**64 - 1))), n)
