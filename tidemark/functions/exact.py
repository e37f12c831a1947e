"""Sums that don't depend on order, and nearest ranks of exact decimals.

A double is an integer times a power of two. Exact sums add the integers of each power in the JVM, in
three parts, by partial aggregation; what is left of a group are as many numbers as there are powers (2046
at most), and those are put together and rounded once.
"""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import ship


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def split(value: Column, sign: int = 1) -> Column:
    """struct(e, m) with value = m * 2**e exactly, m of 53 bits at most; null for a null. value is finite."""
    two = lambda e: F.pow(F.lit(2.0), e)  # noqa: E731  exact for whole e

    def parts(v: Column) -> Column:
        size = F.abs(v)
        guess = F.floor(F.log2(F.when(size > 0, size).otherwise(F.lit(1.0)))).cast("int")

        def at(e: Column) -> Column:
            # A logarithm that is off by one is set right.
            high = F.when(size >= two(e + 1), e + 1).when(size < two(e), e - 1).otherwise(e)
            return _let(F.greatest(high - 52, F.lit(-1074)), lambda u: F.struct(u.alias("e"), scaled(v, u).alias("m")))

        def scaled(v: Column, u: Column) -> Column:
            half = F.floor(-u / 2).cast("int")  # in two steps, as 2**1074 is no double
            return (v * two(half) * two(-u - half)).cast("long") * F.lit(sign)

        return F.when(v.isNotNull(), F.when(v == 0, F.struct(F.lit(0).alias("e"), F.lit(0).cast("long").alias("m"))).otherwise(_let(guess, at)))

    return _let(value, parts)


def rounded(total: int, power: int, times: int = 1, over: int = 1) -> float:
    """total * 2**power * times / over, rounded once; beyond the doubles an infinity."""
    f = Fraction(total * times, over) * (Fraction(2) ** power)
    try:
        return float(f)
    except OverflowError:
        return math.copysign(math.inf, total)


@F.pandas_udf(DoubleType())
def _joined(parts: pd.Series, times: pd.Series, over: pd.Series) -> pd.Series:
    def one(rows, t, o) -> float | None:
        if rows is None or not len(rows) or pd.isna(o) or not o:
            return None
        least = min(r["e"] for r in rows)
        return rounded(sum(((r["a"] << 36) + (r["b"] << 18) + r["c"]) << (r["e"] - least) for r in rows), least, int(t), int(o))

    return pd.Series([one(*x) for x in zip(parts, times, over)], dtype=object).astype("Float64")


def joined(parts: Column, times: Column | None = None, over: Column | None = None) -> Column:
    """The number that a list of (e, m) adds up to, times and divided by whole numbers, rounded once; null for an empty list."""
    one = F.lit(1).cast("long")
    return _joined(parts, one if times is None else times.cast("long"), one if over is None else over.cast("long"))


def summed(rows: DataFrame, keys: tuple[str, ...], terms: dict[str, list[Column]], parts: dict[str, Column], merged: dict[str, Column]) -> DataFrame:
    """Exact sums and other aggregates of groups, in one pass with partial aggregation.

    terms: for each name the split() values that a row adds to it; a null adds nothing. A column of that name
    holds the list that joined() takes. parts: aggregates over rows that are null for all but the first copy of
    a row, by own(); merged: how partial ones are put together.
    """
    ship(rows.sparkSession)
    columns = [(name, c) for name, some in terms.items() for c in some]
    none = F.struct(F.lit(None).cast("string").alias("which"), F.lit(None).cast("int").alias("e"), F.lit(None).cast("long").alias("m"))
    if len(columns) <= 1:  # a row needs no copies
        flat = rows.withColumn("_x", columns[0][1] if columns else none).withColumn("_which", F.lit(None).cast("string"))
        mine = {name: F.col("_e").isNotNull() for name in terms}
    else:
        copies = [none, *(F.when(c.isNotNull(), F.struct(F.lit(name).alias("which"), c["e"].alias("e"), c["m"].alias("m"))) for name, c in columns)]
        flat = rows.withColumn("_x", F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull()))).withColumn("_which", F.col("_x.which"))
        mine = {name: F.col("_which") == name for name in terms}
    flat = flat.withColumns({"_e": F.col("_x.e"), "_m": F.col("_x.m")}).drop("_x")
    # 53 bits in three parts, whose sums are 64-bit integers for 2**45 rows.
    low = F.lit(2**18 - 1).cast("long")
    sums = {"_a": F.sum(F.shiftright("_m", 36)), "_b": F.sum(F.shiftright("_m", 18).bitwiseAND(low)), "_c": F.sum(F.col("_m").bitwiseAND(low))}
    once = flat.groupBy(*keys, "_which", "_e").agg(*(c.alias(k) for k, c in {**sums, **parts}.items()))
    lists = {name: F.collect_list(F.when(is_, F.struct(F.col("_e").alias("e"), F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("_c").alias("c")))) for name, is_ in mine.items()}
    return once.groupBy(*keys).agg(*(c.alias(k) for k, c in {**merged, **lists}.items()))


def own(c: Column) -> Column:
    """c for the first copy of a row in summed(), null for the others."""
    return F.when(F.col("_which").isNull(), c)


def exact_sum(rows: DataFrame, keys: tuple[str, ...], value: str, name: str = "sum") -> DataFrame:
    """The sum of a column of finite doubles in each group, rounded once. Partial sums merge: a hot group is no hot task."""
    out = summed(rows.select(*keys, value), keys, {name: [split(F.col(value))]}, {}, {})
    return out.withColumn(name, joined(F.col(name)))


def fraction_sum(values) -> float:
    """The sum of doubles, rounded once."""
    try:
        return math.fsum(values)
    except OverflowError:
        return float(sum(map(Fraction, values)))


def rank_parts(p: str) -> tuple[int, int]:
    """The percentage p ("95", "99.9") as a share parts/whole, exactly."""
    d = Decimal(p)
    if not 0 < d <= 100 or -d.as_tuple().exponent > 15:
        raise ValueError(f"no percentile: {p}")
    f = Fraction(d) / 100
    return f.numerator, f.denominator


def nearest_rank(n: Column, p: str) -> Column:
    """The place, from 1, of the p-th percentile among n sorted values."""
    parts, whole = rank_parts(p)
    return F.greatest(F.lit(1).cast("long"), F.expr("0") + F.floor((n * parts + (whole - 1)) / F.lit(whole)).cast("long"))
