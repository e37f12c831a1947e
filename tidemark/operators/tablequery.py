"""A composable query over tables: joins, groups, nested top-N lists, keyset pages, updates and upserts."""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import date, datetime
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F


class Refused(ValueError):
    """A query that has no answer as it is put."""


def eq(column: str, value) -> Column:
    return F.col(column).isNull() if value is None else F.col(column) == F.lit(value)


def is_in(column: str, values: list) -> Column:
    return F.col(column).isin(*values) if values else F.lit(False)


def either(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def every(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def has(column: str, value) -> Column:
    """A JSON list holds a value."""
    kind = {bool: "boolean", int: "bigint", float: "double", str: "string"}[type(value)]
    return F.coalesce(F.array_contains(F.from_json(F.col(column), f"array<{kind}>"), F.lit(value)), F.lit(False))


# --- pieces of SQL texts -----------------------------------------------------------------------------


def ident(name: str) -> str:
    """A name as it stands in a text, whatever signs it has."""
    if not name or "\0" in name:
        raise Refused(f"no name: {name!r}")
    return "`" + name.replace("`", "``") + "`"


def value(v) -> Column:
    """A bound value."""
    return F.lit(None) if v is None else F.lit(v)


def listed(column: str, json_list: str, kind: str = "string") -> Column:
    """Whether a column's value is in a JSON list; null is in none."""
    return F.coalesce(F.array_contains(F.from_json(F.lit(json_list), f"array<{kind}>"), F.col(column)), F.lit(False))


def json_value(v) -> Column:
    """A value as a JSON text: keys in their order, no blanks."""
    return F.lit(json.dumps(v, separators=(",", ":"), ensure_ascii=False))


def bound(spark: SparkSession, text: str, *values, **tables: DataFrame) -> DataFrame:
    """A SQL text over tables, with its ? bound to values in order; as many values as there are ?."""
    plain = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*", "", text)
    if plain.count("?") != len(values):
        raise Refused(f"{plain.count('?')} places and {len(values)} values")
    return spark.sql(text, args=list(values) if values else None, **tables)


# --- queries -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TableQuery:
    df: DataFrame
    name: str = "t"
    shape: tuple = ()
    picked: tuple[str, ...] = ()
    grouped: tuple[str, ...] = ()
    having_: tuple[Column, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    limit_: int | None = None
    offset_: int | None = None
    filters: tuple[Column, ...] = ()
    joined: bool = False
    joins: tuple[tuple[str, str, str], ...] = ()

    @staticmethod
    def table(df: DataFrame, name: str = "t") -> TableQuery:
        return TableQuery(df.alias(name), name)

    def filter(self, condition: Column | str) -> TableQuery:
        return replace(self, filters=(*self.filters, F.expr(condition) if isinstance(condition, str) else condition))

    def _join(self, other: DataFrame, name: str, on: str, how: str) -> TableQuery:
        return replace(self, df=self.df.join(other.alias(name), F.expr(on), how), joined=True, joins=(*self.joins, (name, on, how)))

    def join(self, other: DataFrame, name: str, on: str) -> TableQuery:
        return self._join(other, name, on, "inner")

    def left_join(self, other: DataFrame, name: str, on: str) -> TableQuery:
        return self._join(other, name, on, "left")

    def right_join(self, other: DataFrame, name: str, on: str) -> TableQuery:
        return self._join(other, name, on, "right")

    def full_join(self, other: DataFrame, name: str, on: str) -> TableQuery:
        return self._join(other, name, on, "full")

    def anti_join(self, other: DataFrame, name: str, on: str) -> TableQuery:
        return self._join(other, name, on, "left_anti")

    def cross_join(self, other: DataFrame, name: str, most: int = 10_000) -> TableQuery:
        """Each row with every row of other, which has most rows at most (counted first, and sent to every task)."""
        if other.limit(most + 1).count() > most:
            raise Refused(f"a cross join with more than {most} rows")
        return replace(self, df=self.df.crossJoin(F.broadcast(other.alias(name))), joined=True, joins=(*self.joins, (name, "", "cross")))

    def semi_join(self, other: DataFrame, name: str, on: str) -> TableQuery:
        return self._join(other, name, on, "left_semi")

    def select(self, *columns: str) -> TableQuery:
        return replace(self, picked=columns)

    def group_by(self, *columns: str) -> TableQuery:
        return replace(self, grouped=columns)

    def having(self, condition: str) -> TableQuery:
        if not self.grouped:
            raise Refused("having needs a group")
        return replace(self, having_=(*self.having_, F.expr(condition)))

    def order_by(self, column: str, descending: bool = False) -> TableQuery:
        """Nulls come first ascending, last descending."""
        return replace(self, order=(*self.order, (column, descending)))

    def limit(self, n: int) -> TableQuery:
        return replace(self, limit_=n)

    def offset(self, n: int) -> TableQuery:
        return replace(self, offset_=n)

    # -- answers

    def _rows(self) -> DataFrame:
        df = self.df
        for c in self.filters:
            df = df.where(c)
        if self.grouped:
            keys = [c.rpartition(".")[2] for c in self.grouped]
            aggs = [c for c in self.picked if c not in self.grouped and c not in keys]
            df = df.groupBy(*self.grouped).agg(*(F.expr(a) for a in aggs))
            for c in self.having_:
                df = df.where(c)
            return df
        return df

    def rows(self) -> DataFrame:
        df = self._rows()
        if self.order:
            df = df.orderBy(*(F.col(c).desc() if d else F.col(c).asc() for c, d in self.order))
        if not self.grouped:
            if self.picked:
                df = df.selectExpr(*self.picked)
            elif self.joined:
                df = df.select(f"{self.name}.*")
        if self.offset_:
            df = df.offset(self.offset_)
        return df.limit(self.limit_) if self.limit_ is not None else df

    def count(self) -> DataFrame:
        """Rows, or groups where rows are grouped; order and limit don't matter."""
        df = self._rows()
        return df.agg(F.count("*").alias("count"))

    def include(self, children: TableQuery, on: tuple[str, str], name: str) -> DataFrame:
        """Each row with a list of its first children, [] without any; children must pick columns and have a limit."""
        if not children.picked or children.limit_ is None:
            raise Refused("an include needs a select and a limit")
        parent, child = on
        w = Window.partitionBy(child).orderBy(*(F.col(c).desc() if d else F.col(c).asc() for c, d in children.order))
        kids = children._rows().withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= children.limit_)
        item = F.struct("_rank", *(F.expr(p) for p in children.picked))
        lists = kids.groupBy(F.col(child).alias("_key")).agg(F.sort_array(F.collect_list(item)).alias("_list"))  # at most the limit for each
        out = self.rows().join(lists, F.col(parent) == F.col("_key"), "left")
        plain = F.transform("_list", lambda x: F.struct(*(x[_name(p)].alias(_name(p)) for p in children.picked)))
        return out.withColumn(name, F.coalesce(plain, F.filter(plain, lambda x: F.lit(False)), F.array().cast(f"array<{_struct(kids, children.picked)}>"))).drop("_key", "_list")

    # -- pages

    def _digest(self) -> str:
        """A name for what is asked: the table, its joins, conditions, groups, columns and order."""
        said = (self.name, self.joins, [str(c) for c in self.filters], self.grouped, [str(c) for c in self.having_], self.order, self.picked)
        return hashlib.sha256(repr(said).encode()).hexdigest()[:16]

    def page(self, limit: int, after: str | None = None) -> tuple[DataFrame, "TableQuery"]:
        """Rows after a cursor, by the order columns: no offset is walked, and nulls keep their place."""
        if not self.order:
            raise Refused("a page needs order columns")
        q = self
        if after:
            said = json.loads(base64.urlsafe_b64decode(after))
            if said["q"] != self._digest():
                raise Refused("a cursor of another query")
            q = q.filter(beyond(self.order, [_read(v) for v in said["v"]]))
        return q.limit(limit).rows(), q

    def cursor(self, row: dict) -> str:
        return base64.urlsafe_b64encode(json.dumps({"q": self._digest(), "v": [_said(row[c.rpartition(".")[2]]) for c, _ in self.order]}).encode()).decode()

    def list(self, limit: int, after: str | None = None) -> tuple[list[Row], str | None]:
        """The rows of a page, and where the next one begins: only a full page has a next."""
        rows = self.page(limit, after)[0].collect()  # limit rows at most
        return rows, self.cursor(rows[-1].asDict()) if rows and len(rows) == limit else None

    def each(self) -> Iterator[Row]:
        """The rows one by one; the driver holds one partition at a time."""
        return self.rows().toLocalIterator(prefetchPartitions=True)

    def columns(self) -> pa.Table:
        """The answer by columns, typed, with nulls marked."""
        return self.rows().toArrow()

    # -- writes: the table as it is afterwards

    def _plain(self) -> Column:
        if not self.filters:
            raise Refused("a write needs a condition")
        if self.order or self.limit_ is not None or self.offset_ or self.grouped or self.joined:
            raise Refused("a write takes conditions only")
        return F.coalesce(every(*self.filters), F.lit(False))

    def update(self, **values) -> DataFrame:
        hit = self._plain()
        changed = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
        return self.df.select(*(F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in self.df.columns))

    def delete(self) -> DataFrame:
        return self.df.where(~self._plain())

    def upsert(self, new: DataFrame, keys: list[str], only_if: str | None = None) -> DataFrame:
        """Rows of new replace those of their key, where only_if holds for the old row (`old`) and the new one (`new`)."""
        n = new.alias("new").withColumn("_new", F.lit(True)).alias("new")
        o = self.df.alias("old").withColumn("_old", F.lit(True)).alias("old")
        both = o.join(n, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys], "full")
        take = F.col("new._new").isNotNull() & (F.col("old._old").isNull() | (F.expr(only_if) if only_if else F.lit(True)))
        return both.select(*(F.when(take, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in self.df.columns))


def _said(v) -> list:
    """A value of a cursor as JSON, with its type."""
    if isinstance(v, datetime):
        return ["datetime", v.isoformat()]
    if isinstance(v, date):
        return ["date", v.isoformat()]
    if isinstance(v, Decimal):
        return ["decimal", str(v)]
    if isinstance(v, (bytes, bytearray)):
        return ["bytes", bytes(v).hex()]
    if isinstance(v, float):
        return ["float", v.hex()]
    return ["", v]


_READ = {"datetime": datetime.fromisoformat, "date": date.fromisoformat, "decimal": Decimal, "bytes": bytes.fromhex, "float": float.fromhex, "": lambda v: v}


def _read(said: list):
    kind, v = said
    return _READ[kind](v)


def _name(picked: str) -> str:
    return picked.split(" as ")[-1].rpartition(".")[2].strip()


def _struct(df: DataFrame, picked: tuple[str, ...]) -> str:
    return df.select(F.struct(*(F.expr(p) for p in picked)).alias("x")).schema["x"].dataType.simpleString()


def beyond(order: tuple[tuple[str, bool], ...], values: list) -> Column:
    """The rows that come after the place of these values."""
    out, equal = F.lit(False), F.lit(True)
    for (c, descending), v in zip(order, values):
        col = F.col(c)
        if v is None:
            after = F.lit(False) if descending else col.isNotNull()
            same = col.isNull()
        else:
            after = (col < F.lit(v)) | col.isNull() if descending else col > F.lit(v)
            same = F.coalesce(col == F.lit(v), F.lit(False))
        out = out | (equal & F.coalesce(after, F.lit(False)))
        equal = equal & same
    return out


def one(df: DataFrame):
    """The only row: two rows are no answer."""
    rows = df.take(2)
    if len(rows) > 1:
        raise Refused("more than one row")
    return rows[0] if rows else None


def scalar(df: DataFrame):
    row = one(df)
    if row is None or len(row) != 1:
        raise Refused("not one value")
    return row[0]
