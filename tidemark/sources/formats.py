"""Text sources: Prometheus and OpenMetrics expositions, logfmt, JSON lines and plain lines."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SAMPLE = re.compile(r'([A-Za-z_:][\w:]*)\s*(?:\{(.*?)\}(?=\s))?\s*(\S+)(?:\s+(-?[\d.]+))?\s*(?:#.*)?$')
_LABEL = re.compile(r'\s*([A-Za-z_]\w*)\s*=\s*"((?:[^"\\]|\\.)*)"\s*(?:,|$)')
_PAIR = re.compile(r'([^\s=]+)=(?:"((?:[^"\\]|\\.)*)"|(\S*))')
#: Level names and their numbers; the first that a line holds as a word counts.
LEVELS = {"trace": 1, "debug": 2, "info": 4, "notice": 5, "warn": 6, "warning": 6, "error": 8, "err": 8, "fatal": 9, "critical": 9, "panic": 9}
_LEVEL = re.compile(r"(?i)\b(" + "|".join(LEVELS) + r")\b")


class BadLine(ValueError):
    """An exposition that is refused as a whole; names the line."""


def exposition(text: str, at: int, openmetrics: bool = False) -> list[tuple]:
    """(name, kind, labels, time in ms, value) of a whole text; seconds count in OpenMetrics, ms else."""
    kinds: dict[str, str] = {}
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        line = line.strip()
        if not line or line == "# EOF":
            continue
        if line.startswith("#"):
            part = line.split(None, 3)
            if len(part) == 4 and part[1] == "TYPE":
                kinds[part[2]] = part[3]
            continue
        m = _SAMPLE.match(line)
        if not m:
            raise BadLine(f"line {n}: no sample")
        labels, rest = {}, m[2] or ""
        while rest:
            x = _LABEL.match(rest)
            if not x:
                raise BadLine(f"line {n}: bad labels")
            labels[x[1]] = re.sub(r"\\(.)", lambda c: "\n" if c[1] == "n" else c[1], x[2])
            rest = rest[x.end() :]
        try:
            value = float(m[3].replace("Inf", "inf"))
        except ValueError:
            raise BadLine(f"line {n}: no number") from None
        time = at if m[4] is None else round(float(m[4]) * (1000 if openmetrics else 1))
        family = next((f for f in (m[1], *(m[1].removesuffix(s) for s in ("_total", "_bucket", "_count", "_sum"))) if f in kinds), m[1])
        kind = kinds.get(family, "gauge")
        out.append((m[1], "counter" if kind in ("counter", "histogram", "summary") and m[1] != family or kind == "counter" else "gauge", labels, time, value))
    return out


def prometheus(files: DataFrame, at: int) -> DataFrame:
    """Samples of expositions (value: whole texts). A bad text fails the query, naming the line."""

    def run(batches):
        for pdf in batches:
            rows = [r for text in pdf["value"] for r in exposition(text, at)]
            yield pd.DataFrame(rows, columns=["name", "kind", "labels", "at_ms", "value"])

    return files.select("value").mapInPandas(run, "name string, kind string, labels map<string,string>, at_ms long, value double")


def logfmt(line: str) -> dict[str, str]:
    return {m[1]: re.sub(r"\\(.)", r"\1", m[2]) if m[2] is not None else m[3] for m in _PAIR.finditer(line)}


def event_of(line: str) -> dict:
    """One line as an event: JSON objects, logfmt (two pairs at least), or text; its level and message."""
    fields, message = {}, line
    try:
        said = json.loads(line)
    except ValueError:
        said = None
    if isinstance(said, dict):
        fields = said
        message = str(said.get("message", said.get("msg", line)))
    elif len(pairs := logfmt(line)) >= 2:
        fields = pairs
        message = pairs.get("msg", pairs.get("message", line))
    level = str(fields.get("level", "")).lower()
    number = LEVELS.get(level)
    if number is None and (m := _LEVEL.search(message)):
        number = LEVELS[m[1].lower()]
    return {"level": number, "message": message, "fields": json.dumps(fields)}


def lines(df: DataFrame) -> DataFrame:
    """Events of text lines (value)."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([event_of(x or "") for x in pdf["value"]], columns=["level", "message", "fields"]).astype({"level": "Int64"})

    return df.select("value").mapInPandas(run, "level long, message string, fields string")


#: Lines of one event at most, and lines of a file that are numbered in one task.
MOST_JOINED, BLOCK = 1000, 65_536
#: Lines that go on with the event before them.
_GOES_ON = r"^(?:[ \t]|Caused by: |Traceback \(most recent call last\):|goroutine |[A-Za-z_][\w.$]*(?:Error|Exception|Warning)(?::|$))"


def joined(numbered: DataFrame) -> DataFrame:
    """Lines (source, n dense from 0, value) with the lines of a stack trace or traceback joined: source, n of the first, value.

    The first line of each line's event is a running maximum: within blocks of lines, then over one row for each
    block, so that no task holds a whole file. A null line counts as empty.
    """
    value = F.coalesce("value", F.lit(""))
    starts = F.when(~value.rlike(_GOES_ON) | (F.col("n") == 0), F.col("n"))
    rows = numbered.select("source", "n", value.alias("value"), starts.alias("_start"), F.floor(F.col("n") / BLOCK).alias("_block"))
    blocks = rows.groupBy("source", "_block").agg(F.max("_start").alias("_last"))
    before = blocks.select("source", "_block", F.max("_last").over(Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    inside = F.max("_start").over(Window.partitionBy("source", "_block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    led = rows.withColumn("_lead", inside).join(before, ["source", "_block"]).withColumn("_lead", F.coalesce("_lead", "_carried"))
    led = led.withColumn("_lead", F.col("_lead") + F.floor((F.col("n") - F.col("_lead")) / MOST_JOINED) * MOST_JOINED)
    parts = led.groupBy("source", F.col("_lead").alias("n")).agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("_lines"))  # MOST_JOINED lines at most
    return parts.select("source", "n", F.array_join(F.transform("_lines", lambda x: x["value"]), "\n").alias("value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark.read.text(path).select(F.col("value")))
