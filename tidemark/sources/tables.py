"""Tables of a folder, and the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels of events by name.
LEVELS = {"trace": 1, "debug": 2, "info": 4, "warn": 6, "error": 8, "fatal": 9}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples of a metric: at, value and the labels event_type and user."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("ts").alias("at"), "value", "event_type", F.col("user_id").cast("string").alias("user"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as records: at, stream, id, name, level, message, fields and context (JSON texts)."""
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", LEVELS["error"]).otherwise(LEVELS["info"])
    return e.select(
        F.col("ts").alias("at"), F.lit("events").alias("stream"), F.col("event_id").alias("id"), F.col("event_type").alias("name"), level.alias("level"),
        F.concat_ws(" ", F.lit("user"), "user_id", "event_type").alias("message"), F.col("props").alias("fields"), F.concat(F.lit('{"user": '), F.col("user_id"), F.lit("}")).alias("context"),
    )


def blob_listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder: path, size and time of change, in byte order of the path; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), "modificationTime").orderBy("path")


def listed(files: DataFrame, prefix: str = "", after: str | None = None, limit: int = 1000) -> DataFrame:
    """A page of a listing (path, size...) below a prefix, in the byte order of the path, after a path."""
    found = files.where(F.startswith("path", F.lit(prefix)))
    if after is not None:
        found = found.where(F.col("path") > after)
    return found.orderBy("path").limit(limit)


def usage(files: DataFrame, prefix: str = "") -> DataFrame:
    """How many files a listing has below a prefix, and their bytes."""
    return files.where(F.startswith("path", F.lit(prefix))).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size"))
