"""Streams: tumbling windows, late rows, and rows that are seen once. Each query runs what is available and ends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's files as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # A glob takes a file as well as a folder.
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def run_once(df: DataFrame, mode: str, name: str, notes: str | None = None) -> DataFrame:
    """The stream's result: in complete mode the last table, in append mode all rows, kept in the shared folder.

    notes: the folder by which a later run goes on where this one ended; without it each run begins anew.
    """
    spark = df.sparkSession
    out, notes = shared_path(spark, name), notes or shared_path(spark, f"{name}-notes")

    seen: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        seen.append(number)
        if mode == "complete":
            batch.write.mode("overwrite").parquet(out)
        else:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # again after a failure: the same place

    schema = df.schema
    query = df.writeStream.outputMode(mode).option("checkpointLocation", notes).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if mode == "append" and not seen:  # nothing has come
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out) if mode == "complete" else spark.read.parquet(out).select(*schema.names)


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Counts by window and keys."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = timed.groupBy(F.window("_t", width).alias("w"), *keys).agg(F.count("*").alias("events"))
    return out.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("bucket"), "events")


def seen_once(events: DataFrame, keys: list[str], time: str, within: str = "1 hour") -> DataFrame:
    """Rows whose keys were not seen within the watermark."""
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", within).dropDuplicatesWithinWatermark(keys).drop("_t")


def late_rows(events: DataFrame, held: DataFrame, time: str, late: str) -> tuple[DataFrame, DataFrame]:
    """(in time, too late): rows behind the newest time held less the lateness allowed."""
    edge = held.agg(F.max(time).alias("_edge"))
    both = events.join(F.broadcast(edge)).withColumn("_late", F.coalesce(F.col(time) < F.col("_edge") - F.expr(f"interval {late}"), F.lit(False)))
    return both.where("NOT _late").drop("_edge", "_late"), both.where("_late").drop("_edge", "_late")


def poll(events: DataFrame, notes: str, name: str = "poll") -> DataFrame:
    """The events that came since the last poll with the same notes, each once; the notes are the cursor, and survive a restart."""
    return run_once(events, "append", name, notes)


def tail(events: DataFrame, arrived: str, opened: str, kept_from: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the events that arrived after a reader opened, what it missed): missed are those that retention took before they were read."""
    after = events.where(F.col(arrived) > F.lit(opened).cast("timestamp_ntz"))
    if kept_from is None:
        return after, after.limit(0).agg(F.count("*").alias("missed"))
    gone = F.col(arrived) < F.lit(kept_from).cast("timestamp_ntz")
    return after.where(~gone), after.where(gone).agg(F.count("*").alias("missed"))


def rate_limited(events: DataFrame, key: str, time: str, interval_us: int, burst: int, late: str = "1 hour") -> DataFrame:
    """A stream's requests under a rate of one in interval_us with a burst: key, time, allowed, left.

    Requests of a batch are taken in the order of time. A key's state goes when the watermark has passed the time it is
    due at: from then on it says what no state says.
    """

    def run(k, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        due = state.get[0] if state.exists else -(2**62)
        whole = pd.concat(list(batches)).sort_values(time, kind="stable")
        allowed, left = [], []
        for now in whole[time].astype("datetime64[us]").astype("int64"):
            new = max(due, int(now)) + interval_us
            room = int(now) + burst * interval_us - new
            allowed.append(room >= 0)
            left.append(max(0, room) // interval_us)
            due = new if room >= 0 else due
        state.update((due,))
        if (ends := due // 1000 + 1) > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(ends)
        else:
            state.remove()
        yield pd.DataFrame({key: k[0], time: whole[time], "allowed": allowed, "left": left})

    kinds = {f.name: f.dataType.simpleString() for f in events.select(key, time).schema.fields}
    rows = events.select(key, F.col(time).cast("timestamp").alias(time)).withWatermark(time, late)
    out = rows.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {time} timestamp, allowed boolean, left long", "due long", "append", "EventTimeTimeout")
    return out.withColumn(time, F.col(time).cast("timestamp_ntz"))
