"""Incremental maintenance: every micro-batch is reduced to mergeable state, so a replay equals a rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import Runs

#: The state of a group: sums, extremes and the newest row, all of which merge in any order.
STATE = "user_id long, event_count long, total_value double, first_ts timestamp_ntz, last_ts timestamp_ntz, latest struct<ts:timestamp_ntz,neg_id:long,event_type:string>"


def partial(events: DataFrame) -> DataFrame:
    """One state a user from events(event_id, ts, user_id, event_type, value)."""
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum(F.col("value").cast("decimal(38,6)")).cast("double").alias("total_value"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max(F.struct("ts", (-F.col("event_id")).alias("neg_id"), "event_type")).alias("latest"),
    )


def merge(states: DataFrame) -> DataFrame:
    return states.groupBy("user_id").agg(F.sum("event_count").alias("event_count"), F.sum("total_value").alias("total_value"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max("latest").alias("latest"))


class StateTable:
    """A state of all users as runs in a folder (see Runs): a batch adds its own users' states, then a pointer with the
    batch's number. A batch whose number the pointer has reached is in the state and is passed over, so one that is tried
    again counts once, before the pointer moved or after; a new object or driver goes on from the pointer. Numbers must
    come from one sequence: a stream needs the same checkpoint for as long as its state lives."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.runs = Runs(spark, path, {"users": ["user_id"]}, lambda _, rows: merge(rows))
        self.pointer = self.runs.pointer

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        last, content = self.pointer.read()
        if batch_id <= last:
            return
        self.pointer.write(batch_id, self.runs.add({"users": partial(batch)}, batch_id, content))

    def read(self) -> DataFrame:
        found = self.runs.read("users", self.pointer.read()[1])
        return self.spark.createDataFrame([], STATE) if found is None else found


def replay(spark: SparkSession, source: str, schema, path: str, files_per_batch: int = 1) -> DataFrame:
    """Streams a folder of event files in micro-batches through the state table and returns the state. State and
    checkpoint lie side by side in path, so that a replay that was stopped goes on where it was, and counts new files only."""
    state = StateTable(spark, f"{path}/state")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(lambda df, n: state.apply(df, n)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return state.read()


def rollup(state: DataFrame) -> DataFrame:
    return state.select("user_id", "event_count", F.round("total_value", 4).alias("total_value"), F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"), F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"), F.col("latest.event_type").alias("latest_type"))


def windowed(events: DataFrame, size: str = "7 days", slide: str = "1 day") -> DataFrame:
    """An extension: counts in sliding event-time windows; on a stream a watermark bounds the state."""
    return events.groupBy(F.window("ts", size, slide), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
