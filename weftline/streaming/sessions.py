"""Routing of the turns of many sessions: a turn that refers to `it` is about the style that its session last named.

In batch the session's style is carried by a window, on a stream by a state value of each session. Both read the same
features off a text and decide by the same rules, so they give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import lexicon as L
from ..functions import text as X

#: Turns of a session that one task carries a style through; blocks of so many are joined by their last styles.
BLOCK_TURNS = 10_000


def features(rows: DataFrame, session: str, turn: str, text: str) -> DataFrame:
    """(session, turn, own, refers, goes_on, greets, focus) of each turn; a null text says nothing."""
    t = F.coalesce(F.col(text), F.lit(""))
    return rows.select(
        F.col(session).cast("string").alias("session"), F.col(turn).cast("long").alias("turn"), X.first_style_id(t).alias("own"), X.any_of(t, L.PRONOUNS).alias("refers"),
        X.is_continuation(t).alias("goes_on"), X.any_of(F.lower(t), L.GREETINGS).alias("greets"), X.event_focus(t).alias("focus"),
    )


def decided(rows: DataFrame, intent: Column | None = None) -> DataFrame:
    """(session, turn, decision, intent, style_id, event_focus) of features with before, the session's style so far.

    `intent` takes a model's place in front of the rules: a column of the rows, null where the rules are to decide. A turn
    that asks for more keeps the session's style and its decision, whatever else it says.
    """
    style = F.coalesce("own", F.when(F.col("refers"), F.col("before")))
    late = F.col("focus") == "延期"
    rules = F.when(style.isNotNull() & late, "style_delay").when(style.isNotNull(), "style_timeline").when(F.col("greets"), "general_chat").otherwise("unknown")
    meant = rules if intent is None else F.coalesce(intent, rules)
    decision = F.when(meant == "general_chat", "direct_answer").when(meant.isin("style_timeline", "style_delay") & style.isNotNull(), "route_v1").otherwise("route_v2")
    more = F.col("goes_on")
    return rows.select(
        "session", "turn", F.when(more, "continuation").otherwise(decision).alias("decision"), F.when(more, "continuation").otherwise(meant).alias("intent"),
        F.when(more, F.col("before")).otherwise(style).alias("style_id"), F.when(~more, F.col("focus")).alias("event_focus"),
    )


def route_sessions(rows: DataFrame, session: str = "session", turn: str = "turn", text: str = "text", block: int = BLOCK_TURNS) -> DataFrame:
    """The routing of all turns, sessions in order of their turns (those without a session are one). A turn that asks for more names no style of its own.

    A style is carried through blocks of a session's turns, then from block to block, so no task holds a long session.
    Turns that repeat a number are in one block and see each other's styles in no set order.
    """
    found = features(rows, session, turn, text).withColumn("named", F.when(~F.col("goes_on"), F.col("own"))).withColumn("block", F.floor(F.col("turn") / block))
    every = found.groupBy("session", "block").agg(F.max_by("named", F.when(F.col("named").isNotNull(), F.col("turn"))).alias("last"))
    earlier = Window.partitionBy("session").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(F.col("session").alias("s"), F.col("block").alias("b"), F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    inside = Window.partitionBy("session", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    own = found.withColumn("inside", F.last("named", ignorenulls=True).over(inside))
    before = own.join(carried, own["session"].eqNullSafe(F.col("s")) & (own["block"] == F.col("b")))
    return decided(before.withColumn("before", F.coalesce("inside", "carried")))


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_FEATURES = ["session", "turn", "own", "refers", "goes_on", "greets", "focus"]
_CARRIED = StructType([StructField("session", StringType()), StructField("turn", LongType()), StructField("own", StringType()), StructField("refers", StringType()), StructField("goes_on", StringType()), StructField("greets", StringType()), StructField("focus", StringType()), StructField("before", StringType())])


class SessionStyle(StatefulProcessor):
    """Carries the style that a session last named from its turns to the next ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.style = handle.getValueState("style", "style string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("turn", kind="stable")
        style = self.style.get()[0] if self.style.exists() else None
        before = []
        for own, goes_on in zip(found["own"], found["goes_on"], strict=True):
            before.append(style)
            if goes_on != "true" and isinstance(own, str):
                style = own
        if style is not None:
            self.style.update((style,))
        yield found.assign(before=before)[[*_FEATURES, "before"]]

    def close(self) -> None:
        pass


def stream_sessions(spark: SparkSession, rows: DataFrame, path: str, session: str = "session", turn: str = "turn", text: str = "text") -> StreamingQuery:
    """Starts routing a stream of turns to Parquet files under path/out, with its checkpoint beside them, until no more
    is there. A session's turns are to come in order; its state is one style, whatever its length."""
    flags = ("refers", "goes_on", "greets")
    texts = features(rows, session, turn, text).withColumns({c: F.col(c).cast("string") for c in flags})
    carried = texts.groupBy("session").transformWithStateInPandas(SessionStyle(), _CARRIED, "Append", "None")
    out = decided(carried.withColumns({c: F.col(c).cast("boolean") for c in flags}))
    sink = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").outputMode("append").trigger(availableNow=True)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the one that has state values
    try:
        return sink.start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
