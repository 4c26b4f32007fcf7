"""The graph's aggregates kept up to date: every table is mergeable, so any split of the events gives the rebuild's rows.

A column's first letters say how it merges: n_ and sum_ add up, lo_ and hi_ keep the least and the greatest. Sets of
pairs (style and order, person and style) are tables of their own, so distinct counts merge as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, rollups
from .runs import FAN, Runs

KEYS = {"styles": ["style_id"], "style_orders": ["style_id", "order_id"], "person_styles": ["person", "style_id"], "pairs": ["a", "b"], "categories": ["category"], "emails": ["email"]}
_MERGE = {"n_": F.sum, "sum_": F.sum, "lo_": F.min, "hi_": F.max}
#: Columns that tell events apart and order those of a day.
SEQ = ("order_id", "line", "factory_id")


def partials(events: DataFrame) -> dict[str, DataFrame]:
    """What a batch of events adds to each table."""
    one, late = F.count(F.lit(1)), F.when(F.col("delay_days") > 0, F.col("delay_days"))
    dated = F.when(F.col("date") != "", F.col("date"))
    newest = F.struct("date", *[(-F.col(c)).alias(f"before_{c}") for c in SEQ], "category")
    return {
        "styles": events.groupBy("style_id").agg(
            F.min(dated).alias("lo_date"), F.max(dated).alias("hi_date"), F.max(newest).alias("hi_newest"), one.alias("n_events"), F.count_if(F.col("delay_days") != 0).alias("n_delayed"),
            F.count_if(F.col("delay_days") > 0).alias("n_late"), F.coalesce(F.sum("delay_days"), F.lit(0)).alias("sum_delay"), F.coalesce(F.sum(late), F.lit(0)).alias("sum_late"),
        ),
        "style_orders": events.groupBy("style_id", "order_id").agg(one.alias("n_events")),
        "person_styles": rollups.person_style(events).withColumnRenamed("event_count", "n_events"),
        "pairs": rollups.pairs(events).withColumnRenamed("event_count", "n_events"),
        "categories": events.groupBy("category").agg(one.alias("n_events"), F.count_if(F.col("delay_days") != 0).alias("n_delayed"), F.count("delay_days").alias("n_known"), F.coalesce(F.sum("delay_days"), F.lit(0)).alias("sum_delay")),
        "emails": events.groupBy(F.col("order_id").alias("email")).agg(one.alias("n_events")),
    }


def merge(name: str, rows: DataFrame) -> DataFrame:
    """One row a key; events and rows in quarantine have no key and stay as they are."""
    if name not in KEYS:
        return rows
    how = lambda c: next(f for p, f in _MERGE.items() if c.startswith(p))
    return rows.groupBy(*KEYS[name]).agg(*[how(c)(c).alias(c) for c in rows.columns if c not in KEYS[name]])


# the tables as the rollups have them


def styles(state: dict[str, DataFrame]) -> DataFrame:
    orders = state["style_orders"].groupBy("style_id").agg(F.count(F.lit(1)).alias("order_count"))
    names = {"lo_date": "first_event_date", "hi_date": "last_update", "n_events": "event_count", "n_delayed": "delay_event_count", "n_late": "late_event_count", "sum_delay": "total_delay_days", "sum_late": "late_days"}
    return state["styles"].join(orders, "style_id").select("style_id", *[F.col(c).alias(n) for c, n in names.items()], F.col("hi_newest.category").alias("latest_category"), "order_count")


def people(state: dict[str, DataFrame]) -> DataFrame:
    return state["person_styles"].groupBy("person").agg(F.sum("n_events").alias("event_count"), F.count(F.lit(1)).alias("style_count"))


def collaborations(state: dict[str, DataFrame]) -> DataFrame:
    return rollups.with_common_styles(state["pairs"].withColumnRenamed("n_events", "event_count"), state["person_styles"].select("person", "style_id"))


def categories(state: dict[str, DataFrame]) -> DataFrame:
    mean = F.bround(F.try_divide("sum_delay", "n_known"), 2)
    return state["categories"].select("category", F.col("n_events").alias("event_count"), F.col("n_delayed").alias("delay_event_count"), mean.alias("avg_delay_days"))


def emails(state: dict[str, DataFrame]) -> DataFrame:
    return state["emails"].select("email", F.col("n_events").alias("event_count"))


#: What tables without a key are sorted by.
SORTED = {"events": ["style_id", "category", "date", *SEQ], "quarantine": ["batch", "reason"]}


def problem(events: DataFrame) -> Column:
    """Why an event cannot be applied as it is; null if it can. The first reason that holds is given."""
    dated = F.col("date").isNull() | (F.col("date") == "") | F.try_to_date("date", "yyyy-MM-dd").isNotNull()
    key = F.col("style_id").cast("string")
    checks = {"no mail": F.col("order_id").isNull(), "no category": F.col("category").isNull() | (F.col("category") == ""), "date": ~dated, "no style": key.isNull() | key.isin("", "UNKNOWN")}
    why = F.lit(None).cast("string")
    for name, failed in reversed(checks.items()):
        why = F.when(failed, name).otherwise(why)
    return why


class GraphState:
    """The graph's tables as runs in a folder (see Runs): what a batch reads and writes follows the batch, not the history.

    A batch is written once as it came, then parted: events that can be applied, and those that cannot, which go to a
    table `quarantine` with their batch and reason. Those without a style count for categories and mails all the same,
    which need none; those with any other reason count nowhere. A pointer with the batch's number, its runs and its
    counts is written last, so tables, quarantine and counts move together or not at all: a batch whose number the
    pointer has reached is passed over, one that failed before left nothing that the pointer knows, and a new object or
    driver goes on from the pointer.
    """

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.spark, self.path = spark, path
        self.runs = Runs(spark, path, KEYS | SORTED, merge, fan)
        self.pointer = self.runs.pointer

    def table(self, name: str) -> DataFrame | None:
        """A table as of the last batch. `follows` is read off the events, whose runs are sorted by style."""
        if name == "follows":
            return self.follows()
        return self.runs.read(name, self.pointer.read()[1])

    def tables(self) -> dict[str, DataFrame]:
        _, content = self.pointer.read()
        return {name: self.runs.read(name, content) for name in KEYS}

    def follows(self, style_ids: list | None = None) -> DataFrame:
        """Successors among the events, of some styles only if any are given: then only their part of each run is read."""
        ev = self.table("events")
        return graph.follows(ev if style_ids is None else ev.where(F.col("style_id").isin(list(style_ids))))

    def counts(self) -> dict[str, dict[str, int]]:
        """incoming, applied and quarantined, of the last batch and of all: applied and quarantined add up to incoming."""
        return self.pointer.read()[1].get("counts", {})

    def apply(self, events: DataFrame, batch_id: int) -> None:
        last, content = self.pointer.read()
        if batch_id <= last:
            return
        incoming = f"{self.path}/incoming/v={batch_id}"
        events.withColumn("reason", problem(events)).write.mode("overwrite").parquet(incoming)  # read once, whatever it takes to make the batch
        told = self.spark.read.parquet(incoming)
        row = told.agg(F.count(F.lit(1)).alias("n"), F.count("reason").alias("bad")).first()
        counts = {"incoming": row.n, "applied": row.n - row.bad, "quarantined": row.bad}
        good = told.where("reason IS NULL").drop("reason")
        counted = told.where("reason IS NULL OR reason = 'no style'").drop("reason")
        new = partials(good) | {k: v for k, v in partials(counted).items() if k in ("categories", "emails")}
        new |= {"events": good, "quarantine": told.where("reason IS NOT NULL").withColumn("batch", F.lit(batch_id).cast("long"))}
        content = self.runs.add(new, batch_id, content)
        total = content.get("counts", {}).get("all", {})
        content["counts"] = {"batch": counts, "all": {k: n + total.get(k, 0) for k, n in counts.items()}}
        self.pointer.write(batch_id, content)
        self.pointer.delete(incoming)

    def vacuum(self) -> list[str]:
        """Deletes what merged runs have replaced; for when no reader of an earlier batch is left."""
        return self.runs.vacuum(self.pointer.read()[1])

    def touched(self, events: DataFrame) -> DataFrame:
        """(label, key): the nodes that a batch changes."""
        pick = lambda label, c, rows: rows.select(F.lit(label).alias("label"), F.col(c).cast("string").alias("key"))
        found = pick("Style", "style_id", events).unionByName(pick("Person", "person", rollups.parties(events))).unionByName(pick("Category", "category", events)).unionByName(pick("Email", "order_id", events))
        return found.where("key IS NOT NULL").distinct()
