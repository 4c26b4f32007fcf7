"""How well the stores answer and how fresh they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ratios and the age beyond which somebody is told.
LEAST_HITS, LEAST_COVERAGE, MOST_AGE, MOST_FAILED = 0.8, 0.7, 30, 0.1


def monitoring(asked: DataFrame, events: DataFrame, processed: DataFrame, today: Column) -> DataFrame:
    """One row of hit_rate, coverage, age_days, failure_rate and alerts, from asked(style_id, results), events(style_id, date)
    and processed(n_events). A ratio over no rows is null and tells nobody; so is the age without events."""
    ratio = lambda ok: (F.count_if(ok) / F.nullif(F.count(F.lit(1)), F.lit(0)))
    known = events.select("style_id").distinct().withColumn("known", F.lit(True))
    cover = asked.where("style_id IS NOT NULL").select("style_id").join(known, "style_id", "left")
    age = F.datediff(today, F.try_to_date(F.max("date")))
    measures = {
        "hit_rate": asked.agg(ratio(F.col("results") > 0).alias("v")), "coverage": cover.agg(ratio(F.coalesce("known", F.lit(False))).alias("v")),
        "age_days": events.agg(age.cast("double").alias("v")), "failure_rate": processed.agg(ratio(F.coalesce("n_events", F.lit(0)) == 0).alias("v")),
    }
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(name).alias("name"), "v") for name, d in measures.items()])
    one = rows.agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in measures]).withColumn("age_days", F.col("age_days").cast("long"))
    alerts = [F.when(F.col("hit_rate") < LEAST_HITS, "hit_rate"), F.when(F.col("coverage") < LEAST_COVERAGE, "coverage"), F.when(F.col("age_days") > MOST_AGE, "age_days"), F.when(F.col("failure_rate") > MOST_FAILED, "failure_rate")]
    return one.withColumn("alerts", F.concat_ws(",", *alerts))


def mapped(factories: DataFrame, made_by: DataFrame, styles: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """factories(factory_id, name, style_count) and made_by(style_id, factory_id) after new(style_id, factory_id, name).

    Only styles that exist are mapped; each mapping of the new ones counts, also one that was there; of a factory's names
    the one it has stays, and a new one takes the least of those given.
    """
    known = new.join(styles.select("style_id").distinct(), "style_id", "left_semi")
    more = known.groupBy("factory_id").agg(F.count(F.lit(1)).alias("more"), F.min("name").alias("new_name"))
    after = factories.join(more, "factory_id", "full").select("factory_id", F.coalesce("name", "new_name").alias("name"), (F.coalesce("style_count", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("style_count"))
    return after, made_by.select("style_id", "factory_id").unionByName(known.select("style_id", "factory_id")).distinct()
