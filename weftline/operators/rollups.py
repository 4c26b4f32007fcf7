"""Aggregates over the event table. Every one is a single aggregation whose partial results merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _newest(value: str, seq: tuple[str, ...]) -> Column:
    """value of the row with the greatest date; of equal dates the first in input order wins."""
    return F.max_by(F.col(value), F.struct("date", *[(-F.col(c)).alias(c) for c in seq]))


def style_rollup(events: DataFrame, seq: tuple[str, ...] = ("order_id", "line", "factory_id")) -> DataFrame:
    """A row a style. A delay counts if it is not zero, early ones too (delay_*); late_* count only positive ones."""
    dated = F.when(F.col("date") != "", F.col("date"))
    return events.groupBy("style_id").agg(
        F.min(dated).alias("first_event_date"),
        F.max(dated).alias("last_update"),
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col("delay_days") != 0).alias("delay_event_count"),
        F.count_if(F.col("delay_days") > 0).alias("late_event_count"),
        F.coalesce(F.sum("delay_days"), F.lit(0)).alias("total_delay_days"),
        F.coalesce(F.sum(F.when(F.col("delay_days") > 0, F.col("delay_days"))), F.lit(0)).alias("late_days"),
        _newest("category", seq).alias("latest_category"),
        F.countDistinct("order_id").alias("order_count"),
    )


def parties(events: DataFrame) -> DataFrame:
    """A row for each party slot of each event."""
    keep = [c for c in events.columns if c not in ("party_from", "party_to")]
    return events.select(*keep, F.explode(F.array(F.struct(F.col("party_from").alias("person"), F.lit("party_from").alias("role")), F.struct(F.col("party_to").alias("person"), F.lit("party_to").alias("role")))).alias("p")).select(*keep, "p.*").where(F.col("person").isNotNull() & (F.col("person") != ""))


def person_rollup(events: DataFrame) -> DataFrame:
    return parties(events).groupBy("person").agg(F.count(F.lit(1)).alias("event_count"), F.countDistinct("style_id").alias("style_count"))


def person_style(events: DataFrame) -> DataFrame:
    return parties(events).groupBy("person", "style_id").agg(F.count(F.lit(1)).alias("event_count"))


def category_rollup(events: DataFrame) -> DataFrame:
    late = F.when(F.col("delay_days") != 0, F.col("delay_days"))
    return events.groupBy("category").agg(F.count(F.lit(1)).alias("event_count"), F.count(late).alias("delay_event_count"), F.bround(F.avg("delay_days"), 2).alias("avg_delay_days"))


def email_rollup(events: DataFrame, source: str = "order_id") -> DataFrame:
    return events.groupBy(F.col(source).alias("email")).agg(F.count(F.lit(1)).alias("event_count"))


def factory_rollup(factories: DataFrame, style_factory: DataFrame, styles: DataFrame) -> DataFrame:
    """A row a factory, those without styles too: style_count from the mapping, sums from styles that exist."""
    sums = style_factory.join(styles, "style_id", "left").groupBy("factory_id").agg(F.count(F.lit(1)).alias("style_count"), F.coalesce(F.sum("total_delay_days"), F.lit(0)).alias("total_delay_days"), F.coalesce(F.sum("delay_event_count"), F.lit(0)).alias("delay_event_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return factories.join(sums, "factory_id", "left").select("factory_id", "name", zero("style_count"), zero("total_delay_days"), zero("delay_event_count"))


def department_members(factories: DataFrame) -> DataFrame:
    return factories.groupBy("dept_id").agg(F.count(F.lit(1)).alias("member_count"))


def customer_rollup(events: DataFrame) -> DataFrame:
    return events.groupBy("customer_id").agg(F.countDistinct("style_id").alias("style_count"), F.array_sort(F.collect_set("style_id")).alias("style_list"))


def pairs(events: DataFrame) -> DataFrame:
    """Unordered pairs of parties and their events together."""
    return events.where(F.col("party_from") != F.col("party_to")).select(F.least("party_from", "party_to").alias("a"), F.greatest("party_from", "party_to").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("event_count"))


#: Styles that one row of a person's set holds on average, at most.
SET_ROWS = 20_000


def with_common_styles(pairs: DataFrame, styles: DataFrame) -> DataFrame:
    """Both directions of each pair, with how many of (person, style_id) the two have in common.

    A person's styles travel as a set, not as rows, so a pair costs one intersection. Sets are dealt by the style's hash
    into as many parts as the largest needs, a number that comes from a table of one row. pairs(a, b, event_count).
    """
    parts = F.broadcast(styles.groupBy("person").agg(F.count(F.lit(1)).alias("n")).agg(F.greatest(F.ceil(F.max("n") / SET_ROWS), F.lit(1)).alias("parts")))
    part = F.pmod(F.xxhash64("style_id"), F.col("parts")).alias("part")
    sets = styles.join(parts, F.lit(True)).groupBy("person", part).agg(F.collect_set("style_id").alias("styles"))
    of = lambda side: sets.select(F.col("person").alias(side), "part", F.col("styles").alias(f"styles_{side}"))
    spread = pairs.join(parts, F.lit(True)).select("a", "b", "event_count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    met = spread.join(of("a"), ["a", "part"], "left").join(of("b"), ["b", "part"], "left")
    both = met.groupBy("a", "b").agg(F.first("event_count").alias("event_count"), F.sum(F.coalesce(F.array_size(F.array_intersect("styles_a", "styles_b")), F.lit(0))).alias("style_count"))
    return both.select(F.explode(F.array(F.struct(F.col("a").alias("person"), F.col("b").alias("other")), F.struct(F.col("b").alias("person"), F.col("a").alias("other")))).alias("p"), "event_count", "style_count").select("p.*", "event_count", "style_count")


def collaborations(events: DataFrame) -> DataFrame:
    """Both directions of each pair of parties: events together, and styles that both take part in anywhere."""
    return with_common_styles(pairs(events), person_style(events).select("person", "style_id"))


def collaborators_of(events: DataFrame, person: str) -> DataFrame:
    """(other, event_count, style_count): collaborations of one person. Only events of that person's styles are read on."""
    mine = events.where((F.col("party_from") == person) | (F.col("party_to") == person))
    own = pairs(mine)
    together = own.select(F.when(F.col("a") == person, F.col("b")).otherwise(F.col("a")).alias("other"), "event_count")
    styles = mine.select("style_id").distinct()
    shared = person_style(events.join(styles, "style_id", "left_semi")).select(F.col("person").alias("other"), "style_id")
    common = shared.join(together, "other", "left_semi").groupBy("other").agg(F.count(F.lit(1)).alias("style_count"))
    return together.join(common, "other", "left").select("other", "event_count", F.coalesce("style_count", F.lit(0)).alias("style_count"))


def tiers(events: DataFrame, passed: int = 70, review: int = 50) -> DataFrame:
    return events.withColumn("tier", F.when(F.col("confidence") >= passed, "passed").when(F.col("confidence") >= review, "review").otherwise("discarded"))


def processing_stats(events: DataFrame) -> DataFrame:
    return tiers(events).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("style_id").alias("styles"))


def funnel(rows: DataFrame, status: str = "status") -> DataFrame:
    """Rows and share of each status; the total comes from the counts, a row a status."""
    counts = rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(status, "n", F.bround(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1).alias("percent"))


def most_common(rows: DataFrame, value: str, k: int, seq: str) -> DataFrame:
    """Counts of values, commonest first, ties to the value that comes first."""
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first_seq")).orderBy(F.col("n").desc(), "first_seq").limit(k)


def overview_summary(events: DataFrame) -> DataFrame:
    """A row a style: counts by category as a sorted text, first and last date, late events and days."""
    by = events.groupBy("style_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"), F.count_if(F.col("delay_days") > 0).alias("late"), F.coalesce(F.sum(F.when(F.col("delay_days") > 0, F.col("delay_days"))), F.lit(0)).alias("days"))
    return by.groupBy("style_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "category", "n"))), ",").alias("by_category"), F.sum("n").alias("total_events"), F.min("lo").alias("first_date"), F.max("hi").alias("last_date"), F.sum("late").alias("late_events"), F.sum("days").alias("late_days"))


def usage_rates(rows: DataFrame, group: str, flags: list[str]) -> DataFrame:
    """Rows of a group and the share of each flag, null-safe."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.coalesce(F.col(f).cast("double"), F.lit(0.0))).alias(f"{f}_rate") for f in flags])
