"""Mails to records of events, in batches that go on where the last one ended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Shortest text worth reading, what a mail's events are given, and the fields of a record.
SHORTEST = 50
EVENTS = "array<struct<style_id:string,order_ids:string,category:string,date:string,description:string>>"
RECORD = f"filename string, status string, reason string, subject string, email_date string, style_ids array<string>, order_ids array<string>, events_count long, events {EVENTS}"


def rule_events(content: Column, styles: Column, orders: Column, date: Column, subject: Column) -> Column:
    """Events without a model: one a style, of the category that the text speaks of most."""
    made = lambda s: F.struct(s.alias("style_id"), F.array_join(orders, ",").alias("order_ids"), X.classify_category(content).alias("category"), date.alias("date"), subject.alias("description"))
    return F.transform(styles, made).cast(EVENTS)


def records(mails: DataFrame, extract=rule_events) -> DataFrame:
    """A record a mail(filename, content, subject, date, error): error (no text), skipped (too short once noise is gone) or
    success with its ids and events. `extract` is any expression of (content, styles, orders, date, subject)."""
    raw = mails.select("filename", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("subject", F.lit("")).alias("subject"), "date", "error")
    seen = raw.withColumn("clean", X.remove_noise(F.col("content")))
    ids = lambda f: F.array_sort(F.array_union(f(F.col("clean")), f(F.col("subject"))))
    status = F.when(F.col("content") == "", "error").when(F.length("clean") < SHORTEST, "skipped").otherwise("success")
    reason = F.when(F.col("status") == "error", F.coalesce("error", F.lit("empty_content"))).when(F.col("status") == "skipped", "content_too_short_after_cleaning")
    found = seen.withColumn("status", status).withColumn("style_ids", ids(X.style_ids)).withColumn("order_ids", ids(X.order_ids)).withColumn("email_date", F.coalesce(X.parse_date(F.col("date")), F.lit("")))
    ok = F.col("status") == "success"
    events = F.coalesce(F.when(ok, extract(F.col("clean"), F.col("style_ids"), F.col("order_ids"), F.col("email_date"), F.col("subject"))), F.array().cast(EVENTS))
    out = found.select("filename", "status", reason.alias("reason"), "subject", F.when(ok, F.col("email_date")).alias("email_date"), F.when(ok, F.col("style_ids")).alias("style_ids"), F.when(ok, F.col("order_ids")).alias("order_ids"), events.alias("events"))
    return out.withColumn("events_count", F.size("events").cast("long"))


def run_batch(spark: SparkSession, mails: DataFrame, path: str, first: bool = False) -> DataFrame:
    """Records of the mails that path has none of yet, appended to it as lines of JSON; gives all records that path has.

    A batch that is lost before its files are committed leaves nothing, and the next one reads its mails again. `first`
    says that there is no earlier batch.
    """
    todo = mails if first else mails.join(spark.read.schema(RECORD).json(path).select("filename").distinct(), "filename", "left_anti")
    records(todo).write.mode("append").json(path)
    return spark.read.schema(RECORD).json(path)


def statistics(done: DataFrame) -> DataFrame:
    """(status, n, events) of records."""
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("events_count"), F.lit(0)).alias("events"))
