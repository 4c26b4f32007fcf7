"""Batches of mails against a plain version of their statuses and ids; choices of parameters; what refers to what."""

import re
from datetime import date

from pyspark.sql import functions as F

from weftline.functions import dialogue as D
from weftline.functions import lexicon as L
from weftline.operators import health as H
from weftline.operators import mail_job as J
from weftline.operators import questions as K

LONG = "the fabric of this style is late and we have to confirm the delivery of it again"
MAILS = [
    ("a", f"CCSS230021 {LONG} order 654321 款号INDOA1234", "Re: 7654321 fabric", "Fri, 5 Jan 2024 10:00:00 +0800", None), ("b", "too short", "x", "", None), ("c", "", "CCSS230021", None, "broken"), ("d", None, None, None, None),
    ("e", f"{LONG}\nBest regards\nTel: 1234567", None, "no date", None), ("f", f"ccss230021 {LONG} 010125", "", "2024-03-02", None),
]
SCHEMA = "filename string, content string, subject string, date string, error string"


def plain(content, subject):
    styles = {x for text in (content, subject) for p in L.STYLE_PATTERNS for x in re.findall(p, text.upper())}
    numbers = {x for text in (content, subject) for n in (6, 7, 8, 9) for x in re.findall(rf"\b[0-9]{{{n}}}\b", text)}
    return sorted(styles), sorted(x for x in numbers if not (len(x) == 6 and int(x[:2]) <= 12 and int(x[2:4]) <= 31))


def test_batches(spark, tmp_path):
    mails = spark.createDataFrame(MAILS, SCHEMA)
    at = f"{tmp_path}/records"
    first = J.run_batch(spark, mails.where("filename in ('a', 'b')"), at, first=True)
    assert {r.filename for r in first.collect()} == {"a", "b"}
    got = {r.filename: r for r in J.run_batch(spark, mails, at).collect()}
    assert len(got) == 6 and J.run_batch(spark, mails, at).count() == 6  # nothing is done twice
    assert {k: v.status for k, v in got.items()} == {"a": "success", "b": "skipped", "c": "error", "d": "error", "e": "success", "f": "success"}
    assert (got["b"].reason, got["c"].reason, got["d"].reason) == ("content_too_short_after_cleaning", "broken", "empty_content")
    for name, content, subject, *_ in MAILS:
        if got[name].status == "success":
            body = content.split("\nBest regards")[0]
            assert (got[name].style_ids, got[name].order_ids) == plain(body, subject or ""), name
            assert got[name].events_count == len(got[name].events) == len(got[name].style_ids)
    assert got["a"].email_date == "2024-01-05" and got["e"].email_date == "" and got["f"].events[0].style_id == "CCSS230021"
    told = {r.status: (r.n, r.events) for r in J.statistics(J.run_batch(spark, mails, at)).collect()}
    assert told == {"success": (3, got["a"].events_count + 1), "error": (2, 0), "skipped": (1, 0)}


def test_no_mails(spark, tmp_path):
    assert J.run_batch(spark, spark.createDataFrame([], SCHEMA), f"{tmp_path}/none", first=True).count() == 0


def test_conditions(spark):
    keys = spark.range(400).select(F.col("id").cast("string").alias("k"))
    rows = keys.select(K.conditions(F.col("k")).alias("c"), K.conditions(F.col("k"), always=True).alias("a")).collect()
    assert 120 < sum(r.c.categories is None for r in rows) < 280 and 120 < sum(r.c.min_delay_days is None for r in rows) < 280
    assert {len(r.a.categories) for r in rows} == {1, 2, 3} and all(len(set(r.a.categories)) == len(r.a.categories) and set(r.a.categories) <= set(K.STAGES) for r in rows)
    assert {r.c.min_delay_days for r in rows} == {None, *K.DELAYS}


def test_references(spark):
    one = spark.createDataFrame([("第2个延期吗", ["A", "B"]), ("第3个呢", ["A", "B"]), ("这些款号", ["A", "B"]), ("这款", []), ("这款", None), (None, ["A"]), ("该款号呢", ["A$1", "B$2"])], "t string, r array<string>")
    got = [r[0] for r in one.select(D.rewritten(F.col("t"), F.col("r"))).collect()]
    assert got == ["B延期吗", "第3个呢", "A, B", "这款", "这款", None, "B$2呢"]


def test_monitoring_of_nothing(spark):
    none = lambda s: spark.createDataFrame([], s)
    row = H.monitoring(none("style_id long, results int"), none("style_id long, date string"), none("n_events long"), F.lit(date(2024, 1, 1))).first()
    assert (row.hit_rate, row.coverage, row.age_days, row.failure_rate, row.alerts) == (None, None, None, None, "")


def test_augmentation(spark):
    event = "array<struct<id:bigint,delay_days:int>>"
    rows = spark.createDataFrame([(1, "p", "a", [(1, 3), (2, 0)]), (1, "p", "a", [(1, 3)]), (2, "p", "a", [(1, 3)]), (2, "q", "b", None), (3, None, None, [])], f"s long, p string, a string, e {event}")
    got = {r.s: tuple(r)[1:] for r in K.augmentation(rows, "s", "p", "a", "e").collect()}
    assert got == {1: (2, 1, True, True), 2: (2, 2, False, False), 3: (1, 0, True, True)}
