"""The hand-computed fixture: eight events, and what every operator must make of them."""

import pytest

from weftline.operators import graph as G
from weftline.operators import rollups as A
from weftline.operators import shaping as O

ROWS = [
    (0, "S1", "O1", "面料", "提交", "2024-01-05", 0, "Ann", "Bob", 95, "m1"),
    (1, "S1", "O1", "面料", "确认", "2024-01-12", 2, "Bob", "Ann", 90, "m1"),
    (2, "S1", "O2", "封样", "提交", "2024-01-12", None, "Ann", None, 80, "m2"),
    (3, "S2", "O2", "面料", "提交", "2024-01-03", -1, "Ann", "Bob", 70, "m2"),
    (7, "S2", "O2", "面料", "确认", "2024-01-20", 10, "Ann", "Bob", 50, "m4"),
]


@pytest.fixture(scope="module")
def ev(spark):
    return spark.createDataFrame(ROWS, "seq long, style_id string, order_id string, category string, event_type string, date string, delay_days long, party_from string, party_to string, confidence long, file string").cache()


def test_style_rollup(ev):
    rows = {r.style_id: r for r in A.style_rollup(ev.where("confidence >= 70"), ("seq",)).collect()}
    s1, s2 = rows["S1"], rows["S2"]
    assert (s1.first_event_date, s1.last_update, s1.event_count, s1.delay_event_count, s1.total_delay_days, s1.latest_category) == ("2024-01-05", "2024-01-12", 3, 1, 2, "面料")
    assert (s2.event_count, s2.delay_event_count, s2.total_delay_days) == (1, 1, -1)


def test_people(ev):
    passed = ev.where("confidence >= 70")
    assert {(r.person, r.event_count, r.style_count) for r in A.person_rollup(passed).collect()} == {("Ann", 4, 2), ("Bob", 3, 2)}
    assert {(r.person, r.style_id, r.event_count) for r in A.person_style(passed).collect()} == {("Ann", "S1", 3), ("Ann", "S2", 1), ("Bob", "S1", 2), ("Bob", "S2", 1)}
    assert {(r.person, r.other, r.event_count, r.style_count) for r in A.collaborations(passed).collect()} == {("Ann", "Bob", 3, 2), ("Bob", "Ann", 3, 2)}


def test_categories_tiers_emails(ev):
    assert {(r.tier, r.n) for r in A.processing_stats(ev).collect()} == {("passed", 4), ("review", 1)}
    assert {(r.email, r.event_count) for r in A.email_rollup(ev.where("confidence >= 70"), "file").collect()} == {("m1", 2), ("m2", 2)}
    by = {r.category: r for r in A.category_rollup(ev.where("confidence >= 70")).collect()}
    assert (by["面料"].event_count, by["面料"].delay_event_count) == (3, 2) and by["封样"].avg_delay_days is None


def test_all_categories(ev):
    assert [r.style_id for r in G.find_styles(ev, A.style_rollup(ev, ("seq",)), ["面料", "封样"]).collect()] == ["S1"]


def test_round_robin(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate("AAABCC")], "seq long, stage string")
    assert [(r.stage, r.seq) for r in O.by_stage(rows, 4, "stage", ["seq"]).collect()] == [("A", 0), ("B", 3), ("C", 4), ("A", 1)]


def test_chunks_budget_upsert(spark):
    rows = spark.range(130).selectExpr("id AS seq", "'s' AS style")
    assert [r["n"] for r in O.chunks(rows, ["style"], ["seq"]).groupBy("round").count().withColumnRenamed("count", "n").orderBy("round").collect()] == [60, 60, 10]
    assert (O.max_items(50, 650), O.max_items(50, 90)) == (11, 1)
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ver int"), spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k int, v string, ver int")
    assert {(r.k, r.v) for r in O.upsert(old, new, ["k"], "ver").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_merges(spark):
    old, new = spark.createDataFrame([(1, "a", None)], "k int, x string, y string"), spark.createDataFrame([(1, "b", "c"), (2, None, "d")], "k int, x string, y string")
    assert {tuple(r) for r in G.overwrite_non_null(old, new, "k").collect()} == {(1, "b", "c"), (2, None, "d")}
    assert {tuple(r) for r in G.fill_missing(old, new, "k").collect()} == {(1, "a", "c"), (2, None, "d")}


def test_asof(spark):
    rows = spark.createDataFrame([(1, "a", 10), (2, "a", 10), (3, "a", 20), (4, "b", 5)], "id long, k string, at long")
    assert {(r.id, r.prev_value) for r in G.previous_event(rows, ["k"], "at", "id", "id").collect()} == {(1, None), (2, None), (3, 2), (4, None)}


def test_assembly_and_carry(spark):
    rows = spark.createDataFrame([(1, True, "a", "x"), (2, False, "b", None), (3, True, "c", "y")], "n long, s boolean, t string, h string").withColumnRenamed("s", "start")
    from pyspark.sql import functions as F

    rows = rows.withColumn("p", F.lit(1))
    assert [r.text for r in O.assembled(rows, ["p"], "n", F.col("start"), "t").orderBy("entry").collect()] == ["a b", "c"]
    assert [r.h for r in O.carried_forward(rows, ["p"], ["n"], "h").orderBy("n").collect()] == ["x", "x", "y"]
