import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import graph, rollups
from weftline.streaming import graph_state as S
from weftline.streaming import incremental as I
from weftline.streaming.runs import FAN


def test_replay_equals_rebuild(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    state = I.replay(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "out"))
    wanted = I.rollup(I.partial(events))
    got = I.rollup(state)
    assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()


def test_a_batch_tried_again_counts_once(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").limit(50).cache()
    table = I.StateTable(spark, str(tmp_path))
    table.apply(events, 0)
    table.apply(events, 0)
    assert table.read().agg({"event_count": "sum"}).first()[0] == 50


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_state_survives_retries_and_restarts(spark, sf_dir, tmp_path, monkeypatch):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").limit(90).cache()
    parts = [events.where(F.col("event_id") % 3 == k) for k in range(3)]
    wanted = I.rollup(I.partial(events))
    I.StateTable(spark, str(tmp_path)).apply(parts[0], 0)
    table = I.StateTable(spark, str(tmp_path))  # a new driver
    table.apply(parts[0], 0)  # tried again after the pointer moved
    broken = I.StateTable(spark, str(tmp_path))
    monkeypatch.setattr(broken.pointer, "write", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    try:
        broken.apply(parts[1], 1)  # fails once its table is written, before the pointer moves
    except OSError:
        pass
    assert table.read().agg({"event_count": "sum"}).first()[0] == parts[0].count()
    table.apply(parts[1], 1)
    I.StateTable(spark, str(tmp_path)).apply(parts[2], 2)
    assert same(I.rollup(table.read()), wanted)
    assert I.StateTable(spark, str(tmp_path / "none")).read().count() == 0


def test_replay_goes_on_where_it_was(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    early, late = events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")
    early.repartition(2).write.parquet(source)
    I.replay(spark, source, events.schema, out)
    assert same(I.rollup(I.replay(spark, source, events.schema, out)), I.rollup(I.partial(early)))
    late.coalesce(1).write.mode("append").parquet(source)
    assert same(I.rollup(I.replay(spark, source, events.schema, out)), I.rollup(I.partial(events)))


EVENT = "style_id long, order_id long, line long, factory_id long, category string, date string, delay_days long, party_from string, party_to string"


def few(n, batch):
    return [(i % 11, 100 * batch + i, 1, i % 3, "AB"[i % 2], f"2024-01-{i % 28 + 1:02d}", i - 4, f"p{i % 5}", f"q{i % 4}") for i in range(n)]


def test_a_batch_costs_the_same_however_long_the_history(spark, tmp_path):
    state, work = S.GraphState(spark, str(tmp_path)), []
    for k in range(20):
        state.apply(spark.createDataFrame(few(30, k), EVENT), k)
        content = state.pointer.read()[1]
        work.append((content["files"]["written"], content["files"]["read"]))
        assert all(len(r) <= 2 * (FAN - 1) for r in content["runs"].values()), "runs are merged before they grow many"
    assert work[8:12] == work[0:4] and work[7] == work[15] and max(work) == work[7], "the cost of a batch has a period, not a trend"
    assert len(json.dumps(content)) < 4000 and len(state.pointer.names(state.pointer.folder)) <= 17
    whole = spark.createDataFrame([r for k in range(20) for r in few(30, k)], EVENT)
    assert same(S.styles(state.tables()), rollups.style_rollup(whole).select(S.styles(state.tables()).columns))
    assert same(state.follows([3]), graph.follows(whole.where("style_id = 3")))
    gone = state.vacuum()
    assert len(gone) >= 16 * 7 and state.vacuum() == []
    assert state.table("events").count() == 600


def test_what_cannot_be_applied_is_kept_apart(spark, tmp_path, monkeypatch):
    odd = [(None, 1, 1, 1, "A", "2024-01-01", 1, "p", "q"), (5, None, 1, 1, "A", "2024-01-01", 1, "p", "q"), (5, 2, 1, 1, "", "", 1, "p", "q"), (5, 3, 1, 1, "A", "2024-13-01", 1, "p", "q"), (5, 4, 1, 1, "A", "", None, None, "")]
    state, sent = S.GraphState(spark, str(tmp_path), fan=2), 0
    for k in range(5):
        batch = spark.createDataFrame(few(7, k) + odd, EVENT)
        if k == 2:  # fails once everything is written, before the pointer moves
            with monkeypatch.context() as m:
                m.setattr(state.pointer, "write", lambda *_: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError):
                    state.apply(batch, k)
        S.GraphState(spark, str(tmp_path), fan=2).apply(batch, k)
        state.apply(batch, k)  # tried again after it moved
        sent += 7 + len(odd)
        assert state.counts()["batch"] == {"incoming": 12, "applied": 8, "quarantined": 4}
        assert state.counts()["all"]["incoming"] == sent
        assert state.table("events").count() + state.table("quarantine").count() == sent
    reasons = {(r.batch, r.reason) for r in state.table("quarantine").collect()}
    assert reasons == {(k, x) for k in range(5) for x in ("no style", "no mail", "no category", "date")}
    assert state.table("categories").agg(F.sum("n_events")).first()[0] == 5 * 9, "events without a style count for categories"
    assert state.table("styles").agg(F.sum("n_events")).first()[0] == 5 * 8
    mended = state.table("quarantine").where("reason = 'no style'").drop("reason", "batch").withColumn("style_id", F.lit(9).cast("long")).withColumn("category", F.lit("Z"))
    state.apply(mended, 5)
    assert state.counts()["batch"] == {"incoming": 5, "applied": 5, "quarantined": 0}
    empty = S.GraphState(spark, str(tmp_path / "none"))
    empty.apply(spark.createDataFrame([], EVENT), 0)
    assert empty.counts()["all"]["incoming"] == 0 and S.styles(empty.tables()).count() == 0
