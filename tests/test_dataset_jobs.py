"""Whole training sets: draws, splits, figures, jobs that go on after a stop."""

import json

from pyspark.sql import functions as F

from weftline.plans import dataset_jobs as J
from weftline.streaming.pointer import shared_folder

EVENTS = "style_id long, order_id long, category string, event_type string, date string, delay_days long"


def styles(spark, sizes):
    rows = [(k, i, "RF", "1-URGENT", None if i == 0 else f"2024-01-{i + 1:02d}", None if i == 1 else i) for k, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, EVENTS)


def build(spark, at, events, targets, **how):
    return J.timeline_dataset(spark, at, events, ["date", "order_id"], "system", targets=targets, **how)


def test_layers_repeat_where_scarce_and_splits_share_no_style(spark):
    sizes = {1: 12, 2: 6, **{k: 3 for k in range(10, 22)}, 50: 1}
    job = build(spark, shared_folder(spark), styles(spark, sizes), (20, 4, 40))
    rows = job.step("samples", None).collect()
    train = [r for r in rows if r.split == "train"]
    assert [sum(r.layer == x for r in train) for x in ("rich", "medium", "poor")] == [10, 7, 3]
    assert {r.style_id for r in train if r.layer == "rich"} == {1} and sorted(r.draw for r in train if r.layer == "rich") == list(range(10))
    assert len({r.style_id for r in train if r.layer == "poor"}) == 3  # enough of them: none twice
    by = {s: {r.style_id for r in rows if r.split == s} for s in J.SPLITS}
    assert len(by["val"]) == 4 and len(by["test"]) == 5  # all that are left of twelve
    assert not by["train"] & by["val"] and not (by["train"] | by["val"]) & by["test"] and 50 not in set().union(*by.values())
    figures = {r.split: r for r in job.step("figures", None).collect()}
    assert figures["train"].total == 20 and figures["train"].quality_passed == 20 and figures["test"].poor == 5 and figures["train"].overlapping == 0
    assert figures["train"].avg_events == (10 * 12 + 7 * 6 + 3 * 3) / 20
    written = spark.read.json(f"{job.path}/out/sft")
    assert written.count() == 29 and {r.split for r in written.select("split").distinct().collect()} == set(J.SPLITS)


def test_layers_without_styles_and_empty_tables(spark):
    only = build(spark, shared_folder(spark), styles(spark, {7: 2}), (20, 2, 2))
    rows = only.step("samples", None).collect()
    assert {(r.split, r.style_id) for r in rows} == {("train", 7)} and len(rows) == 3
    none = build(spark, shared_folder(spark), styles(spark, {}), (20, 2, 2))
    assert none.step("records", None).count() == 0 and none.step("figures", None).count() == 0


def test_answers_that_are_missing_or_bad_show_in_the_figures(spark):
    def answers(rows, key, order):
        return rows.groupBy(key).agg(F.lit("no report").alias("report")).where(F.col(key) != 10)

    job = build(spark, shared_folder(spark), styles(spark, {k: 3 for k in range(10, 14)}), (40, 0, 0), answers=answers)
    drawn = job.step("samples", None)
    f = job.step("figures", None).first()
    assert f.drawn == 6 and f.total == drawn.where("style_id <> 10").count() and f.quality_passed == 0 and f.no_title == f.no_icons == f.total


def test_a_stopped_job_goes_on(spark):
    at, calls = shared_folder(spark), []

    def failing(rows, key, order):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("the model is away")
        return J.plain_answers(rows, key, order)

    events = styles(spark, {1: 12, 2: 6, 3: 3, 4: 2})
    try:
        build(spark, at, events, (20, 1, 1), answers=failing)
    except RuntimeError:
        pass
    job = build(spark, at, events, (20, 1, 1), answers=failing)
    assert job.redone == ["records", "figures", "written"]
    job.marks.remove("figures")
    assert build(spark, at, events, (20, 1, 1)).redone == ["figures"]
    other = build(spark, shared_folder(spark), events, (20, 1, 1))
    assert sorted(map(str, other.step("records", None).collect())) == sorted(map(str, job.step("records", None).collect()))


def asked(spark, scenes):
    rows = [(f"{s}-{i}", s, "success") for s, n in scenes.items() for i in range(n)] + [("bad", "a", "failed"), ("unsure", "a", None)]
    return spark.createDataFrame(rows, "question string, scene string, status string")


def test_questions_by_share_topped_up_and_cut(spark):
    rows = J.question_samples(asked(spark, {"a": 70, "b": 25, None: 5}), "question", (20, 5, 4)).collect()
    got = {s: sum(r.scene == s for r in rows) for s in ("a", "b", "unknown")}
    assert len(rows) == len({r.question for r in rows}) == 29 and not {"bad", "unsure"} & {r.question for r in rows}
    assert got["a"] >= 20 and got["b"] >= 7 and got["unknown"] >= 1 and sum(got.values()) == 29  # 20 + 7 + 1, one more from the rest
    assert [sum(r.split == s for r in rows) for s in J.SPLITS] == [20, 5, 4]
    few = J.question_samples(asked(spark, {"a": 7}), "question", (5, 1, 4)).collect()
    assert [sum(r.split == s for r in few) for s in J.SPLITS] == [5, 1, 1]
    assert J.question_samples(asked(spark, {}), "question", (5, 1, 4)).count() == 0


def test_dialogues_pairs_and_figures(spark):
    chain = {"function_calls": [{"name": "kg_query", "params": {"query": "x"}}, {"name": "rag_query", "params": {"style_id": "$1"}}]}
    named = {"function_calls": [{"name": "kg_query", "params": {"style_ids": ["a"]}}, {"name": "rag_query"}]}
    given = {"function_calls": [{"name": "kg_query", "result": {}}, {"name": "kg_query", "result": {"n": 1}}]}
    said = {"a-0": [("user", "q"), ("assistant", json.dumps(chain)), ("assistant", json.dumps(given))], "a-1": [("user", "q"), ("assistant", json.dumps(named)), ("assistant", "{broken")], "a-2": [("user", "q")], "a-3": []}
    turns = spark.createDataFrame([(q, i, r, t) for q, ts in said.items() for i, (r, t) in enumerate(ts)], "question string, turn int, role string, text string")
    job = J.question_dataset(spark, shared_folder(spark), asked(spark, {"a": 4}), lambda s: turns.join(s.select("question"), "question"), targets=(4, 0, 0))
    f = job.step("figures", None).first()
    # the second turn of a-0 is a chain too: its first call has no parameters at all
    assert (f.drawn, f.sft_count, f.dpo_count, f.chain_count, f.result_count) == (4, 3, 2, 2, 1)
    assert [(r.rounds, r.n) for r in f.round_distribution] == [(0, 1), (2, 2)]
    pairs = {r.question: r for r in spark.read.json(f"{job.path}/out/dpo").collect()}
    assert pairs["a-1"].chosen == "{broken" and json.loads(pairs["a-0"].rejected) == chain
    assert job.redone == ["samples", "turns", "sft", "dpo", "figures", "written"]
