"""Questions judged all at once against the engine's own calls, one by one."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.plans import planner as R
from weftline.plans import validation as V
from weftline.plans.asked import engine

NAME, NOBODY = "Supplier#000000003", "nobody"


@pytest.fixture(scope="module")
def e(spark, sf_dir):
    return engine(spark, sf_dir)


SINGLES = [
    ("my_styles", {}), ("my_styles", {"person_name": NOBODY}), ("person_styles", {"person_name": NAME}), ("person_styles", {"person_name": NOBODY}), ("person_styles", {}), ("factory_styles", {"factory_name": NAME}),
    ("style_overview", {"style_id": 42}), ("style_overview", {"style_id": 10**9}), ("timeline", {"style_ids": [10**9, 7]}), ("timeline", {"style_ids": [10**9]}), ("style_summaries", {}), ("style_summaries", {"style_ids": []}),
    ("find_styles_with_conditions", {"categories": ["RF", "NO", "AF"]}), ("find_styles_with_conditions", {"categories": ["RF", "XX"]}), ("find_styles_with_conditions", {"min_delay_days": 10**6}), ("find_styles_with_conditions", {}),
    ("find_styles_with_conditions", {"factory_name": NAME, "min_delay_days": 500, "categories": ["RF"]}), ("find_styles_with_conditions", {"factory_name": NAME, "person_name": "Supplier#000000004"}), ("find_styles_with_conditions", {"factory_name": NAME, "person_name": NOBODY}),
    ("find_styles_with_conditions", {"categories": ["RF", "RF"], "min_delay_days": 1000}), ("collaborators", {"person_name": NAME}), ("collaborators", {"person_name": NOBODY}), ("factory_delays", {"top_k": 3}), ("factory_delays", {"wrong": 3}),
    ("term_translation", {"query": "x"}), ("term_translation", {}), ("semantic_search", {"query": "x", "style_ids": [42]}), ("semantic_search", {"query": "x", "style_ids": [10**9]}), ("semantic_search", {"query": "x"}), ("no_such", {}),
    ("semantic_search_by_date", {"query": "x", "start": "1997-01-31", "end": "1997-02-01"}), ("semantic_search_by_date", {"query": "x", "start": "2030-01-01"}), ("semantic_search_by_date", {"query": "x", "end": "1980-01-01"}), ("semantic_search_by_date", {"query": "x", "start": "1997-03-01", "end": "1997-02-01"}),
    ("semantic_search_by_conditions", {"query": "x", "categories": ["AF"], "event_types": ["1-URGENT", "2-HIGH"], "min_delay_days": 118, "start": "1996-02-11", "end": "1998-07-03"}), ("semantic_search_by_conditions", {"query": "x", "categories": ["AF"], "min_delay_days": 10**6}),
    ("semantic_search_by_conditions", {"query": "x", "min_delay_days": 121, "end": "1996-06-01"}), ("semantic_search_by_conditions", {"query": "x", "categories": ["ZZ"], "start": "1996-01-01"}),
]


def text(calls):
    return [json.dumps({"type": n} | p) for n, p in calls]


def judged(spark, e, questions):
    rows = spark.createDataFrame([(str(i), text(c)) for i, c in enumerate(questions)], "question string, calls array<string>")
    return {int(r.question): (r.status, r.result) for r in V.validate(e, rows).collect()}


def test_single_calls(spark, e):
    wanted = {i: ("success", V.FILLED) if not e.call(n, **p).isEmpty() else ("failed", V.EMPTY) for i, (n, p) in enumerate(SINGLES)}
    wanted[11] = ("failed", V.EMPTY)  # a list without styles asks for none
    assert judged(spark, e, [[c] for c in SINGLES]) == wanted
    assert len({s for s, _ in wanted.values()}) == 2


def test_chains_and_others(spark, e):
    firsts = [("factory_styles", {"factory_name": NAME}), ("person_styles", {"person_name": NOBODY}), ("find_styles_with_conditions", {"categories": ["RF"], "min_delay_days": 900}), ("my_styles", {})]
    seconds = [("timeline", {}), ("style_overview", {"style_id": 42}), ("style_summaries", {"style_ids": [1, 2, 3]})]
    chains = [[a, b] for a in firsts for b in seconds]
    wanted = {i: not e.execute(c)[0].isEmpty() for i, c in enumerate(chains)}
    searches = [{"min_delay_days": 115, "categories": ["RF"]}, {"start": "1997-03-01", "end": "1997-03-04"}, {"min_delay_days": 10**6}]
    for a in firsts:
        for p in searches:  # the first call's styles narrow a search before it ranks
            wanted[len(chains)] = not e.call("semantic_search_by_conditions", query="x", styles=[r.style_id for r in e.call(a[0], **a[1]).select("style_id").collect()] or [-1], **p).isEmpty()
            chains.append([a, ("semantic_search_by_conditions", {"query": "x"} | p)])
    chains.append([("semantic_search_by_date", {"query": "x", "end": "1997-01-01"}), ("timeline", {})])
    wanted[len(chains) - 1] = True
    got = judged(spark, e, chains)
    assert {i: s == "success" for i, (s, _) in got.items()} == wanted and len(set(wanted.values())) == 2
    two = [[("collaborators", {"person_name": NAME}), ("factory_delays", {})], [("collaborators", {"person_name": NOBODY}), ("factory_delays", {})], [("timeline", {}), ("my_styles", {})], [("my_styles", {})] * 3, []]
    assert [s for _, (s, _) in sorted(judged(spark, e, two).items())] == ["success", "failed", "success", "success", "failed"]
    assert judged(spark, e, two)[4][1] == V.NO_CALL
    odd = spark.createDataFrame([("a", None), ("b", ["no json"]), (None, [json.dumps({"type": "my_styles"})])], "question string, calls array<string>")
    assert {r.question: r.status for r in V.validate(e, odd).collect()} == {"a": "failed", "b": "failed", None: "failed"}
    assert V.validate(e, odd.limit(0)).count() == 0


def test_as_many_views_as_interfaces(spark, e, monkeypatch):
    """Ten thousand questions look at each interface once, whatever their number."""
    looked = []
    for name in V.TAKES:
        monkeypatch.setattr(V.Views, name, lambda self, calls, f=getattr(V.Views, name), n=name, **how: (looked.append(n), f(self, calls, **how))[1])
    many = spark.range(10_000).select(F.col("id").cast("string").alias("question"), F.array(F.to_json(F.struct(F.lit("style_overview").alias("type"), F.col("id").alias("style_id")))).alias("calls"))
    found = V.validate(e, many)
    assert looked == ["style_overview"]
    assert found.where("status = 'success'").count() == e.styles.where("style_id < 10000").count()


def test_every_chain_is_known():
    assert {n for pair in R.CHAINS for n in pair} <= set(V.TAKES)
