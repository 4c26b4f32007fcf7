"""Charts and customer lists with odd entries, and the staged build against one pass and after losses."""

import json
import os

from pyspark.sql import functions as F

from weftline.operators import organization as N
from weftline.plans import built as Q
from weftline.plans.asked import engine
from weftline.plans.build import STAGES, GraphBuild
from weftline.plans.domain import table
from weftline.sources import readers


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_chart_of_one_document(spark, tmp_path):
    user = lambda i, name, **more: {"id": i, "name": name, "email": f"{i}@x", "department": "d1", "role": None, "reports_to": ""} | more
    chart = {
        "departments": [{"id": "d1", "name": "One", "manager": "u1"}, {"id": "d1", "name": "Again", "manager": "u2"}, {"id": "", "name": "none", "manager": "u1"}, {"id": "d2", "name": "Two", "manager": "nobody"}],
        "users": [user("u1", " ann LEE "), user("u2", "ANN lee", role="r2", reports_to="u1"), user("u3", "未知", reports_to="u2"), user("u4", "  "), user("", "Bob"), user("u5", "Bo", department="d9", reports_to="gone"), user("u5", "Bea", department=None)],
        "style_assignments": [
            {"style_id": "S1", "primary_owner": "u1", "secondary_owners": ["u3", "u5", None, ""], "watchers": ["u3"], "assigned_date": "1"},
            {"style_id": "S1", "primary_owner": "u2", "secondary_owners": ["u3"], "watchers": None, "assigned_date": "2"},
            {"style_id": "S9", "primary_owner": "u1", "secondary_owners": ["u1"], "watchers": [], "assigned_date": "3"},
            {"style_id": "", "primary_owner": "u1"},
        ],
    }
    (tmp_path / "org.json").write_text(json.dumps(chart, ensure_ascii=False, indent=1))
    org = readers.read_organization(spark, str(tmp_path / "org.json"))
    users = N.users(org)
    known = spark.createDataFrame([("S1",), ("S2",), (None,)], "style_id string")
    edges = {(r.rel_type, r.src, r.dst): (r.assigned_date, r.involvement_type) for r in N.edges(org, users, known).collect()}
    assert edges == {
        ("BELONGS_TO_DEPT", "Ann Lee", "d1"): (None, None), ("BELONGS_TO_DEPT", "u3", "d1"): (None, None),
        ("REPORTS_TO", "Ann Lee", "Ann Lee"): (None, None), ("REPORTS_TO", "u3", "Ann Lee"): (None, None),
        ("MANAGES", "Ann Lee", "d1"): (None, None), ("RESPONSIBLE_FOR", "Ann Lee", "S1"): ("2", None),
        ("INVOLVED_IN", "u3", "S1"): (None, "secondary_owner"), ("INVOLVED_IN", "Bea", "S1"): (None, "secondary_owner"),
    }
    people = {r.person: (r.name, r.email, r.role, r.is_from_email) for r in N.people(users, spark.createDataFrame([("Ann Lee",), ("Zoe",), (None,)], "person string")).collect()}
    assert people["Ann Lee"] == ("Ann Lee", "u1@x", "r2", True) and people["Zoe"] == ("Zoe", None, None, True) and people["u3"] == ("未知", "u3@x", None, False)
    assert rows(N.departments(org, users)) == [("d1", "One", "u1", 3), ("d2", "Two", "nobody", 0)]
    assert N.edges({k: v.limit(0) for k, v in org.items()}, users.limit(0), known).count() == 0


def test_customers_of_one_summary(spark, tmp_path):
    people = {
        "B": {"members": [{"email": " X@a ", "name": "of B"}, {"email": "y@a", "name": "  "}, {"email": "", "name": "none"}]},
        "A": {"members": [{"email": "x@A", "name": N.UNREAD}, {"email": "x@a", "name": "second"}, {"email": None, "name": "none"}]},
        "C": {"members": [{"email": "z@a", "name": "not one"}]},
    }
    (tmp_path / "s.json").write_text(json.dumps({"company_people": people, "top_senders": {"X@a": {"style_list": ["S1", "", "S7"]}, "z@a": {"style_list": ["S1"]}}, "top_recipients": {"x@a": {"style_list": ["S1", None]}}}))
    s = readers.read_summary(spark, str(tmp_path / "s.json"))
    found = N.customers(s["people"], ["A", "B", "missing"])
    assert rows(found) == [("x@a", "x", "A"), ("y@a", "y", "B")]
    linked = N.customer_styles(found, s["styles"], spark.createDataFrame([("S1",), ("S2",)], "style_id string"))
    assert rows(linked["edges"]) == [("HAS_STYLE", "x@a", "S1"), ("ORDERED_BY", "S1", "x@a")]
    assert rows(linked["customers"]) == [("x@a", "x", "A", 2), ("y@a", "y", "B", 0)] and rows(linked["styles"]) == [("S1", 1)]


def test_a_lost_stage_is_redone_alone(spark, sf_dir, tmp_path):
    e = engine(spark, sf_dir)
    given = Q.build_inputs(e, lambda name: table(spark, sf_dir, name))
    path, names = str(tmp_path / "g"), [n for n, _ in STAGES]
    build = GraphBuild(spark, path)
    assert build.run(given) == names and build.run(given) == []
    whole = {n: rows(build.edges(n)) for n in ("INVOLVED_IN", "RESPONSIBLE_FOR", "HAS_STYLE")} | {n: rows(build.nodes(n)) for n in ("Style", "Person", "Customer")}
    stamp = lambda stage: sorted((f, os.path.getmtime(os.path.join(d, f))) for d, _, fs in os.walk(f"{path}/{stage}") for f in fs)
    before = {n: stamp(n) for n in names}
    again = GraphBuild(spark, path)
    again.drop("organization")
    assert again.run(given) == ["organization"]
    assert [n for n in names if stamp(n) != before[n]] == ["organization"]
    assert {n: rows(again.edges(n)) for n in ("INVOLVED_IN", "RESPONSIBLE_FOR", "HAS_STYLE")} | {n: rows(again.nodes(n)) for n in ("Style", "Person", "Customer")} == whole

    class Lost(Exception):
        pass

    stopped = GraphBuild(spark, str(tmp_path / "stopped"))
    write = stopped.marks.write_named

    def fail(stage, content):
        if stage == "organization":
            raise Lost
        write(stage, content)

    stopped.marks.write_named = fail
    try:
        stopped.run(given)
    except Lost:
        pass
    resumed = GraphBuild(spark, str(tmp_path / "stopped"))
    assert sorted(resumed.done()) == ["events", "factories"]
    assert resumed.run(given) == ["organization", "customers"]
    assert rows(resumed.nodes("Person")) == whole["Person"] and rows(resumed.edges("INVOLVED_IN")) == whole["INVOLVED_IN"]
    styles = resumed.nodes("Style")
    counted = resumed.edges("ORDERED_BY").groupBy(F.col("src").alias("style_id")).count()
    assert rows(styles.where("customer_count IS NOT NULL").select("style_id", "customer_count")) == rows(counted)
