"""What keeps queries over large tables within their limits."""

from functools import partial

from pyspark.sql import functions as F

from weftline.functions import templates as P
from weftline.operators import collection as C
from weftline.operators import graph as G
from weftline.operators import rollups as A

from weftline.plans import built as Q
from weftline.plans.asked import engine
from weftline.plans.build import GraphBuild, of_events
from weftline.plans.domain import table


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_summary_lists_styles_by_address_and_is_parsed_once(spark, sf_dir, monkeypatch):
    e, t = engine(spark, sf_dir), partial(table, spark, sf_dir)
    whole = Q.summary(e, t)
    at = whole["styles"].inputFiles()[0].split("-parsed")[0]
    assert all("-parsed" in f for k in whole for f in whole[k].inputFiles())
    addresses = e.events.select("party_to").distinct().count()
    assert spark.read.text(at).count() - t("customer").count() <= 2 * (addresses // 50 + 1)
    monkeypatch.setattr(Q, "LISTED", 3)
    assert rows(Q.summary(e, t)["styles"]) == rows(whole["styles"])
    want = e.events.select(F.lower(F.concat("party_to", F.lit("@y"))), F.when(F.col("style_id") % 9 == 0, F.concat(F.lit("X"), "style_id")).otherwise(F.col("style_id").cast("string"))).distinct()
    assert rows(whole["styles"]) == rows(want)


def test_exact_store_needs_no_cells_and_encodes_a_row_once(spark, sf_dir, tmp_path, monkeypatch):
    e = engine(spark, sf_dir)
    plan = e._encoded(e.unnamed).where(C.usable("embedding"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("款号") == 1
    monkeypatch.setattr(C, "KMeans", None)
    e.store_vectors(str(tmp_path), exact=True)
    assert e.collection.rows.count() == e.events.count() and len(e.collection.cells) == 1
    asked = lambda: e.call("semantic_search_by_conditions", query="1996-07 延期 30", categories=["RF"], top_k=20)
    stored = rows(asked())
    e.collection = None
    assert stored == rows(asked()) and len(stored) == 20


def test_stages_of_a_build_read_what_is_stored(spark, sf_dir, tmp_path):
    given = Q.build_inputs(engine(spark, sf_dir), partial(table, spark, sf_dir))
    build = GraphBuild(spark, str(tmp_path / "g"))
    tables = of_events(build, given)
    assert tables and not any("supplier.parquet" in f for d in tables.values() for f in d.inputFiles())
    build.run(given)
    assert not list((tmp_path / "g").glob("*/_aside"))
    swapped = build.edges("ORDERED_BY").select("dst", "src")
    assert rows(swapped) == rows(build.edges("HAS_STYLE"))


def test_graph_stats_count_what_edges_hold(spark):
    events = [(s, o, n % 2, f, c, "RF" if n % 3 else None, "1996-01-0%d" % (n % 9 + 1), a, b) for n, (s, o, f, c, a, b) in enumerate([(1, 1, 1, 1, "A", "B"), (1, 1, 1, 1, "A", "B"), (1, 2, 1, 2, "A", "A"), (2, 2, 1, 2, "B", "A"), (2, 3, 2, 1, "C", None), (3, 3, 2, 3, "", "C")] * 2)]
    e = spark.createDataFrame(events, "style_id long, order_id long, line long, factory_id long, customer_id long, category string, date string, party_from string, party_to string")
    made, factories = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "style_id long, factory_id long"), spark.createDataFrame([(1, "A", 1), (2, "C", 1)], "factory_id long, name string, dept_id long")
    stats = G.graph_stats(e, made, factories, spark.createDataFrame([(1, "d")], "dept_id long, dept string"))
    got = {r.label: r.n for r in stats.where("kind = 'edge' AND label <> 'total'").collect()}
    assert got == {k: d.count() for k, d in G.edges(e, made, factories).items()}
    assert "array_intersect" not in (plan := stats._jdf.queryExecution().analyzed().toString()) and "lead(" not in plan
    assert {r.label: r.n for r in stats.where("kind = 'node'").collect()} == {"Event": 12, "Style": 3, "Person": 3, "Category": 2, "Email": 3, "Factory": 2, "Department": 1, "Customer": 3, "total": 29}
    assert {r.n for r in G.graph_stats(e.limit(0), made, factories, made).where("label IN ('Event', 'Style', 'FOLLOWS', 'COLLABORATED_WITH')").collect()} == {0}


def test_customer_details_send_a_set_to_a_block(spark, monkeypatch):
    n = 300  # customers of one style, in two blocks: its set goes to both, not to each customer
    events = spark.createDataFrame([(c, 1, c % 7) for c in range(n)], "customer_id long, style_id long, factory_id long")
    monkeypatch.setattr(G, "BLOCK", 200)
    found = G.customer_details(events, spark.createDataFrame([(1, 3)], "style_id long, factory_id long"))
    assert {(r.styles, r.factory_ids, r.people) for r in found.collect()} == {(1, "3", n + 7)} and found.count() == n
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and plan.count("Join") == 1


def test_answer_details_deal_events_out_once(spark):
    events = spark.createDataFrame([(1, n, 1, 1, "RF" if n < 9 else None, "1-URGENT", "1996-01-%02d" % (n + 1), n - 4 if n < 7 else None) for n in range(12)] + [(2, 1, 1, 1, "AF", "5-LOW", "1996-02-01", -3)], "style_id long, order_id long, line long, factory_id long, category string, event_type string, date string, delay_days long")
    people = spark.createDataFrame([(1, "A", "participant", 3), (1, "B", "participant", 4), (2, "A", "participant", 1)], "style_id long, person string, role string, event_count long")
    found = P.details(A.style_rollup(events), people, events)
    said = {r.style_id: r.answer for r in found.collect()}
    assert said[2] == "## 📋 款号 2\n\n当前阶段：**AF** | 事件数：1 | 最后更新：1996-02-01 | ⚠️ 累计延期：-3 天\n\n**相关人员**：A（participant）\n\n**阶段分布**：\n- AF：1 个事件\n\n**最近事件**：\n- 1996-02-01 AF：5-LOW [延期-3天]\n"
    assert said[1].split("**相关人员**：")[1] == "B（participant）, A（participant）\n\n**阶段分布**：\n- RF：9 个事件\n\n**最近事件**：\n- 1996-01-09 RF：1-URGENT\n- 1996-01-08 RF：1-URGENT\n\n**延期事件**（2 个）：\n- 1-URGENT（延期2天）\n- 1-URGENT（延期1天）\n"
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
