"""Queries over charts, summaries and whole builds that Spark first writes from the given tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import collection as C
from ..operators import organization as N
from ..operators import rollups as A
from ..operators.embedding import character_counter, encode_in_parts
from ..functions import lexicon as L
from ..sources import readers
from ..streaming import graph_state as S
from ..streaming import sessions as R
from ..streaming.pointer import shared_folder
from .asked import _hits, query
from .build import GraphBuild, Inputs
from .domain import CTE, factories, style_factory
from .validation import EMPTY, FILLED, NO_CALL, validate
from .oracles import _COS, _SLOTS

#: Companies whose members are customers, in order of precedence.
SOURCES = ["BUILDING", "MACHINERY"]
#: Addresses in one line of a summary, and styles of each, at most.
ADDRESSES, LISTED = 64, 1_000


def known_styles(t):
    """Styles of the order lines, without the joins that make events of them."""
    return t("lineitem").select(F.col("l_partkey").alias("style_id"))


def organization(e, t) -> dict:
    """A chart of the tables, written in lines and read: nations are departments, suppliers users, parts are assigned.
    Some ids are blank, some ends are nobody's, some names differ in case and blanks only, some are blank."""
    n, s, p = t("nation"), t("supplier"), t("part")
    user = lambda k: F.concat(F.lit("U"), k.cast("string"))
    least = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("head"))
    manager = F.when(F.col("n_nationkey") % 5 == 3, "U0").when(F.col("n_nationkey") % 5 == 4, "").otherwise(user(F.col("head")))
    depts = n.join(least, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.array(F.struct(F.concat(F.lit("D"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), manager.alias("manager"))).alias("departments"))

    key, name = F.col("s_suppkey"), F.col("s_name")
    named = F.when(key % 31 == 0, "  ").when(key % 13 == 0, F.concat(F.lit("Supplier#"), F.lpad((key - 1).cast("string"), 9, "0"))).when(key % 4 == 0, F.concat(F.lit("  "), F.upper(name), F.lit(" "))).when(key % 4 == 1, F.lower(name)).otherwise(name)
    users = s.select(F.array(F.struct(
        F.when(key % 29 == 0, "").otherwise(user(key)).alias("id"), named.alias("name"), F.concat(F.lower(name), F.lit("@x")).alias("email"),
        F.when(key % 7 == 0, "D99").otherwise(F.concat(F.lit("D"), "s_nationkey")).alias("department"), F.concat(F.lit("role"), (key % 3).cast("string")).alias("role"),
        user(F.floor(key / 10)).alias("reports_to"),
    )).alias("users"))

    k, some = F.col("p_partkey"), s.agg((F.max("s_suppkey") + 2).alias("m"))
    whose = lambda f: user(k * f % F.col("m"))
    style = F.when(k % 10 == 0, F.concat(F.lit("X"), k.cast("string"))).otherwise(k.cast("string"))
    assigned = p.join(F.broadcast(some), F.lit(True)).select(F.array(F.struct(
        style.alias("style_id"), whose(1).alias("primary_owner"), F.array(whose(3), whose(5), F.lit("")).alias("secondary_owners"), F.array(whose(3), whose(7)).alias("watchers"),
        F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("assigned_date"),
    )).alias("style_assignments"))
    at = f"{shared_folder(e.spark)}/organization"
    depts.unionByName(users, allowMissingColumns=True).unionByName(assigned, allowMissingColumns=True).write.json(at)
    return readers.read_organization(e.spark, at, lines=True, kept=f"{at}-parsed")


def summary(e, t) -> dict:
    """A summary of the tables, written in lines and read: customers are members of their segment, some of two segments,
    some unread or without an address, and mail about the styles of their orders, in either case. A line has ADDRESSES
    addresses, each with LISTED of its styles: a parser's cost is by the line, most of all if each has names that it has
    not met."""
    c = t("customer")
    key, name = F.col("c_custkey"), F.col("c_name")
    email = F.when(key % 17 == 0, "").when(key % 3 == 0, F.upper(F.concat(name, F.lit("@Y ")))).otherwise(F.concat(name, F.lit("@y")))
    given = F.when(key % 5 == 0, N.UNREAD).when(key % 7 == 0, "").otherwise(name)
    member = lambda label: F.struct(F.array(F.struct(email.alias("email"), F.concat(given, F.lit(label)).alias("name"))).alias("members"))
    two = F.when(key % 4 == 0, F.create_map(F.col("c_mktsegment"), member(""), F.lit("BUILDING "), member(" again"))).otherwise(F.create_map("c_mktsegment", member("")))
    both = c.select(F.when((key % 4 == 1) & (F.col("c_mktsegment") != "MACHINERY"), F.map_concat(F.create_map("c_mktsegment", member("")), F.create_map(F.lit("MACHINERY"), member(" also")))).otherwise(two).alias("company_people"))
    sent, email, block = (F.col("line") % 2 == 0).alias("sent"), F.concat("party_to", F.lit("@y")), F.floor(F.col("customer_id") / ADDRESSES).alias("block")
    mails = e.events.select(block, sent, email.alias("email"), "style_id").repartition("block").withColumn("email", F.when(F.col("sent"), F.upper("email")).otherwise(F.col("email"))).distinct()
    part = F.floor((F.row_number().over(Window.partitionBy("block", "sent", "email").orderBy("style_id")) - 1) / LISTED).alias("part")
    style = F.when(F.col("style_id") % 9 == 0, F.concat(F.lit("X"), "style_id")).otherwise(F.col("style_id").cast("string"))
    lists = mails.select("block", "sent", "email", style.alias("style_id"), part).groupBy("block", "sent", "email", "part").agg(F.struct(F.collect_list("style_id").alias("style_list")).alias("listed"))
    packed = lists.groupBy("block", "sent", "part").agg(F.map_from_entries(F.collect_list(F.struct("email", "listed"))).alias("by_email"))
    mailed = packed.select(F.when(F.col("sent"), F.col("by_email")).alias("top_senders"), F.when(~F.col("sent"), F.col("by_email")).alias("top_recipients"))
    at = f"{shared_folder(e.spark)}/summary"
    both.unionByName(mailed, allowMissingColumns=True).write.json(at)
    return readers.read_summary(e.spark, at, lines=True, kept=f"{at}-parsed")


#: The chart and what comes of it, as SQL: every user, the users that count, and the edges.
_ORG = f"""{CTE}{_SLOTS}, m AS (SELECT max(s_suppkey) + 2 AS m FROM supplier
), u AS (
  SELECT 'U' || s_suppkey AS id, CASE WHEN s_suppkey % 13 = 0 THEN 'Supplier#' || lpad(CAST(s_suppkey - 1 AS VARCHAR), 9, '0') ELSE s_name END AS person, lower(s_name) || '@x' AS email,
    CASE WHEN s_suppkey % 7 = 0 THEN 'D99' ELSE 'D' || s_nationkey END AS department, 'role' || (s_suppkey % 3) AS role, 'U' || (s_suppkey // 10) AS reports_to
  FROM supplier WHERE s_suppkey % 29 <> 0 AND s_suppkey % 31 <> 0
), dep AS (
  SELECT 'D' || n_nationkey AS id, n_name AS name, CASE n_nationkey % 5 WHEN 3 THEN 'U0' WHEN 4 THEN '' ELSE 'U' || (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) END AS manager FROM nation
), asg AS (
  SELECT CAST(p_partkey AS VARCHAR) AS style_id, 'U' || (p_partkey % m) AS p1, 'U' || (p_partkey * 3 % m) AS p3, 'U' || (p_partkey * 5 % m) AS p5, 'U' || (p_partkey * 7 % m) AS p7,
    '2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS assigned_date
  FROM part, m WHERE p_partkey % 10 <> 0 AND p_partkey IN (SELECT l_partkey FROM lineitem)
), inv AS (
  SELECT person AS src, style_id AS dst, max(k) AS kind FROM (SELECT style_id, p3 AS who, 'secondary_owner' AS k FROM asg UNION ALL SELECT style_id, p5, 'secondary_owner' FROM asg UNION ALL SELECT style_id, p3, 'watcher' FROM asg UNION ALL SELECT style_id, p7, 'watcher' FROM asg) JOIN u ON u.id = who GROUP BY 1, 2
), oe AS (
  SELECT DISTINCT 'BELONGS_TO_DEPT' AS rel_type, person AS src, department AS dst, CAST(NULL AS VARCHAR) AS assigned_date, CAST(NULL AS VARCHAR) AS involvement_type FROM u JOIN dep ON dep.id = department
  UNION ALL SELECT DISTINCT 'REPORTS_TO', u.person, b.person, NULL, NULL FROM u JOIN u b ON b.id = u.reports_to
  UNION ALL SELECT DISTINCT 'MANAGES', person, dep.id, NULL, NULL FROM dep JOIN u ON u.id = manager
  UNION ALL SELECT 'RESPONSIBLE_FOR', person, style_id, max(assigned_date), NULL FROM asg JOIN u ON u.id = p1 GROUP BY 2, 3
  UNION ALL SELECT 'INVOLVED_IN', src, dst, NULL, kind FROM inv
)"""


@query(f"{_ORG} SELECT * FROM oe")
def organization_edges(e, t):
    """Edges of a chart; those with an end that is nobody are left out."""
    org = organization(e, t)
    return N.edges(org, N.users(org), known_styles(t))


@query(f"""{_ORG}, c AS (SELECT person, person AS name, arg_min(email, id) AS email, arg_min(department, id) AS department, arg_min(role, id) AS role FROM u GROUP BY 1), k AS (SELECT DISTINCT person FROM slots)
SELECT coalesce(c.person, k.person) AS person, coalesce(name, k.person) AS name, email, department, role, k.person IS NOT NULL AS is_from_email FROM c FULL JOIN k ON c.person = k.person""")
def organization_people(e, t):
    """People of the events and of the chart, matched by their normalised names."""
    return N.people(N.users(organization(e, t)), A.parties(e.events))


@query(f"{_ORG} SELECT dep.id AS dept_id, name, manager AS manager_id, (SELECT count(*) FROM u WHERE department = dep.id) AS member_count FROM dep")
def organization_departments(e, t):
    org = organization(e, t)
    return N.departments(org, N.users(org))


_CUSTOMERS = f"""{CTE}, given AS (
  SELECT c_custkey AS k, lower(c_name) || '@y' AS email, CASE WHEN c_custkey % 5 = 0 THEN '{N.UNREAD}' WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS n, c_mktsegment AS seg FROM customer WHERE c_custkey % 17 <> 0
), members AS (
  SELECT email, seg AS company, n AS name FROM given UNION ALL SELECT email, 'MACHINERY', trim(n || ' also') FROM given WHERE k % 4 = 1 AND seg <> 'MACHINERY'
), cust AS (
  SELECT email, arg_min(CASE WHEN name IN ('', '{N.UNREAD}') THEN split_part(email, '@', 1) ELSE name END, list_position(['BUILDING', 'MACHINERY'], company)) AS name, arg_min(company, list_position(['BUILDING', 'MACHINERY'], company)) AS source
  FROM members WHERE company IN ('BUILDING', 'MACHINERY') GROUP BY 1
), mailed AS (SELECT DISTINCT lower(party_to) || '@y' AS email, CASE WHEN style_id % 9 = 0 THEN 'X' || style_id ELSE CAST(style_id AS VARCHAR) END AS style_id FROM ev
), own AS (SELECT * FROM mailed WHERE email IN (SELECT email FROM cust)), linked AS (SELECT * FROM own WHERE style_id NOT LIKE 'X%')"""


@query(f"{_CUSTOMERS} SELECT email, name, source, (SELECT count(*) FROM own WHERE own.email = cust.email) AS style_count FROM cust")
def customers_identified(e, t):
    """One customer an address, of the first of the companies that has it, with the number of its styles."""
    s = summary(e, t)
    return N.customer_styles(N.customers(s["people"], SOURCES), s["styles"], known_styles(t))["customers"]


@query(f"{_CUSTOMERS} SELECT 'HAS_STYLE' AS rel_type, email AS src, style_id AS dst FROM linked UNION ALL SELECT 'ORDERED_BY', style_id, email FROM linked")
def customer_mail_edges(e, t):
    s = summary(e, t)
    return N.customer_styles(N.customers(s["people"], SOURCES), s["styles"], known_styles(t))["edges"]


def build_inputs(e, t) -> Inputs:
    return Inputs(e.events, style_factory(e.spark, e.sf_dir), factories(e.spark, e.sf_dir).select("factory_id", "name"), organization(e, t), summary(e, t), SOURCES)


def built(e, t) -> GraphBuild:
    build = GraphBuild(e.spark, f"{shared_folder(e.spark)}/graph")
    build.run(build_inputs(e, t))
    return build


_BUILD = f"""{_ORG}, cu AS ({_CUSTOMERS} SELECT 'c' AS what, email AS a, name AS b FROM cust UNION ALL SELECT 'l', email, style_id FROM linked), counts AS (
  SELECT 'node' AS kind, 'Event' AS label, count(*) AS n FROM ev UNION ALL SELECT 'node', 'Style', count(DISTINCT style_id) FROM ev UNION ALL SELECT 'node', 'Category', count(DISTINCT category) FROM ev UNION ALL SELECT 'node', 'Email', count(DISTINCT order_id) FROM ev
  UNION ALL SELECT 'node', 'Person', count(*) FROM (SELECT person FROM slots UNION SELECT person FROM u) UNION ALL SELECT 'node', 'Factory', count(*) FROM supplier UNION ALL SELECT 'node', 'Department', count(*) FROM dep UNION ALL SELECT 'node', 'Customer', count(*) FROM cu WHERE what = 'c'
  UNION ALL SELECT 'edge', 'BELONGS_TO', count(*) FROM ev UNION ALL SELECT 'edge', 'HAS_CATEGORY', count(*) FROM ev UNION ALL SELECT 'edge', 'FROM_EMAIL', count(*) FROM ev
  UNION ALL SELECT 'edge', 'PARTICIPATED_IN', count(*) FROM (SELECT DISTINCT person, order_id, line, style_id, factory_id FROM slots)
  UNION ALL SELECT 'edge', 'INVOLVED_IN', count(*) FROM (SELECT person, CAST(style_id AS VARCHAR) AS s FROM slots UNION SELECT src, dst FROM inv)
  UNION ALL SELECT 'edge', 'COLLABORATED_WITH', 2 * count(*) FROM (SELECT DISTINCT least(party_from, party_to), greatest(party_from, party_to) FROM ev WHERE party_from <> party_to)
  UNION ALL SELECT 'edge', 'FOLLOWS', (SELECT count(*) FROM ev) - (SELECT count(*) FROM (SELECT DISTINCT style_id, category FROM ev)) UNION ALL SELECT 'edge', 'PRODUCED_BY', count(*) FROM sf
  UNION ALL SELECT 'edge', k, (SELECT count(*) FROM oe WHERE rel_type = k) FROM (VALUES ('BELONGS_TO_DEPT'), ('REPORTS_TO'), ('MANAGES'), ('RESPONSIBLE_FOR')) v(k) UNION ALL SELECT 'edge', k, (SELECT count(*) FROM cu WHERE what = 'l') FROM (VALUES ('HAS_STYLE'), ('ORDERED_BY')) v(k)
)
SELECT kind, label, CAST(n AS BIGINT) AS n FROM counts UNION ALL SELECT kind, 'total', CAST(sum(n) AS BIGINT) FROM counts GROUP BY 1"""


@query(_BUILD)
def graph_built_in_stages(e, t):
    """Nodes by label and edges by relation of a whole staged build."""
    return built(e, t).stats()


@query(f"""{_ORG}, p AS (SELECT person, count(*) AS event_count, count(DISTINCT style_id) AS style_count FROM slots GROUP BY 1), c AS (SELECT person, person AS name, arg_min(email, id) AS email, arg_min(department, id) AS department, arg_min(role, id) AS role FROM u GROUP BY 1)
SELECT coalesce(p.person, c.person) AS person, event_count, style_count, email, department, role, p.person IS NOT NULL AS is_from_email FROM p FULL JOIN c ON p.person = c.person""")
def people_built_in_stages(e, t):
    """Person nodes after all stages: what the events know, and what the chart adds to it."""
    return built(e, t).nodes("Person").select("person", "event_count", "style_count", "email", "department", "role", "is_from_email")




# collections of vectors


def collection(e, t) -> C.VectorCollection:
    return C.create(t("embeddings"), f"{shared_folder(e.spark)}/vectors")


def _asked(t, condition: str):
    return t("embeddings").where(condition).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _nearest_sql(where: str, k: int) -> str:
    return f"""SELECT q.vec_id AS query_id, e.vec_id, e.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank, {_COS} AS score
FROM embeddings e, embeddings q WHERE q.vec_id < 5 AND {where} QUALIFY rank <= {k}"""


@query(_nearest_sql("e.label IN (1, 3)", 5))
def collection_all_cells(e, t):
    """Five questions to a stored collection with a filter, all its cells probed."""
    found = collection(e, t).search(_asked(t, "vec_id < 5"), 5, F.col("label").isin(1, 3), probe=C.MOST_CELLS)
    return found.select("query_id", "vec_id", "label", F.col("rank").cast("long").alias("rank"), "score")


@query(_nearest_sql("true", 10))
def collection_exact(e, t):
    found = collection(e, t).search(_asked(t, "vec_id < 5"), exact=True)
    return found.select("query_id", "vec_id", "label", F.col("rank").cast("long").alias("rank"), "score")


_DIGIT_COUNTS = ", ".join(f"length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{d}', ''))" for d in range(10))


@query(f"SELECT doc_id, concat_ws(',', {_DIGIT_COUNTS}) AS digits FROM documents")
def documents_encoded(e, t):
    """Vectors of all documents, a hundred at a time, in parts that a stopped job would go on with."""
    found = encode_in_parts(e.spark, t("documents"), f"{shared_folder(e.spark)}/encoded", character_counter(), parts=4)
    return found.select("doc_id", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ",").alias("digits"))


# sessions

_FOCUS = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i)({'|'.join(ps)})') THEN '{k}'" for k, ps in L.EVENT_FOCUS.items()) + " END"
_SAYS = lambda column, words: "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"
_SESSIONS = rf"""WITH c AS (
  SELECT CAST(conv_id AS VARCHAR) AS session, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'CCSS' || (10000 + conv_id) || ' ' || text WHEN 1 THEN '那款 ' || text WHEN 2 THEN '继续 ' || text WHEN 3 THEN text || ' 它延期' ELSE text END AS text FROM conversations
), f AS (
  SELECT session, turn, coalesce(nullif(regexp_extract(upper(text), '\bCCSS\d{{5,6}}[A-Z]?\b'), ''), nullif(regexp_extract(text, '\b\d{{7}}\b'), '')) AS own, {_SAYS("text", L.PRONOUNS)} AS refers, {_SAYS("lower(text)", L.CONTINUATION)} AS goes_on,
    {_SAYS("lower(text)", L.GREETINGS)} AS greets, {_FOCUS} AS focus FROM c
), b AS (
  SELECT *, last_value(CASE WHEN NOT goes_on THEN own END IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f
), s AS (SELECT *, coalesce(own, CASE WHEN refers THEN before END) AS style FROM b)
SELECT session, turn, CASE WHEN goes_on THEN 'continuation' WHEN style IS NOT NULL THEN 'route_v1' WHEN greets THEN 'direct_answer' ELSE 'route_v2' END AS decision,
  CASE WHEN goes_on THEN 'continuation' WHEN style IS NOT NULL AND focus = '延期' THEN 'style_delay' WHEN style IS NOT NULL THEN 'style_timeline' WHEN greets THEN 'general_chat' ELSE 'unknown' END AS intent,
  CASE WHEN goes_on THEN before ELSE style END AS style_id, CASE WHEN NOT goes_on THEN focus END AS event_focus FROM s"""


def turns(t):
    """Conversations some of whose turns name a style, refer to one, ask for more or for delays."""
    k, text = (F.col("conv_id") + F.col("turn")) % 5, F.col("text")
    named = F.concat(F.lit("CCSS"), (F.col("conv_id") + 10000).cast("string"), F.lit(" "), text)
    said = F.when(k == 0, named).when(k == 1, F.concat(F.lit("那款 "), text)).when(k == 2, F.concat(F.lit("继续 "), text)).when(k == 3, F.concat(text, F.lit(" 它延期"))).otherwise(text)
    return t("conversations").select(F.col("conv_id").alias("session"), "turn", said.alias("text"))


@query(_SESSIONS)
def sessions_routed(e, t):
    """Every turn's routing, with the style that its session last named."""
    return R.route_sessions(turns(t), block=3)


@query(_SESSIONS)
def sessions_routed_on_a_stream(e, t):
    """The same from a stream of two files, each session's state carried from the first to the second."""
    at = shared_folder(e.spark)
    for half in (True, False):
        turns(t).where((F.col("turn") < 3) == half).coalesce(1).write.mode("append").parquet(f"{at}/in")
    source = e.spark.readStream.schema(turns(t).schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    R.stream_sessions(e.spark, source, at).awaitTermination()
    return e.spark.read.parquet(f"{at}/out")


# state


_SENT = """SELECT CAST(l_orderkey % 3 AS BIGINT) AS batch, CASE WHEN l_orderkey % 41 = 0 THEN 'no mail' WHEN l_orderkey % 37 = 0 THEN 'no category' WHEN l_orderkey % 43 = 0 THEN 'date' WHEN l_orderkey % 31 = 0 THEN 'no style' END AS reason FROM lineitem"""


@query(f"SELECT batch, coalesce(reason, 'applied') AS outcome, count(*) AS n FROM ({_SENT}) GROUP BY 1, 2")
def batches_with_quarantine(e, t):
    """What became of the events of three batches, some of which cannot be applied: all are there, once."""
    k = F.col("order_id")
    sent = e.events.withColumns({
        "category": F.when(k % 37 == 0, "").otherwise(F.col("category")), "date": F.when(k % 43 == 0, "2024-02-30").otherwise(F.col("date")), "style_id": F.when(k % 31 != 0, F.col("style_id")),
        "sent": (k % 3).cast("long"), "order_id": F.when(k % 41 != 0, k),
    })
    state = S.GraphState(e.spark, shared_folder(e.spark), fan=2)
    for n in range(3):
        state.apply(sent.where(F.col("sent") == n), n)
    applied = state.table("events").select(F.col("sent").alias("batch"), F.lit("applied").alias("outcome"))
    return applied.unionByName(state.table("quarantine").select("batch", F.col("reason").alias("outcome"))).groupBy("batch", "outcome").agg(F.count(F.lit(1)).alias("n"))


# questions, all at once


def _call(kind: str, **params):
    return F.to_json(F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in params.items()]))


def questions(t):
    """(question, calls) from suppliers, customers, parts and orders: single calls, chains, two that stand alone, none, and
    calls that no interface fits."""
    s, c, p, o = t("supplier"), t("customer"), t("part"), t("orders")
    k, f = F.col("s_suppkey"), F.col("s_name")
    made = lambda df, name, key, *calls: df.select(F.concat(F.lit(name), key.cast("string")).alias("question"), F.array(*calls).cast("array<string>").alias("calls"))
    wanted = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("NO"), F.lit("RF"), F.lit("AF"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("RF"), F.lit("XX")))
    limit = F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") * 60)
    style = F.when(F.col("p_partkey") % 7 == 0, F.col("p_partkey") + 10**9).otherwise(F.col("p_partkey"))
    day = F.date_format(F.date_add(F.to_date("o_orderdate"), 400), "yyyy-MM-dd")
    search = _call("semantic_search_by_conditions", query=F.lit("q"), categories=F.array(F.lit("RF")), min_delay_days=(k % 150), start=F.lit("1997-06-01"), end=F.concat(F.lit("1997-06-"), F.lpad((k % 30 + 1).cast("string"), 2, "0")))
    parts = [
        made(s, "factory ", k, _call("factory_styles", factory_name=F.when(k % 5 == 0, F.concat(f, F.lit("x"))).otherwise(f))),
        made(s, "factory timeline ", k, _call("factory_styles", factory_name=f), _call("timeline")),
        made(s, "factory search ", k, _call("factory_styles", factory_name=f), search),
        made(s, "unfit ", k, F.when(k % 3 == 0, _call("no_such_interface")).when(k % 3 == 1, _call("factory_styles", no_such_parameter=F.lit(1))).otherwise(_call("person_styles")), _call("factory_delays")),
        made(s, "nothing ", k),
        made(c, "person ", F.col("c_custkey"), _call("person_styles", person_name=F.col("c_name"))),
        made(c, "two ", F.col("c_custkey"), _call("collaborators", person_name=F.col("c_name")), _call("factory_delays")),
        made(p, "overview ", F.col("p_partkey"), _call("style_overview", style_id=style)),
        made(p, "conditions ", F.col("p_partkey"), _call("find_styles_with_conditions", categories=wanted, min_delay_days=limit)),
        made(o, "search ", F.col("o_orderkey"), _call("semantic_search_by_conditions", query=F.lit("q"), event_types=F.array(F.col("o_orderpriority")), min_delay_days=F.lit(90), start=day, end=day)),
    ]
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out


_JUDGED = f"""{CTE}{_SLOTS}, person AS (SELECT person FROM slots UNION SELECT s_name FROM sf JOIN supplier ON s_suppkey = factory_id), kinds AS (SELECT style_id, list(DISTINCT category) AS has FROM ev GROUP BY 1
), free AS (SELECT max(total_delay_days) FILTER (list_has_all(has, ['NO', 'RF', 'AF'])) AS d0, max(total_delay_days) FILTER (list_has_all(has, ['RF', 'XX'])) AS d1, max(total_delay_days) AS d2 FROM styles JOIN kinds USING (style_id)
), j AS (
  SELECT 'factory ' || s_suppkey AS question, s_suppkey % 5 <> 0 AND s_suppkey IN (SELECT factory_id FROM sf) AS ok FROM supplier
  UNION ALL SELECT 'factory timeline ' || s_suppkey, s_suppkey IN (SELECT factory_id FROM sf) FROM supplier
  UNION ALL SELECT 'factory search ' || s_suppkey, EXISTS (SELECT 1 FROM ev JOIN sf ON sf.style_id = ev.style_id WHERE sf.factory_id = s_suppkey AND category = 'RF' AND delay_days >= s_suppkey % 150 AND date BETWEEN '1997-06-01' AND '1997-06-' || lpad(CAST(s_suppkey % 30 + 1 AS VARCHAR), 2, '0')) FROM supplier
  UNION ALL SELECT 'unfit ' || s_suppkey, false FROM supplier UNION ALL SELECT 'nothing ' || s_suppkey, NULL FROM supplier
  UNION ALL SELECT 'person ' || c_custkey, c_name IN (SELECT person FROM person) FROM customer
  UNION ALL SELECT 'two ' || c_custkey, c_name IN (SELECT party_from FROM ev WHERE party_from <> party_to UNION SELECT party_to FROM ev WHERE party_from <> party_to) FROM customer
  UNION ALL SELECT 'overview ' || p_partkey, p_partkey % 7 <> 0 AND p_partkey IN (SELECT style_id FROM styles) FROM part
  UNION ALL SELECT 'conditions ' || p_partkey, coalesce(CASE p_partkey % 3 WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END >= CASE WHEN p_partkey % 4 <> 0 THEN p_size * 60 ELSE -1000000000 END, false) FROM part, free
  UNION ALL SELECT 'search ' || o_orderkey, strftime(CAST(o_orderdate AS DATE) + 400, '%Y-%m-%d') || o_orderpriority IN (SELECT date || event_type FROM ev WHERE delay_days >= 90) FROM orders
)"""


@query(f"{_JUDGED} SELECT question, CASE WHEN ok THEN 'success' ELSE 'failed' END AS status, CASE WHEN ok IS NULL THEN '{NO_CALL}' WHEN ok THEN '{FILLED}' ELSE '{EMPTY}' END AS result FROM j")
def executable_questions(e, t):
    """All questions by whether they can be answered, a join an interface."""
    return validate(e, questions(t))


@query(f"SELECT 'unfit ' || s_suppkey AS question, 'failed' AS status, '{EMPTY}' AS result FROM supplier")
def call_that_does_not_fit(e, t):
    """Questions with a call of no interface, with a parameter that it does not take, or without one that it needs."""
    return validate(e, questions(t).where(F.col("question").startswith("unfit")))


@query(_hits("1996-07 延期 30", "category IN ('RF', 'AF') AND delay_days >= 30 AND date >= '1996-01-01' AND date <= '1996-12-31'", 15))
def stored_search_by_conditions(e, t):
    """A search by conditions over vectors that were stored once, exactly."""
    e.store_vectors(f"{shared_folder(e.spark)}/events", exact=True)
    return e.call("semantic_search_by_conditions", query="1996-07 延期 30", categories=["RF", "AF"], min_delay_days=30, start="1996-01-01", end="1996-12-31", top_k=15)
