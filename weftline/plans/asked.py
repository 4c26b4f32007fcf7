"""Queries through the engine, one a strategy and interface, and over small operators, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieval as V
from ..operators import terms as T
from .domain import CTE, table
from .engine import Engine
from .oracles import _COLLAB, _OWNERS, _PEOPLE, _SLOTS, EVT
from .queries import NOW_TS, PERSON, STYLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_EVENT = "style_id, order_id, line, factory_id, category, event_type, date, delay_days"


def digits(text: Column) -> Column:
    """A vector that SQL can make too: how often each digit occurs."""
    return F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(str(d)), F.lit("")))).cast("double") for d in range(10)])


def _digits(text: str) -> str:
    return "[" + ", ".join(f"CAST(length({text}) - length(replace({text}, '{d}', '')) AS DOUBLE)" for d in range(10)) + "]"


_DOCUMENT = "concat_ws(' | ', '款号: ' || style_id, '阶段: ' || category, '类型: ' || event_type, '日期: ' || date, '延期: ' || delay_days)"


def _hits(question: str, where: str, k: int = 10) -> str:
    return f"""{CTE}, d AS (SELECT *, {EVT} AS key, {_digits(_DOCUMENT)} AS v, {_digits(f"'{question}'")} AS q FROM ev WHERE {where}),
s AS (SELECT {_EVENT}, key, round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 6) AS score FROM d)
SELECT {_EVENT}, score FROM s ORDER BY score DESC, key LIMIT {k}"""


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, sf_dir, encode=digits)


def query(sql: str | None = None):
    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(engine(spark, sf_dir), lambda name: table(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return run

    return register


# questions, one a strategy

_OVERVIEW = f", p AS (SELECT style_id, count(*) AS people FROM ps GROUP BY 1), c AS (SELECT style_id, count(DISTINCT customer_id) AS customers FROM ev GROUP BY 1), o AS (SELECT style_id, people, customers, event_count, last_update, latest_category, total_delay_days FROM styles JOIN p USING (style_id) JOIN c USING (style_id))"


@query(f"{CTE}{_SLOTS}{_OVERVIEW} SELECT *, 'kg_overview' AS strategy FROM o WHERE style_id = {STYLE}")
def ask_overview(e, t):
    a = e.ask("这款号进展怎么样", style_ids=[STYLE, 7])
    return a.parts["overview"].withColumn("strategy", F.lit(a.strategy))


@query(f"{CTE}{_SLOTS}{_OWNERS}{_PEOPLE}{_OVERVIEW}, r AS (SELECT style_id FROM people JOIN styles USING (style_id) WHERE person = '{PERSON}' ORDER BY last_update DESC, style_id LIMIT 5) SELECT *, 'hybrid' AS strategy FROM o WHERE style_id IN (SELECT style_id FROM r)")
def ask_hybrid_overviews(e, t):
    """A question about a style that names none: it is resolved from the person's most recent ones, then routed again."""
    a = e.ask("我这款号的面料怎么处理", person_name=PERSON)
    return a.parts["overview"].withColumn("strategy", F.lit(a.strategy))


@query(_hits("面料 1995-11 款号42", f"style_id IN ({STYLE}, 7)"))
def ask_hybrid_hits(e, t):
    return e.ask("面料 1995-11 款号42", style_ids=[STYLE, 7]).parts["hits"]


@query(_hits("如何处理 1997-03-08", "true"))
def ask_semantic(e, t):
    return e.ask("如何处理 1997-03-08").parts["hits"]


@query(f"{CTE}, r AS (SELECT s_suppkey AS factory_id, s_name AS name, count(sf.style_id) AS style_count, CAST(coalesce(sum(total_delay_days), 0) AS BIGINT) AS total_delay_days, CAST(coalesce(sum(delay_event_count), 0) AS BIGINT) AS delay_event_count FROM supplier LEFT JOIN sf ON s_suppkey = sf.factory_id LEFT JOIN styles USING (style_id) GROUP BY 1, 2) SELECT * FROM r ORDER BY total_delay_days DESC, factory_id LIMIT 10")
def ask_factory_delays(e, t):
    return e.ask("哪家工厂延期最多").parts["factories"]


@query(f"{CTE}{_SLOTS}{_OWNERS}{_PEOPLE} SELECT style_id, role, p.event_count, last_update, latest_category, total_delay_days FROM people p JOIN styles USING (style_id) WHERE person = '{PERSON}' AND total_delay_days > 0 ORDER BY total_delay_days DESC, style_id LIMIT 10")
def ask_person_delays(e, t):
    return e.ask("我有哪些延期", person_name=PERSON).parts["delays"]


@query(f"{CTE}{_SLOTS}{_COLLAB} SELECT other, event_count, style_count FROM collab WHERE person = '{PERSON}' ORDER BY event_count DESC, other LIMIT 10")
def ask_collaborators(e, t):
    return e.ask("我和谁合作最多", person_name=PERSON).parts["people"]


# calls


@query(f"{CTE}{_SLOTS}{_OWNERS}{_PEOPLE}, top AS (SELECT person FROM slots GROUP BY 1 ORDER BY count(DISTINCT style_id) DESC, person LIMIT 1) SELECT style_id, role, p.event_count, last_update, latest_category, total_delay_days FROM people p JOIN styles USING (style_id) WHERE person = (SELECT person FROM top)")
def call_my_styles(e, t):
    return e.call("my_styles")


@query(_hits("1996-07 延期 30", "category IN ('RF', 'AF') AND delay_days >= 30 AND date >= '1996-01-01' AND date <= '1996-12-31'", 15))
def call_semantic_by_conditions(e, t):
    return e.call("semantic_search_by_conditions", query="1996-07 延期 30", categories=["RF", "AF"], min_delay_days=30, start="1996-01-01", end="1996-12-31", top_k=15)


@query(_hits("1994 11", "date >= '1994-06-01' AND date <= '1994-06-30'"))
def call_semantic_by_date(e, t):
    return e.call("semantic_search_by_date", query="1994 11", start="1994-06-01", end="1994-06-30")


@query(f"{CTE}, f AS (SELECT sf.style_id FROM sf JOIN supplier ON s_suppkey = sf.factory_id WHERE s_name = '{PERSON}') SELECT style_id, latest_category, event_count AS total_events, total_delay_days, last_update FROM styles WHERE style_id IN (SELECT style_id FROM f)")
def call_chain(e, t):
    return e.execute([("factory_styles", {"factory_name": PERSON}), ("style_summaries", {})])[0]


# small operators


@query("WITH w AS (SELECT DISTINCT lower(p_name) AS k, min(p_type) AS tr FROM part GROUP BY 1), a AS (SELECT p_name AS wanted FROM part UNION ALL SELECT 'no such ' || p_partkey FROM part) SELECT wanted, coalesce(tr, '未找到') AS translation, CASE WHEN k IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence FROM a LEFT JOIN w ON lower(wanted) = k")
def batch_translations(e, t):
    asked = t("part").select(F.col("p_name").alias("wanted")).unionAll(t("part").select(F.concat(F.lit("no such "), "p_partkey")))
    return V.batch_translate(e.terms, asked)


@query(r"""WITH g AS (SELECT lower(p_name) AS term, min(p_type) AS tr FROM part GROUP BY 1), q AS (SELECT p_partkey AS id, 'ask ' || p_partkey || ': ' || p_name || ' 问题' AS text, lower(p_name) AS k, p_name FROM part)
SELECT id, replace(text, p_name, p_name || ' ' || tr) AS expanded FROM q JOIN g ON k = term""")
def expanded_questions(e, t):
    q = t("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("ask "), "p_partkey", F.lit(": "), "p_name", F.lit(" 问题")).alias("text"))
    return T.expanded(q, "id", "text", e.terms).select("id", F.col("text").alias("expanded"))


@query(r"""WITH g AS (SELECT lower(p_name) AS term, min(p_type) AS tr FROM part GROUP BY 1)
SELECT p_partkey AS id, '=== 术语注释 ===' || chr(10) || '• ' || p_name || ' → ' || tr AS note FROM part JOIN g ON lower(p_name) = term""")
def term_notes(e, t):
    found = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("term"))
    return T.notes(found, "id", e.terms)


@query(f"SELECT s_suppkey AS user_id, s_name AS person FROM supplier WHERE lower(replace(s_name, '#', '.') || '@example.com') = 'supplier.000000003@example.com' LIMIT 1")
def person_by_email(e, t):
    users = t("supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("person"), F.concat(F.replace("s_name", F.lit("#"), F.lit(".")), F.lit("@example.com")).alias("email"))
    return V.person_by_email(users, "SUPPLIER.000000003@Example.com").select("user_id", "person")


@query("SELECT o_orderkey AS record, o_orderpriority AS subject, l_linenumber AS line, l_returnflag AS flag FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def attached_sources(e, t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("record")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"))).alias("events"))
    records = t("orders").select(F.col("o_orderkey").alias("record"), F.col("o_orderpriority").alias("subject")).join(lines, "record")
    return V.attached(records, "events", ["record", "subject"])


@query("SELECT coalesce(nullif(trim(source), ''), '未知') AS party, count(*) AS n FROM documents GROUP BY 1")
def party_defaults(e, t):
    return t("documents").groupBy(X.party_or_unknown(F.col("source")).alias("party")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type FROM events WHERE user_id = 7 AND event_type <> 'view'")
def owned_rows(e, t):
    return V.owned(t("events").where("event_type <> 'view'"), user_id=7).select("event_id", "event_type")


@query(f"""{CTE} SELECT style_id, '{{"style_id":' || style_id || ',"stage":"' || latest_category || '","状态":"' || CASE WHEN late_days > 0 THEN '延期' ELSE '正常' END || '"}}' AS json FROM styles""")
def json_results(e, t):
    late = F.when(F.col("late_days") > 0, "延期").otherwise("正常").alias("状态")
    return e.styles.select("style_id", F.to_json(F.struct("style_id", F.col("latest_category").alias("stage"), late)).alias("json"))


@query(f"SELECT CASE date_diff('day', CAST(ts AS DATE), DATE '{NOW_TS[:10]}') WHEN 0 THEN '今天' WHEN 1 THEN '昨天' WHEN 2 THEN '前天' ELSE month(ts) || '月' || day(ts) || '日 ' || hour(ts) || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') END AS label, count(*) AS n FROM events GROUP BY 1")
def session_days(e, t):
    return t("events").groupBy(X.day_label(F.col("ts"), F.lit(NOW_TS).cast("timestamp_ntz")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS stored, count(DISTINCT label) AS labels FROM embeddings")
def store_count(e, t):
    return t("embeddings").agg(F.count(F.lit(1)).alias("stored"), F.countDistinct("label").alias("labels"))
