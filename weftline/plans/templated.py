"""Queries over the answer templates, each beside its DuckDB SQL, registered with those of asked.py.

Delays are counted from a lead time of 60 days after the order, so that styles late, early and on time occur.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import templates as P
from ..operators import rollups as A
from .asked import query
from .domain import CTE, factories, style_factory
from .oracles import _SLOTS
from .queries import EV_SEQ, PERSON

LEAD = 60
_NL = "chr(10)"
#: Styles by their responsible person, with days past the lead time.
_MINE = f"""{CTE}, st AS (
  SELECT style_id, count(*) AS event_count, max(date) AS last_update, first(category ORDER BY date DESC, order_id, line, factory_id) AS stage, CAST(sum(delay_days - {LEAD}) AS BIGINT) AS days FROM ev GROUP BY 1
), mine AS (
  SELECT s_name AS person, s_nationkey AS dept_id, s_suppkey AS factory_id, st.*, row_number() OVER (PARTITION BY s_name ORDER BY style_id) AS i, row_number() OVER (PARTITION BY s_name ORDER BY days DESC, style_id) AS worst
  FROM sf JOIN supplier ON s_suppkey = sf.factory_id JOIN st USING (style_id)
)"""
#: Factories by department: days as the rollup has them, averages by style rounded to two digits.
_FACTORIES = f"""{_MINE}, fac AS (
  SELECT CAST(s_nationkey AS BIGINT) AS dept_id, s_suppkey AS factory_id, s_name AS name, CAST(count(style_id) AS BIGINT) AS n, CAST(coalesce(sum(days), 0) AS BIGINT) AS total FROM supplier LEFT JOIN mine ON s_name = person GROUP BY ALL
), avgs AS (SELECT *, total / greatest(n, 1) AS mean FROM fac
), ranked AS (SELECT *, row_number() OVER (PARTITION BY dept_id ORDER BY total DESC, factory_id) AS i FROM avgs
), ends AS (
  SELECT dept_id, first(name ORDER BY total DESC, factory_id) FILTER (total <> 0) AS w, first(total ORDER BY total DESC, factory_id) FILTER (total <> 0) AS wt, first(mean ORDER BY total DESC, factory_id) FILTER (total <> 0) AS wm,
    first(name ORDER BY mean DESC, factory_id) FILTER (mean <> 0) AS l, first(mean ORDER BY mean DESC, factory_id) FILTER (mean <> 0) AS lm FROM ranked GROUP BY 1
)"""


def _lines(line: str, order: str, where: str = "true") -> str:
    return f"string_agg({line}, {_NL} ORDER BY {order}) FILTER ({where})"


def _text(*lines: str) -> str:
    """Lines of an answer; those that are null are left out."""
    return f"concat_ws({_NL}, {', '.join(lines)})"


def _late(events: DataFrame) -> DataFrame:
    return events.withColumn("delay_days", F.col("delay_days") - LEAD)


def _mine(e) -> DataFrame:
    styles = A.style_rollup(_late(e.events), EV_SEQ)
    return e.made_by.select("style_id", F.col("name").alias("person")).join(styles, "style_id")


def _factories(e) -> DataFrame:
    ranked = A.factory_rollup(factories(e.spark, e.sf_dir), style_factory(e.spark, e.sf_dir), A.style_rollup(_late(e.events), EV_SEQ))
    mean = F.col("total_delay_days") / F.greatest("style_count", F.lit(1))
    return ranked.join(factories(e.spark, e.sf_dir).select("factory_id", "dept_id"), "factory_id").withColumn("avg_delay", mean)


@query(
    """SELECT p_name AS term, CASE WHEN p_size < 10 THEN '抱歉，未找到 **' || p_name || '** 的翻译。'
ELSE '**' || p_name || '** 译为：**' || p_type || '**' || CASE WHEN p_size < 20 THEN '' ELSE chr(10) || chr(10) || '分类：' || p_brand END || CASE WHEN p_size < 40 THEN '' ELSE chr(10) || chr(10) || '*' || p_name || '*' END END AS answer FROM part"""
)
def answer_translations(e, t):
    from_size = lambda c, least: F.when(F.col("p_size") >= least, F.col(c))
    return t("part").select(F.col("p_name").alias("term"), P.translation(F.col("p_name"), from_size("p_type", 10), from_size("p_brand", 20), from_size("p_name", 40)).alias("answer"))


@query(f"{_MINE} SELECT person, '共 **' || count(*) || '** 个：' || {_NL} || {_NL} || {_lines("i || '. **' || style_id || '** - ' || stage", 'i')} AS answer FROM mine GROUP BY 1")
def answer_style_lists(e, t):
    return P.listed(_mine(e), "person", ["style_id"])


_FIRST = "i <= 20"
_PROGRESS = _text(
    f"'共查询到 **' || count(*) || '** 个款号：' || {_NL}",
    f"'⚠️ **延期 (' || count(*) FILTER ({_FIRST} AND days > 0) || '个)**：' || {_NL} || {_lines("'  • **' || style_id || '** - ' || stage || ' - 延期' || days || '天'", 'i', f'{_FIRST} AND days > 0')} || {_NL}",
    f"'✅ **正常 (' || count(*) FILTER ({_FIRST} AND days <= 0) || '个)**：' || {_NL} || {_lines("'  • **' || style_id || '** - ' || stage", 'i', f'{_FIRST} AND days <= 0')} || {_NL}",
    "CASE WHEN count(*) > 20 THEN '*仅显示前 20 个，共 ' || count(*) || ' 个款号。如需查看全部，请说\"剩下的\"*' END",
)


@query(f"{_MINE} SELECT person, {_PROGRESS} AS answer FROM mine GROUP BY 1")
def answer_progress(e, t):
    return P.progress(_mine(e), "person", ["style_id"])


@query(f"{_MINE} SELECT person, '您目前负责 **' || count(*) || '** 个款号。' AS answer FROM mine GROUP BY 1")
def answer_counts(e, t):
    owned = e.made_by.groupBy(F.col("name").alias("person")).agg(F.count(F.lit(1)).alias("n"))
    return owned.select("person", P.counted(F.col("n")).alias("answer"))


_DELAYED = _text(
    f"'**延期款号**（共 ' || count(*) FILTER (days > 0) || ' 个）：' || {_NL}",
    _lines("'- **' || style_id || '** - 延期' || days || '天（' || stage || '）'", "worst", "days > 0 AND worst <= 20"),
    f"CASE WHEN count(*) FILTER (days > 0) > 20 THEN {_NL} || '*... 等共 ' || count(*) FILTER (days > 0) || ' 个款号*' END",
    f"CASE WHEN count(*) FILTER (days < 0) > 0 THEN {_NL} || '✅ 提前完成：' || count(*) FILTER (days < 0) || ' 个款号' END",
)


@query(f"{_MINE} SELECT person, CASE WHEN count(*) FILTER (days > 0) = 0 THEN '暂无延期款号。' ELSE {_DELAYED} END AS answer FROM mine GROUP BY 1")
def answer_delayed_styles(e, t):
    return P.delayed(_mine(e), "person")


_SUMMARY = "'| ' || style_id || ' | ' || stage || ' | ' || CASE WHEN days > 0 THEN '延期' WHEN days < 0 THEN '提前' ELSE '正常' END || ' | ' || CASE WHEN days = 0 THEN '-' ELSE days || '天' END || ' | ' || last_update || ' |'"


@query(f"{_MINE} SELECT person, {_text(f"'**款号摘要**（共 ' || count(*) || ' 个）：' || {_NL}", "'| 款号 | 当前阶段 | 状态 | 延期天数 | 最后更新 |'", "'|------|---------|------|---------|---------|'", _lines(_SUMMARY, 'i'))} AS answer FROM mine GROUP BY 1")
def answer_summaries(e, t):
    return P.summaries(_mine(e), "person", ["style_id"])


_OVERVIEW = _text(f"'**款号概览**（共 ' || count(*) || ' 个）：' || {_NL}", _lines("'- **' || style_id || '**：' || stage || '，' || event_count || ' 个事件，' || people || ' 人参与'", "i", "i <= 10"), "CASE WHEN count(*) > 10 THEN '- ... 等共 ' || count(*) || ' 个' END")


@query(f"{_MINE}{_SLOTS}, who AS (SELECT style_id, count(*) AS people FROM ps GROUP BY 1) SELECT person, {_OVERVIEW} AS answer FROM mine JOIN who USING (style_id) GROUP BY 1")
def answer_overviews(e, t):
    people = A.person_style(e.events).groupBy("style_id").agg(F.count(F.lit(1)).alias("people"))
    return P.overviews(_mine(e).join(people, "style_id"), "person", ["style_id"])


_STATS = f"concat_ws(' | ', '在制款号：**' || count(*) || '** 个', CASE WHEN count(*) FILTER (days > 0) > 0 THEN '⚠️ 延期：**' || count(*) FILTER (days > 0) || '** 个' END, CASE WHEN count(*) FILTER (days = 0) > 0 THEN '✅ 无延期：**' || count(*) FILTER (days = 0) || '** 个' END) || {_NL}"
_MADE = _text(
    f"'## 🏭 ' || person || {_NL}",
    _STATS,
    f"'**延期款号**：' || {_NL} || {_lines("'- **' || style_id || '**（延期' || days || '天）'", 'worst', 'days > 0 AND worst <= 10')} || CASE WHEN count(*) FILTER (days > 0) > 10 THEN {_NL} || '- ... 等共 ' || count(*) FILTER (days > 0) || ' 个' ELSE '' END || {_NL}",
    f"'**准时款号**（' || count(*) FILTER (days = 0) || ' 个）：' || string_agg(CAST(style_id AS VARCHAR), ', ' ORDER BY style_id) FILTER (days = 0 AND z <= 10) || {_NL}",
)


@query(f"{_MINE}, made AS (SELECT *, row_number() OVER (PARTITION BY person, days = 0 ORDER BY style_id) AS z FROM mine) SELECT person AS name, {_MADE} AS answer FROM made GROUP BY person")
def answer_factory_styles(e, t):
    return P.factory_styles(_mine(e).withColumnRenamed("person", "name"))


@query(
    f"""{_FACTORIES} SELECT dept_id, {_text("'**工厂延期排名**：'", "''", "'| 排名 | 工厂 | 总延期天数 | 平均延期 | 涉及款号 |'", "'|------|------|-----------|---------|---------|'",
    _lines("'| ' || i || ' | ' || name || ' | ' || total || ' | ' || printf('%.1f', mean) || ' | ' || n || ' |'", 'i'), f"{_NL} || '🔴 延期最严重：**' || any_value(w) || '**（总延期 ' || any_value(wt) || ' 天）'",
    "'🟡 平均延期最长：**' || any_value(l) || '**（平均 ' || printf('%.1f', any_value(lm)) || ' 天）'")} AS answer FROM ranked JOIN ends USING (dept_id) GROUP BY 1"""
)
def answer_factory_rankings(e, t):
    return P.factory_ranking(_factories(e), "dept_id")


@query(
    f"""{_FACTORIES} SELECT dept_id, {_text("'**工厂延期统计**：'", "''", f"'🔴 延期最严重工厂：**' || any_value(w) || '**' || {_NL} || '   - 总延期天数：' || any_value(wt) || {_NL} || '   - 平均延期：' || printf('%.1f', any_value(wm)) || ' 天' || {_NL}",
    f"'🟡 平均延期最长工厂：**' || any_value(l) || '**（' || printf('%.1f', any_value(lm)) || ' 天/款）' || {_NL}", "'**工厂列表**：'",
    _lines("'- **' || name || '**：总延期 ' || total || ' 天，平均 ' || printf('%.1f', mean) || ' 天，' || n || ' 个款号'", 'i'))} AS answer FROM ranked JOIN ends USING (dept_id) GROUP BY 1"""
)
def answer_factory_summaries(e, t):
    return P.factory_summary(_factories(e), "dept_id")


@query(
    f"""{CTE}{_SLOTS}, mine AS (SELECT * FROM ev WHERE party_from = '{PERSON}' OR party_to = '{PERSON}'), tog AS (SELECT party_to AS other, count(*) AS k FROM mine WHERE party_from <> party_to GROUP BY 1),
common AS (SELECT y.person AS other, count(*) AS s FROM ps x JOIN ps y USING (style_id) WHERE x.person = '{PERSON}' AND y.person IN (SELECT other FROM tog) GROUP BY 1),
c AS (SELECT other, k, coalesce(s, 0) AS s, row_number() OVER (ORDER BY k DESC, other) AS i FROM tog LEFT JOIN common USING (other))
SELECT '{PERSON}' AS person, {_text(f"'**{PERSON}** 的协作对象（共 ' || count(*) || ' 人）：' || {_NL}", "'| 排名 | 姓名 | 共同事件 | 共同款号 |'", "'|------|------|---------|---------|'", _lines("'| ' || i || ' | ' || other || ' | ' || k || ' | ' || s || ' |'", 'i', 'i <= 20'))} AS answer FROM c"""
)
def answer_collaborators(e, t):
    return P.collaborators(A.collaborators_of(e.events, PERSON).withColumn("person", F.lit(PERSON)))


_ROW = f"'| ' || date || ' | ' || style_id || ' | ' || category || ' | ' || event_type || ' | ' || CASE WHEN delay_days = {LEAD} THEN '-' ELSE (delay_days - {LEAD}) || '天' END || ' |'"


@query(
    f"""{CTE}, p AS (SELECT *, row_number() OVER (PARTITION BY style_id ORDER BY date, order_id, line, factory_id) AS i FROM ev)
SELECT style_id, {_text(f"'**事件详情**（共 ' || count(*) || ' 个）：' || {_NL}", "'| 时间 | 款号 | 阶段 | 描述 | 延期 |'", "'|------|------|------|------|------|'", _lines(_ROW, 'i', 'i <= 20'), f"CASE WHEN count(*) > 20 THEN {_NL} || '*... 等共 ' || count(*) || ' 个事件*' END")} AS answer FROM p GROUP BY 1"""
)
def answer_event_tables(e, t):
    return P.event_table(_late(e.events), "style_id", ["date", *EV_SEQ])


@query(
    f"""{CTE}, c AS (SELECT style_id, category, CAST(sum(delay_days - {LEAD}) FILTER (delay_days > {LEAD}) AS BIGINT) AS days FROM ev GROUP BY ALL)
SELECT style_id, {_text(f"'## ⚠️ 款号 ' || style_id || ' 延期分析' || {_NL} || {_NL} || '**累计延期：' || coalesce(sum(days), 0)::BIGINT || ' 天**' || {_NL}", f"'🔴 **当前瓶颈**：' || first(category ORDER BY days DESC, category) FILTER (days > 0) || {_NL}",
    f"'**各阶段延期分布**：' || {_NL} || {_lines("'- ' || category || '：' || days || ' 天'", 'days DESC, category', 'days > 0')} || {_NL}", f"'**延期阶段**：' || string_agg(category, ', ' ORDER BY category) FILTER (days > 0) || {_NL}")} AS answer FROM c GROUP BY 1"""
)
def answer_delay_analyses(e, t):
    return P.delay_analysis(_late(e.events))


@query(
    f"""{_MINE}{_SLOTS}, p AS (SELECT style_id, string_agg(person || '（participant）', ', ' ORDER BY event_count DESC, person) AS t FROM (SELECT *, row_number() OVER (PARTITION BY style_id ORDER BY event_count DESC, person) AS i FROM ps) WHERE i <= 10 GROUP BY 1),
c AS (SELECT style_id, string_agg('- ' || category || '：' || k || ' 个事件', {_NL} ORDER BY k DESC, category) AS t FROM (SELECT style_id, category, count(*) AS k FROM ev GROUP BY ALL) GROUP BY 1),
o AS (SELECT *, delay_days - {LEAD} AS d, row_number() OVER (PARTITION BY style_id ORDER BY date DESC, order_id, line, factory_id) AS i, row_number() OVER (PARTITION BY style_id ORDER BY delay_days DESC, order_id, line, factory_id) AS j FROM ev),
n AS (SELECT style_id, {_lines("'- ' || date || ' ' || category || '：' || event_type || CASE WHEN d = 0 THEN '' ELSE ' [延期' || d || '天]' END", 'i', 'i <= 5')} AS t, {_lines("'- ' || event_type || '（延期' || d || '天）'", 'j', 'd > 0 AND j <= 5')} AS l, count(*) FILTER (d > 0) AS ln FROM o GROUP BY 1)
SELECT style_id, {_text(f"'## 📋 款号 ' || style_id || {_NL}", f"concat_ws(' | ', '当前阶段：**' || stage || '**', '事件数：' || event_count, '最后更新：' || last_update, CASE WHEN days <> 0 THEN '⚠️ 累计延期：' || days || ' 天' END) || {_NL}",
    f"'**相关人员**：' || p.t || {_NL}", f"'**阶段分布**：' || {_NL} || c.t || {_NL}", f"'**最近事件**：' || {_NL} || n.t || {_NL}", f"'**延期事件**（' || ln || ' 个）：' || {_NL} || l || {_NL}")} AS answer FROM st JOIN p USING (style_id) JOIN c USING (style_id) JOIN n USING (style_id)"""
)
def answer_details(e, t):
    people = A.person_style(e.events.select("style_id", "party_from", "party_to").repartition("style_id")).withColumn("role", F.lit("participant"))
    return P.details(A.style_rollup(_late(e.unnamed), EV_SEQ), people, _late(e.unnamed))


#: Results of each shape: what they look like, and the query that they come from.
_RESULTS = [(f'{{"status":"success","call":{{"_note":1,"{name}":[1,2]}}}}', kind) for name, kind in P.QUERY_TYPES.items()] + [
    ('{"status":"success","style_summaries":[1],"_meta":{"n":1}}', P.CHAIN_TYPE),
    ('{"status":"success","events":[1,{"a":"}"}]}', P.QUERY_TYPES["events"]),
    ('{"status":"success","call":{"other":[]}}', P.UNKNOWN_TYPE),
    ('{"status":"error","_meta":{}}', P.UNKNOWN_TYPE),
    ("[1, 2]", P.UNKNOWN_TYPE),
]


def _chosen(key: Column) -> Column:
    return reduce(lambda found, i: F.when(key % len(_RESULTS) == i, _RESULTS[i][0]).otherwise(found), range(len(_RESULTS)), F.lit(""))


@query(f"SELECT o_orderkey AS order_id, CASE o_orderkey % {len(_RESULTS)} {' '.join(f"WHEN {i} THEN '{kind}'" for i, (_, kind) in enumerate(_RESULTS))} END AS query_type FROM orders")
def result_query_types(e, t):
    return t("orders").select(F.col("o_orderkey").alias("order_id"), P.query_type(_chosen(F.col("o_orderkey"))).alias("query_type"))


_NAMED = [(name, template) for template, names in P.TEMPLATES.items() for name in [*names, f"no_{template}"]]


@query(f"SELECT c_custkey AS customer_id, CASE c_custkey % {len(_NAMED)} {' '.join(f"WHEN {i} THEN '{template}'" for i, (name, template) in enumerate(_NAMED) if not name.startswith('no_'))} END AS template FROM customer")
def template_names(e, t):
    names = F.array(*[F.lit(name) for name, _ in _NAMED])
    return t("customer").select(F.col("c_custkey").alias("customer_id"), P.template_of(F.get(names, (F.col("c_custkey") % len(_NAMED)).cast("int"))).alias("template"))
