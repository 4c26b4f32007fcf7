"""Queries over the library's smaller functions, each beside its DuckDB SQL, registered with those of asked.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as M
from ..functions import dialogue as D
from ..functions import replies as Q
from ..functions import reports as P
from ..functions import text as X
from ..operators import datasets as B
from ..operators import graph as G
from ..operators import health as H
from ..operators import mail_job as J
from ..operators import questions as K
from ..operators import rollups as A
from ..operators import shaping as O
from ..sources import readers, writers
from ..streaming.pointer import shared_folder
from . import asked, built, jobs, templated, texts  # noqa: F401  (registers its queries)
from . import planner as R
from .asked import query
from .domain import CTE, SEQ, departments, factories, style_factory
from .oracles import _MESSAGE, _OWNERS, _PEOPLE, _SLOTS
from .queries import EV_SEQ, NOW, owners

QUERIES, ORACLE_SQL = asked.QUERIES, asked.ORACLE_SQL
_NL = "chr(10)"


def _number(key: str, what: str, n: int) -> str:
    return f"(CAST('0x' || substr(md5('{what}:' || {key} || '-42'), 1, 6) AS BIGINT) % {n})"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def _choice(key: str, what: str, values) -> str:
    return f"{_list(values)}[{_number(key, what, len(values))} + 1]"


# planning and training sets


@query(f"{CTE} SELECT 'fabric' AS asked, style_id FROM styles WHERE style_id IN (SELECT style_id FROM ev WHERE category = 'RF') UNION ALL SELECT 'zipper', style_id FROM styles UNION ALL SELECT 'nothing', style_id FROM styles")
def narrowed_scope(e, t):
    """Styles that a question's words narrow to; words that no style has, or none at all, narrow nothing."""
    labelled = e.events.select("style_id", F.when(F.col("category") == "RF", "面料").otherwise("其他").alias("category"))
    narrow = lambda name, text: R.narrow_scope(e.styles.select("style_id"), labelled, text).select(F.lit(name).alias("asked"), "style_id")
    return narrow("fabric", "色卡到了吗").unionByName(narrow("zipper", "拉链呢")).unionByName(narrow("nothing", "你好"))


@query("""WITH c AS (SELECT conv_id * 100 + turn AS case_id, text, ['v1', 'v2', 'v3'][turn % 3 + 1] AS r FROM conversations WHERE role = 'user'), o AS (SELECT *, list_filter(['v1', 'v2', 'v3'], lambda x: x <> r) AS others, CAST('0x' || substr(md5(case_id || '-42'), 1, 6) AS BIGINT) % 2 AS pos FROM c)
SELECT case_id, text AS instruction, r AS chosen, others[pos + 1] AS rejected FROM o""")
def router_preferences(e, t):
    cases = t("conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("case_id"), F.col("text").alias("user_input"), F.get(F.array(*map(F.lit, ["v1", "v2", "v3"])), (F.col("turn") % 3).cast("int")).alias("expected_route"))
    return B.router_pairs(cases, ["v1", "v2", "v3"])


@query("WITH e AS (SELECT s_name AS v FROM supplier ORDER BY md5(s_name || '-42'), s_name LIMIT 4) SELECT CAST(r_regionkey AS BIGINT) AS template_id, r_name AS scene, v || ' 在 ' || r_name || ' 的延期' AS text FROM region, e")
def instantiated_templates(e, t):
    templates = t("region").select(F.col("r_regionkey").cast("long").alias("template_id"), F.col("r_name").alias("scene"), F.concat(F.lit("{} 在 "), "r_name", F.lit(" 的延期")).alias("template"))
    return B.instantiated(templates, t("supplier").select(F.col("s_name").alias("slot_value")), 4)


@query(f"{CTE} SELECT style_id, least(8192, greatest(2048, 800 + 60 * event_count)) AS max_tokens FROM styles")
def report_lengths(e, t):
    return e.styles.select("style_id", B.max_tokens(F.col("event_count")).alias("max_tokens"))


@query(f"SELECT conv_id || ':' || turn AS k, {_list(R.SINGLES)}[conv_id % {len(R.SINGLES)} + 1] AS interface, {_choice('(conv_id || turn)', 'term', K.TERMS)} AS term, {_choice('(conv_id || turn)', 'search', K.SEARCHES)} AS search, {_choice('(conv_id || turn)', 'delay', K.DELAYS)} AS delay, 1 + {_number('(conv_id || turn)', 'stages', 3)} AS n_stages, 1 + {_number('(conv_id || turn)', 'stages', 3)} AS n_distinct FROM conversations")
def sampled_parameters(e, t):
    k = F.concat(F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    stages = K.some(k, "stages", K.STAGES)
    size = lambda c: F.size(c).cast("long")
    return t("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("k"), F.get(F.array(*map(F.lit, R.SINGLES)), (F.col("conv_id") % len(R.SINGLES)).cast("int")).alias("interface"), K.choice(k, "term", K.TERMS).alias("term"), K.choice(k, "search", K.SEARCHES).alias("search"), K.choice(k, "delay", K.DELAYS).alias("delay"), size(stages).alias("n_stages"), size(F.array_distinct(F.array_intersect(stages, F.array(*map(F.lit, K.STAGES))))).alias("n_distinct"))


_KEPT = ["my_styles", "person_styles", "factory_styles", "collaborators", "factory_delays", "term_translation", "semantic_search", "semantic_search_by_date", "style_overview", "style_summaries", "timeline"]


@query(f"""{CTE}, top AS (SELECT list(s_name ORDER BY s_suppkey) AS f FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT {K.MOST_FACTORIES})), st AS (SELECT list(style_id ORDER BY style_id) AS s FROM (SELECT style_id FROM styles ORDER BY style_id LIMIT 3)),
c AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS k, {_list(_KEPT)}[conv_id % {len(_KEPT)} + 1] AS interface FROM conversations),
p AS (SELECT conv_id, interface, k, f[CAST('0x' || substr(md5('factory:' || k || '-42'), 1, 6) AS BIGINT) % len(f) + 1] AS fac, s[CAST('0x' || substr(md5('style:' || k || '-42'), 1, 6) AS BIGINT) % len(s) + 1] AS sty, array_to_string(s, ',') AS three FROM c, top, st)
SELECT conv_id, interface, '{{"type":"' || interface || '"' || CASE interface WHEN 'my_styles' THEN '' WHEN 'person_styles' THEN ',"person_name":"Q"' WHEN 'factory_styles' THEN ',"factory_name":"' || fac || '"' WHEN 'collaborators' THEN ',"person_name":"Q","top_k":10' WHEN 'factory_delays' THEN ',"top_k":10'
 WHEN 'term_translation' THEN ',"query":"' || {_choice('k', 'term', K.TERMS)} || '"' WHEN 'semantic_search' THEN ',"query":"' || {_choice('k', 'search', K.SEARCHES)} || '"' WHEN 'semantic_search_by_date' THEN ',"days":365' WHEN 'style_summaries' THEN ',"style_ids":[' || three || ']' ELSE ',"style_id":' || sty END || '}}' AS params FROM p""")
def built_calls(e, t):
    names = [r[0] for r in t("supplier").orderBy("s_suppkey").limit(K.MOST_FACTORIES).select("s_name").collect()]
    three = [r[0] for r in e.styles.select("style_id").orderBy("style_id").limit(3).collect()]
    asked_ = t("conversations").select("conv_id").distinct().withColumn("interface", F.get(F.array(*map(F.lit, _KEPT)), (F.col("conv_id") % len(_KEPT)).cast("int")))
    return K.calls(asked_, "conv_id", "interface", "Q", names, three)


@query(f"{CTE}, d AS (SELECT s_name AS question, style_id, row_number() OVER (PARTITION BY s_name ORDER BY last_update DESC, style_id) AS rn, count(*) OVER (PARTITION BY s_name) AS dependency_count FROM sf JOIN supplier ON s_suppkey = sf.factory_id JOIN styles USING (style_id)) SELECT question, dependency_count, style_id, latest_category, event_count FROM d JOIN styles USING (style_id) WHERE rn = 1")
def sampled_chains(e, t):
    first = e.made_by.join(e.styles.select("style_id", "last_update"), "style_id").select(F.col("name").alias("question"), "style_id", "last_update")
    return K.chain_samples(first, e.styles.select("style_id", "latest_category", "event_count"), "question", [F.col("last_update").desc(), "style_id"])


@query("""WITH q AS (SELECT role AS kind, CASE WHEN turn % 3 = 0 THEN 'failed' ELSE 'success' END AS status FROM conversations), c AS (SELECT kind, count(*) AS n, count(*) FILTER (status = 'success') AS success FROM q GROUP BY 1 UNION ALL SELECT 'total', count(*), count(*) FILTER (status = 'success') FROM q)
SELECT kind, n, success, round_even(100.0 * success / n, 1)::DOUBLE AS rate FROM c""")
def question_validation(e, t):
    rows = t("conversations").select("role", F.when(F.col("turn") % 3 == 0, "failed").otherwise("success").alias("status"))
    return K.validation(rows, "role")


@query(f"""{CTE} SELECT style_id, '{{"type":"timeline","filters":{{"date":{{"start":"' || last_update || '"}}}}}}' AS made, '{{"filters":{{"stage":"' || latest_category || '","date":"' || last_update || '"}}}}' AS kept FROM styles""")
def nested_parameters(e, t):
    made = K.with_path(F.struct(F.lit("timeline").alias("type")), "filters.date.start", F.col("last_update"))
    kept = K.with_path(F.struct(F.struct(F.col("latest_category").alias("stage")).alias("filters")), "filters.date", F.col("last_update"), {"filters": {}})
    return e.styles.select("style_id", F.to_json(made).alias("made"), F.to_json(kept).alias("kept"))


@query("""WITH l AS (SELECT l_orderkey AS seed, l_linenumber AS line, l_linenumber % 2 AS late FROM lineitem), v AS (SELECT seed, line, CASE WHEN line > 2 THEN 'ask' ELSE 'ask ' || line END AS prompt, CASE WHEN seed % 5 = 0 THEN 'a' || line ELSE 'a' END AS answer, CASE WHEN late = 1 AND seed % 3 <> 0 THEN [7, line] WHEN late = 1 THEN [7] ELSE [7] END AS ids FROM l)
, n AS (SELECT seed, count(*) AS variants, count(DISTINCT prompt) AS distinct_prompts, count(DISTINCT answer) <= 1 AS same_answer, min(len(list_distinct(ids))) AS least FROM v GROUP BY 1), u AS (SELECT seed, count(DISTINCT i) AS all_late FROM (SELECT seed, unnest(ids) AS i FROM v) GROUP BY 1)
SELECT seed, variants, distinct_prompts, same_answer, least = all_late AS keeps_delays FROM n JOIN u USING (seed)""")
def augmentation_checks(e, t):
    line, seed = F.col("l_linenumber").cast("long"), F.col("l_orderkey")
    event = lambda i, d: F.struct(i.alias("id"), F.lit(d).alias("delay_days"))
    more = F.when((line % 2 == 1) & (seed % 3 != 0), F.array(event(F.lit(7).cast("long"), 3), event(line, 1))).otherwise(F.array(event(F.lit(7).cast("long"), 3), event(line, -1)))
    rows = t("lineitem").select(seed.alias("seed"), F.when(line > 2, "ask").otherwise(F.concat(F.lit("ask "), line.cast("string"))).alias("prompt"), F.when(seed % 5 == 0, F.concat(F.lit("a"), line.cast("string"))).otherwise("a").alias("answer"), more.alias("events"))
    return K.augmentation(rows, "seed", "prompt", "answer", "events")


# replies


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 2 THEN '输出被截断' ELSE 't' || p_partkey END AS thought, p_partkey % 3 = 0 AS satisfied, CASE WHEN p_partkey % 3 = 0 THEN 'list' END AS template, CASE WHEN p_partkey % 3 = 0 THEN 'm' || p_partkey END AS message FROM part")
def salvaged_replies(e, t):
    k = F.col("p_partkey").cast("string")
    whole = F.concat(F.lit('{"thought": "t'), k, F.lit('", "satisfied": true, "calls": [{"name": "generate_answer", "template": "list", "message": "m'), k, F.lit('"'))
    half = F.concat(F.lit('{"thought": "t'), k, F.lit('", "satisfied": false, "calls": [{"name": "generate_ans'))
    text = F.when(F.col("p_partkey") % 3 == 0, whole).when(F.col("p_partkey") % 3 == 1, half).otherwise('{"thou')
    return t("part").select(F.col("p_partkey").alias("id"), Q.salvaged(text).alias("s")).select("id", "s.*")


@query("SELECT p_partkey AS id, CAST(p_partkey AS BIGINT) AS item FROM part UNION ALL SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 2 = 1")
def listed_items(e, t):
    k = F.col("p_partkey")
    text = F.when(k % 2 == 0, F.format_string('[{"k": %d}]', k)).otherwise(F.format_string('{"total": 2, "items": [{"k": %d}, {"k": %d}], "more": false}', k, k + 1))
    found = Q.first_list(F.array().cast("array<struct<k:bigint>>"), Q.json_list(text, "struct<k:bigint>"))
    return t("part").select(k.alias("id"), F.explode(found).alias("x")).select("id", F.col("x.k").alias("item"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '## 📋 ' || p_name || chr(10) || '# x' WHEN 1 THEN '# ' || p_name ELSE p_name END AS report FROM part")
def reports_from_heading(e, t):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("好的：\n## 📋 "), "p_name", F.lit("\n# x"))).when(k == 1, F.concat(F.lit("说明\n# "), "p_name")).otherwise(F.col("p_name"))
    return t("part").select(F.col("p_partkey").alias("id"), Q.from_heading(text).alias("report"))


@query(f"{CTE} SELECT style_id, style_id % 4 = 0 AS valid, CASE style_id % 4 WHEN 0 THEN '' WHEN 1 THEN '未知类别: 外星' WHEN 2 THEN '输入没有的日期: 1901-01-01' ELSE '未发现 Markdown 表格' END AS errors, CASE WHEN style_id % 4 IN (1, 3) THEN '未包含类别: 面料' ELSE '' END AS warnings FROM styles")
def validated_reports(e, t):
    k = F.col("style_id") % 4
    row = F.concat(F.lit("| 阶段 | 类型 | 日期 | 说明 |\n|---|---|---|---|\n| "), F.when(k == 1, "外星").otherwise("面料"), F.lit(" | 提交 | "), F.when(k == 2, "1901-01-01").otherwise(F.col("last_update")), F.lit(" | x |\n"))
    text = F.concat(F.lit("### 时间线\n"), F.when(k == 3, "").otherwise(row), F.lit("结论"))
    v = e.styles.select("style_id", Q.validate(text, F.array("last_update"), F.array(F.lit("面料")), F.lit("")).alias("v"))
    return v.select("style_id", "v.valid", F.array_join("v.errors", ";").alias("errors"), F.array_join("v.warnings", ";").alias("warnings"))


@query(r"""WITH cells AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<table[^>]*>(.*?)</table>', 1), lambda tb: list_filter(list_transform(regexp_extract_all(tb, '(?is)<tr[^>]*>(.*?)</tr>', 1), lambda r: list_filter(list_transform(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: trim(regexp_replace(regexp_replace(c, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), lambda c: c <> '')), lambda r: len(r) > 0)), lambda tb: len(tb) >= 2) AS ts FROM pages)
SELECT page_id, CAST(len(ts) AS BIGINT) AS tables, array_to_string(list_transform(ts, lambda tb: array_to_string(list_transform(tb, lambda r: array_to_string(r, '|')), ';')), '#') AS cells FROM cells""")
def html_table_cells(e, t):
    found = X.html_tables(F.col("html"))
    text = F.array_join(F.transform(found, lambda tb: F.array_join(F.transform(tb, lambda r: F.array_join(r, "|")), ";")), "#")
    return t("pages").select("page_id", F.size(found).cast("long").alias("tables"), text.alias("cells"))


# answers


@query(f"{CTE}{_SLOTS}{_OWNERS}{_PEOPLE}, own AS (SELECT style_id, min(person) FILTER (role = 'owner') AS o, string_agg('- ' || person, {_NL} ORDER BY event_count DESC, person) AS body, first(person ORDER BY event_count DESC, person) AS most FROM people GROUP BY 1) SELECT style_id, '### 款号 ' || style_id || ' 涉及人员' || {_NL} || {_NL} || CASE WHEN o IS NULL THEN '' ELSE '**主要负责人：' || o || '**' || {_NL} || {_NL} END || '参与人员：' || {_NL} || body AS answer, style_id || ' 负责人：' || coalesce(o, most) AS concise FROM own")
def people_answers(e, t):
    found = G.people_by_style(A.person_style(e.events), owners(e.spark, e.sf_dir))
    return M.people(found).join(P.responsible(found).withColumnRenamed("answer", "concise"), "style_id")


@query(f"""WITH h AS (SELECT p_size AS query_id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS rank, p_name AS c, p_type AS e, p_brand AS b FROM part), r AS (SELECT query_id, string_agg('- ' || c || ' → ' || e, {_NL} ORDER BY rank) AS rest FROM h WHERE rank BETWEEN 2 AND 4 GROUP BY 1)
SELECT query_id, '**' || c || '**' || {_NL} || {_NL} || '英文：' || e || {_NL} || '分类：' || b || coalesce({_NL} || {_NL} || '相关术语：' || {_NL} || rest, '') AS answer FROM h LEFT JOIN r USING (query_id) WHERE rank = 1""")
def term_answers(e, t):
    hits = O.first_n(t("part").select(F.col("p_size").alias("query_id"), "p_partkey", F.col("p_name").alias("chinese"), F.col("p_type").alias("english"), F.col("p_brand").alias("category")), ["query_id"], ["p_partkey"], 5)
    return M.terms(hits.withColumnRenamed("rn", "rank"))


@query(f"{CTE} SELECT style_id, style_id || ' 最新：' || first(category ORDER BY date DESC, order_id, line, factory_id) || ' - ' || first(event_type ORDER BY date DESC, order_id, line, factory_id) || '（' || max(date) || '）' AS answer FROM ev GROUP BY 1")
def latest_answers(e, t):
    return P.latest(e.events)


@query(f"{CTE} SELECT style_id, md5('### 款号 ' || style_id || ' 延期分析' || {_NL} || {_NL} || '共发现 **' || count(*) || '** 个延期事件：' || {_NL} || {_NL} || string_agg('- **' || date || '** | ' || category || {_NL} || '  - 延期天数：**' || delay_days || ' 天**' || {_NL} || '  - 事件类型：' || event_type || {_NL}, {_NL} ORDER BY date, order_id, line, factory_id) || {_NL} || '**累计延期：' || CAST(sum(delay_days) AS BIGINT) || ' 天**') AS answer_md5 FROM ev WHERE delay_days > 0 GROUP BY 1")
def delay_detail_answers(e, t):
    return P.delay_details(e.events).select("style_id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"))



@query(f"""{CTE}, n AS (SELECT *, (row_number() OVER (PARTITION BY style_id ORDER BY date, order_id, line, factory_id) - 1) // 20 + 1 AS round, CAST(ceil(count(*) OVER (PARTITION BY style_id) / 20.0) AS BIGINT) AS total FROM ev),
r AS (SELECT style_id, round, '## 📋 款号 ' || style_id || ' 时间线分析（第 ' || round || '/' || total || ' 部分）' || {_NL} || {_NL} || array_to_string({_list(P.REPORT_HEAD)}, {_NL}) || {_NL} || string_agg('| ' || category || ' | ' || event_type || ' | ' || date || ' | ' || CASE WHEN delay_days > 0 THEN delay_days || '天' ELSE '-' END || ' |  | 📧  |', {_NL} ORDER BY date, order_id, line, factory_id) || {_NL} || array_to_string({_list(P.REPORT_FOOT)}, {_NL}) AS report FROM n GROUP BY style_id, round, total)
SELECT style_id, md5(string_agg(report, {_NL} || {_NL} || '---' || {_NL} || {_NL} ORDER BY round)) AS report_md5 FROM r GROUP BY 1""")
def plain_report_rounds(e, t):
    rounds = O.chunks(e.events, ["style_id"], ["date", *EV_SEQ], 20)
    return P.merged(P.plain_reports(rounds, ["date", *EV_SEQ])).select("style_id", F.md5(F.col("report").cast("binary")).alias("report_md5"))


@query(f"WITH u AS (SELECT conv_id, CAST(sum({_MESSAGE}) AS BIGINT) AS used FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN used >= 400 THEN '上下文已满，请开始新的会话。' WHEN used >= 320 THEN '上下文已使用 ' || CAST(floor(100 * used / 400.0) AS INTEGER) || '%。' ELSE '' END AS note FROM u")
def context_notes(e, t):
    used = t("conversations").groupBy("conv_id").agg(F.sum(X.message_tokens(F.col("role"), F.col("text"))).alias("used"))
    return used.select("conv_id", M.context_warning(F.col("used"), 400).alias("note"))


@query(f"""{CTE} SELECT style_id, CASE WHEN event_count > 20 THEN '共' || event_count || '条，显示20条（按延期优先）' ELSE '' END AS note, style_id || CASE WHEN event_count > 20 THEN {_NL} || '[上下文警告] 结果已截断。原始' || event_count || '条，仅返回20条（达到上下文上限）。如需查看剩余内容，请说"继续"或"剩下的"。' ELSE '' END AS warned FROM styles""")
def cut_notes(e, t):
    n, shown = F.col("event_count"), F.lit(20)
    return e.styles.select("style_id", P.cut_note(n, shown, "BY_DELAY").alias("note"), P.with_warning(F.col("style_id").cast("string"), n, shown).alias("warned"))


@query(f"""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '【查询结果】' || {_NL} || {_NL} || '```json' || {_NL} || '{{"n":' || p_size || '}}' || {_NL} || '```' WHEN 2 THEN p_type || {_NL} || {_NL} || '{P.THOUGHT_NOTE}' ELSE '{P.NO_ANSWER}' END AS answer FROM part""")
def fallback_answers(e, t):
    k = F.col("p_partkey") % 4
    return t("part").select(F.col("p_partkey").alias("id"), P.fallback(F.when(k == 0, F.col("p_name")), F.when(k <= 1, F.to_json(F.struct(F.col("p_size").alias("n")))), F.when(k <= 2, F.col("p_type")).otherwise("")).alias("answer"))


@query(f"""{CTE}, p AS (SELECT s_suppkey AS factory_id, s_name AS name, count(sf.style_id) AS total FROM supplier LEFT JOIN sf ON s_suppkey = sf.factory_id GROUP BY 1, 2), j AS (SELECT sf.factory_id, style_id, total_delay_days, last_update, latest_category, CASE WHEN style_id % 2 = 0 THEN p_name END AS alias FROM sf JOIN styles USING (style_id) JOIN part ON p_partkey = style_id),
k AS (SELECT *, style_id || coalesce('（' || alias || '）', '') AS shown FROM j), r AS (SELECT * FROM k WHERE total_delay_days > 0 QUALIFY row_number() OVER (PARTITION BY factory_id ORDER BY total_delay_days DESC, style_id) <= 5), n AS (SELECT * FROM k WHERE last_update >= '1998-11-01'),
rr AS (SELECT factory_id, '## ⚠️ 风险提醒（' || count(*) || '个）' || {_NL} || string_agg('- **' || shown || '**：已延期' || total_delay_days || '天（' || latest_category || '）', {_NL} ORDER BY total_delay_days DESC, style_id) || {_NL} AS risks FROM r GROUP BY 1), nn AS (SELECT factory_id, '## 📋 昨日动态（' || count(*) || '条）' || {_NL} || string_agg('- **' || shown || '**：' || latest_category, {_NL} ORDER BY last_update DESC, style_id) || {_NL} AS news FROM n GROUP BY 1)
SELECT factory_id, '# 早安，' || name || {_NL} || {_NL} || '您负责 **' || total || '** 个款号，今日概览如下：' || {_NL} || coalesce({_NL} || risks, '') || coalesce({_NL} || news, '') || CASE WHEN risks IS NULL AND news IS NULL THEN {_NL} || '{P.NOTHING_NEW}' ELSE '' END || {_NL} || {_NL} || '---' || {_NL} || '{P.PUSH_FOOT}' AS content FROM p LEFT JOIN rr USING (factory_id) LEFT JOIN nn USING (factory_id)""")
def morning_messages(e, t):
    made = e.made_by.select("factory_id", "style_id")
    people = factories(e.spark, e.sf_dir).join(made.groupBy("factory_id").agg(F.count(F.lit(1)).alias("n")), "factory_id", "left").select("factory_id", "name", F.coalesce("n", F.lit(0)).alias("total"))
    names = t("part").select(F.col("p_partkey").alias("style_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("alias"))
    told = made.join(e.styles, "style_id").join(names, "style_id")
    reason = F.concat(F.format_string("已延期%d天（", "total_delay_days"), "latest_category", F.lit("）"))
    risks = O.first_n(told.where("total_delay_days > 0"), ["factory_id"], [F.col("total_delay_days").desc(), "style_id"], 5).withColumn("reason", reason).withColumn("rank", -F.col("total_delay_days"))
    news = told.where("last_update >= '1998-11-01'").withColumn("event", F.col("latest_category")).withColumn("rank", F.datediff(F.lit(NOW).cast("date"), F.try_to_date("last_update")))
    return P.morning(people, risks, news, "factory_id")


# conversations


@query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'A1 怎么样了' WHEN 1 THEN 'A1, A2, ' || p_partkey || ' 哪个更有风险' WHEN 2 THEN 'A2 延期了吗' WHEN 3 THEN '第9个呢' ELSE '为什么' END AS rewritten, p_partkey % 2 = 0 AS mixed FROM part")
def rewritten_questions(e, t):
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, "这个款号 怎么样了").when(k % 5 == 1, "这几个款号 哪个更有风险").when(k % 5 == 2, "第2个 延期了吗").when(k % 5 == 3, "第9个呢").otherwise("为什么")
    remembered = F.when(k % 5 == 0, F.array(F.lit("A0"), F.lit("A1"))).otherwise(F.array(F.lit("A1"), F.lit("A2"), k.cast("string")))
    both = F.when(k % 2 == 0, "CCSS230021 的信息，顺便看看所有款号").otherwise("CCSS230021 的信息")
    return t("part").select(k.alias("id"), D.rewritten(text, remembered).alias("rewritten"), D.mixed(both).alias("mixed"))


@query(f"""{CTE}, r AS (SELECT style_id, string_agg('v2:' || category || '|tool:' || n, '|' ORDER BY category) AS rounds FROM (SELECT style_id, category, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY 1)
SELECT style_id, 'user:' || style_id || '|v3:kg|' || rounds || CASE WHEN style_id % 2 = 0 THEN '|v1:report' ELSE '' END || '|assistant:ok' AS messages FROM r""")
def session_messages(e, t):
    by = e.events.groupBy("style_id", "category").agg(F.count(F.lit(1)).alias("n")).groupBy("style_id").agg(F.array_sort(F.collect_list(F.struct(F.col("category").alias("call"), F.col("n").cast("string").alias("result")))).alias("rounds"))
    told = by.select("style_id", D.session(F.col("style_id").cast("string"), F.lit("kg"), F.col("rounds"), F.when(F.col("style_id") % 2 == 0, "report"), F.lit("ok")).alias("m"))
    return told.select("style_id", F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["role"], x["content"])), "|").alias("messages"))


# stores


@query(f"""{CTE}, a AS (SELECT p_partkey + 10 AS style_id, CAST(p_size > 10 AS INTEGER) AS results FROM part), m AS (SELECT (SELECT count(*) FILTER (results > 0) / count(*) FROM a) AS hit_rate, (SELECT count(*) FILTER (style_id IN (SELECT style_id FROM ev)) / count(*) FROM a) AS coverage, (SELECT date_diff('day', CAST(max(date) AS DATE), DATE '{NOW}') FROM ev) AS age_days, (SELECT count(*) FILTER (n = 0) / count(*) FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)) AS failure_rate)
SELECT hit_rate, coverage, age_days, failure_rate, concat_ws(',', CASE WHEN hit_rate < 0.8 THEN 'hit_rate' END, CASE WHEN coverage < 0.7 THEN 'coverage' END, CASE WHEN age_days > 30 THEN 'age_days' END, CASE WHEN failure_rate > 0.1 THEN 'failure_rate' END) AS alerts FROM m""")
def store_monitoring(e, t):
    asked_ = t("part").select((F.col("p_partkey") + 10).alias("style_id"), (F.col("p_size") > 10).cast("int").alias("results"))
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_events"))
    done = t("orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return H.monitoring(asked_, e.events.select("style_id", "date"), done, F.lit(NOW).cast("date"))


@query(f"""{CTE}, s AS (SELECT s_suppkey AS factory_id, s_name AS name, count(sf.style_id) AS style_count FROM supplier LEFT JOIN sf ON s_suppkey = sf.factory_id GROUP BY 1, 2), n AS (SELECT p_partkey AS style_id, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 100000 + p_size END AS factory_id FROM part WHERE p_partkey IN (SELECT style_id FROM ev)), m AS (SELECT factory_id, count(*) AS more FROM n GROUP BY 1),
edges AS (SELECT factory_id, count(*) AS edges FROM (SELECT style_id, factory_id FROM sf UNION SELECT style_id, factory_id FROM n) GROUP BY 1) SELECT factory_id, coalesce(name, 'F' || (factory_id - 100000)) AS name, coalesce(style_count, 0) + coalesce(more, 0) AS style_count, coalesce(edges, 0) AS edges FROM s FULL JOIN m USING (factory_id) LEFT JOIN edges USING (factory_id)""")
def factory_mappings(e, t):
    made = style_factory(e.spark, e.sf_dir)
    old = A.factory_rollup(factories(e.spark, e.sf_dir), made, e.styles).select("factory_id", "name", "style_count")
    size = F.col("p_size").cast("long")
    new = t("part").select(F.col("p_partkey").alias("style_id"), F.when(F.col("p_partkey") % 2 == 0, F.lit(1).cast("long")).otherwise(100000 + size).alias("factory_id"), F.concat(F.lit("F"), size.cast("string")).alias("name"))
    after, edges = H.mapped(old, made, e.styles, new.unionByName(new.limit(0)))
    return after.join(edges.groupBy("factory_id").agg(F.count(F.lit(1)).alias("edges")), "factory_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


@query("SELECT CASE WHEN confidence >= 70 THEN 'passed' WHEN confidence >= 50 THEN 'review' ELSE 'discarded' END AS tier, count(*) AS n, CAST(sum(order_id) AS BIGINT) AS orders FROM ev GROUP BY 1".join([CTE + " ", ""]))
def tiers_written(e, t):
    """Events by tier, written as JSON in a folder a tier and read back."""
    at = shared_folder(e.spark)
    writers.write_tiers(A.tiers(e.events.drop("shipped")), at)
    return e.spark.read.schema("order_id long, tier string").json(at).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("order_id").alias("orders"))


@query("SELECT p_size AS size, 2 * count(*) AS n FROM part GROUP BY 1")
def log_appended(e, t):
    at = f"{shared_folder(e.spark)}/log"
    for _ in range(2):
        writers.append_log(t("part").select("p_size"), at)
    return readers.read_jsonl(e.spark, at, "p_size int").groupBy(F.col("p_size").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH h AS (SELECT DISTINCT conv_id, CAST('0x' || substr(md5(conv_id || '-42'), 1, 6) AS BIGINT) % 100 AS p FROM conversations) SELECT CASE WHEN p < 80 THEN 'train' WHEN p < 90 THEN 'val' ELSE 'test' END AS split, conv_id FROM h")
def splits_written(e, t):
    at = f"{shared_folder(e.spark)}/splits"
    rows = t("conversations").select("conv_id").distinct()
    writers.write_splits(rows.select("conv_id", B.split(F.col("conv_id")).alias("split")), at)
    return e.spark.read.schema("conv_id long, split string").json(at)


@query("SELECT vec_id, label, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings")
def vectors_written(e, t):
    at = f"{shared_folder(e.spark)}/vectors"
    writers.write_vectors(t("embeddings"), at)
    return e.spark.read.parquet(at).select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


@query("SELECT 'PRODUCED_BY' AS rel_type, count(DISTINCT l_partkey) AS n FROM lineitem UNION ALL SELECT 'BELONGS_TO_DEPT', count(*) FROM supplier")
def edges_written(e, t):
    at = shared_folder(e.spark)
    all_ = G.edges(e.events, style_factory(e.spark, e.sf_dir), factories(e.spark, e.sf_dir))
    writers.write_graph({k: all_[k] for k in ("PRODUCED_BY", "BELONGS_TO_DEPT")}, at)
    return e.spark.read.parquet(f"{at}/edges").groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS style_id, s_name AS factory_name FROM supplier WHERE s_suppkey % 3 <> 0")
def factories_read(e, t):
    """A CSV with blanks around its cells and rows without a factory."""
    at = f"{shared_folder(e.spark)}/factories"
    k = F.col("s_suppkey")
    t("supplier").select(F.concat(F.lit(" "), k.cast("string"), F.lit(" ")).alias("style_id"), F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "s_name")).alias("factory_name")).write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(at, header=True)
    return readers.read_factories(e.spark, at)


@query("SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderkey % 7 <> 0")
def lines_read(e, t):
    """Lines of JSON, some of them cut off."""
    at = f"{shared_folder(e.spark)}/lines"
    whole = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority")))
    t("orders").select(F.when(F.col("o_orderkey") % 7 == 0, F.left(whole, F.lit(8))).otherwise(whole).alias("value")).write.text(at)
    return readers.read_jsonl(e.spark, at, "id long, priority string")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(NULL AS VARCHAR) AS manager FROM nation")
def organization_read(e, t):
    """One document of all departments, as the organization's file has them."""
    at = f"{shared_folder(e.spark)}/organization"
    one = departments(e.spark, e.sf_dir).agg(F.collect_list(F.struct(F.col("dept_id").cast("string").alias("id"), F.col("dept").alias("name"))).alias("departments"))
    one.select(F.to_json(F.struct("departments")).alias("value")).write.text(at)
    return readers.read_organization(e.spark, at)["departments"].drop("seq")


@query()
def mail_records(e, t):
    """Documents as mails, in two batches of which the second finds the first done; its SQL would need Unicode word bounds."""
    at = f"{shared_folder(e.spark)}/records"
    k = F.col("doc_id")
    mails = t("documents").select(F.concat(F.lit("mail-"), k.cast("string"), F.lit(".eml")).alias("filename"), F.col("text").alias("content"), F.left("text", F.lit(60)).alias("subject"), F.lit("2024-01-05").alias("date"), F.lit(None).cast("string").alias("error"))
    J.run_batch(e.spark, mails.where(k % 2 == 0), at, first=True)
    return J.run_batch(e.spark, mails, at).select("filename", "status", "reason", "email_date", F.array_join("style_ids", ",").alias("style_ids"), F.array_join("order_ids", ",").alias("order_ids"), "events_count")


__all__ = ["ORACLE_SQL", "QUERIES", "SEQ"]
