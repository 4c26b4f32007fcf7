"""DuckDB SQL for the library's queries."""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions.text import PHONE, SPACE
from .domain import BOUND, CTE, bounded
from .queries import NOW, NOW_TS, PERSON, STYLE

SEQ = "order_id, line, style_id, factory_id"
EVT = "concat_ws('-', 'evt', order_id, line, style_id, factory_id)"

_SLOTS = """, slots AS (
  SELECT *, party_from AS person, 'party_from' AS role FROM ev UNION ALL SELECT *, party_to AS person, 'party_to' AS role FROM ev
), ps AS (SELECT person, style_id, count(*) AS event_count FROM slots GROUP BY ALL)"""
_OWNERS = ", owners AS (SELECT sf.style_id, s_name AS person FROM sf JOIN supplier ON s_suppkey = sf.factory_id)"
_PEOPLE = """, people AS (
  SELECT coalesce(p.style_id, o.style_id) AS style_id, coalesce(p.person, o.person) AS person, CASE WHEN o.person IS NOT NULL THEN 'owner' ELSE 'participant' END AS role, coalesce(p.event_count, 0) AS event_count
  FROM ps p FULL JOIN owners o ON p.style_id = o.style_id AND p.person = o.person
)"""
_COLLAB = """, pairs AS (
  SELECT least(party_from, party_to) AS a, greatest(party_from, party_to) AS b, count(*) AS event_count FROM ev WHERE party_from <> party_to GROUP BY ALL
), common AS (
  SELECT a, b, count(*) AS style_count FROM pairs JOIN ps x ON x.person = a JOIN ps y ON y.person = b AND y.style_id = x.style_id GROUP BY ALL
), collab AS (
  SELECT a AS person, b AS other, event_count, coalesce(style_count, 0) AS style_count FROM pairs LEFT JOIN common USING (a, b)
  UNION ALL SELECT b, a, event_count, coalesce(style_count, 0) FROM pairs LEFT JOIN common USING (a, b)
)"""
_FOLLOWS = f""", fol AS (
  SELECT *, {EVT} AS src, lead({EVT}) OVER w AS dst, lead(date) OVER w AS next_date FROM ev WINDOW w AS (PARTITION BY style_id, category ORDER BY date, {SEQ})
)"""


def _key(key: str) -> str:
    return f"md5(concat_ws('-', CAST({key} AS VARCHAR), '42'))"


def _any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _tokens(c: str) -> str:
    han = f"(length({c}) - length(regexp_replace({c}, '[一-鿿]', '', 'g')))"
    words = f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: regexp_matches(w, '\\p{{L}}'))"
    inside = f"coalesce(list_sum(list_transform({words}, lambda w: length(w))), 0)"
    return f"CAST({han} + len({words}) + floor((length({c}) - {han} - {inside}) / 2) AS BIGINT)"


_MESSAGE = f"CAST({_tokens('role')} + {_tokens('text')} + 20 AS BIGINT)"


def _score(words: list[str]) -> str:
    return " + ".join("CAST(contains(t, '" + w + "') AS INTEGER)" for w in words)


def _classifier() -> str:
    scores = ", ".join(f"{_score(ws)} AS s{i}" for i, ws in enumerate(L.CATEGORY_KEYWORDS.values()))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(L.CATEGORY_KEYWORDS))) + ")"
    cases = " ".join(f"WHEN s{i} = best THEN '{k}'" for i, k in enumerate(L.CATEGORY_KEYWORDS))
    return f"WITH a AS (SELECT doc_id, lower(text) AS t FROM documents), b AS (SELECT doc_id, {scores} FROM a), c AS (SELECT *, {best} AS best FROM b) SELECT doc_id, CASE WHEN best = 0 THEN '其他' {cases} END AS category FROM c"


def _router() -> str:
    has = {k: _any("lower(text)", v) for k, v in L.ROUTE_KEYWORDS.items()}
    style, timed = "(turn % 2 = 1)", f"({has['temporal']} AND NOT {has['overview']})"
    rules = [
        (f"{has['relational']} AND NOT {style}", "kg_relational", 0.9), (f"{timed} AND (contains(text, '工厂') OR contains(lower(text), 'factory'))", "kg_temporal", 0.85), (timed, "kg_temporal", 0.8),
        (f"{style} AND {has['entity']}", "hybrid", 0.85), (f"{has['overview']} AND {style}", "kg_overview", 0.85), (f"{has['semantic']} AND {style}", "hybrid", 0.75), (has["semantic"], "rag_semantic", 0.75), (style, "kg_overview", 0.7),
    ]
    pick = lambda n, other: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[n]!r}" for r in rules) + f" ELSE {other!r} END"
    return f"SELECT conv_id, turn, {pick(1, 'rag_semantic')} AS strategy, CAST({pick(2, 0.6)} AS DOUBLE) AS confidence FROM conversations"


_COS = "round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"
_MAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_NODES = """
  SELECT 'node' AS kind, 'Event' AS label, count(*) AS n FROM ev UNION ALL SELECT 'node', 'Style', count(DISTINCT style_id) FROM ev UNION ALL SELECT 'node', 'Person', count(DISTINCT person) FROM slots
  UNION ALL SELECT 'node', 'Category', count(DISTINCT category) FROM ev UNION ALL SELECT 'node', 'Email', count(DISTINCT order_id) FROM ev UNION ALL SELECT 'node', 'Factory', count(*) FROM supplier
  UNION ALL SELECT 'node', 'Department', count(*) FROM nation UNION ALL SELECT 'node', 'Customer', count(DISTINCT customer_id) FROM ev"""
_EDGES = """
  UNION ALL SELECT 'edge', 'BELONGS_TO', count(*) FROM ev UNION ALL SELECT 'edge', 'HAS_CATEGORY', count(*) FROM ev UNION ALL SELECT 'edge', 'FROM_EMAIL', count(*) FROM ev
  UNION ALL SELECT 'edge', 'PARTICIPATED_IN', count(*) FROM (SELECT DISTINCT person, order_id, line, style_id, factory_id FROM slots) UNION ALL SELECT 'edge', 'INVOLVED_IN', count(*) FROM ps
  UNION ALL SELECT 'edge', 'COLLABORATED_WITH', count(*) FROM collab UNION ALL SELECT 'edge', 'FOLLOWS', count(dst) FROM fol UNION ALL SELECT 'edge', 'PRODUCED_BY', count(*) FROM sf
  UNION ALL SELECT 'edge', 'BELONGS_TO_DEPT', count(*) FROM supplier UNION ALL SELECT 'edge', 'REPORTS_TO', count(*) - count(DISTINCT s_nationkey) FROM supplier UNION ALL SELECT 'edge', 'MANAGES', count(DISTINCT s_nationkey) FROM supplier
  UNION ALL SELECT 'edge', 'HAS_STYLE', count(*) FROM (SELECT DISTINCT customer_id, style_id FROM ev) UNION ALL SELECT 'edge', 'ORDERED_BY', count(*) FROM (SELECT DISTINCT customer_id, style_id FROM ev)"""

ORACLE_SQL: dict[str, str] = {
    "factory_delay_ranking": f"""{CTE}, r AS (
  SELECT s_suppkey AS factory_id, s_name AS name, count(sf.style_id) AS style_count, CAST(coalesce(sum(total_delay_days), 0) AS BIGINT) AS total_delay_days, CAST(coalesce(sum(delay_event_count), 0) AS BIGINT) AS delay_event_count
  FROM supplier LEFT JOIN sf ON s_suppkey = sf.factory_id LEFT JOIN styles USING (style_id) GROUP BY 1, 2)
SELECT *, round_even(total_delay_days / greatest(delay_event_count, 1), 2) AS avg_delay FROM r ORDER BY total_delay_days DESC, factory_id LIMIT 10""",
    "style_rollup": f"{CTE} SELECT * FROM styles",
    "person_rollup": f"{CTE}{_SLOTS} SELECT person, count(*) AS event_count, count(DISTINCT style_id) AS style_count FROM slots GROUP BY 1",
    "person_style_counts": f"{CTE}{_SLOTS} SELECT * FROM ps",
    "category_rollup": f"{CTE} SELECT category, count(*) AS event_count, CAST(count(*) FILTER (delay_days <> 0) AS BIGINT) AS delay_event_count, round_even(avg(delay_days), 2) AS avg_delay_days FROM ev GROUP BY 1",
    "email_rollup": f"{CTE} SELECT order_id AS email, count(*) AS event_count FROM ev GROUP BY 1",
    "customer_rollup": f"{CTE} SELECT customer_id, count(DISTINCT style_id) AS style_count, array_to_string(list_sort(list(DISTINCT style_id)), ',') AS styles FROM ev GROUP BY 1",
    "department_members": "SELECT CAST(s_nationkey AS BIGINT) AS dept_id, count(*) AS member_count FROM supplier GROUP BY 1",
    "events_by_conditions": f"{CTE} SELECT {SEQ}, category, event_type, date, delay_days FROM ev WHERE category IN ('RF', 'AF') AND event_type IN ('1-URGENT', '2-HIGH') AND delay_days >= 30 AND date >= '1993-01-01' AND date <= '1998-12-31' ORDER BY date DESC, {SEQ} LIMIT 100",
    "events_of_styles": f"{CTE} SELECT {SEQ}, category, date, delay_days FROM ev WHERE style_id IN (1, 2, 3, 42)",
    "recent_events": f"SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '{NOW_TS}' - INTERVAL 7 DAY ORDER BY event_id",
    "quality_tiers": f"{CTE} SELECT CASE WHEN confidence >= 70 THEN 'passed' WHEN confidence >= 50 THEN 'review' ELSE 'discarded' END AS tier, count(*) AS n, count(DISTINCT style_id) AS styles FROM ev GROUP BY 1",
    "tier_funnel": f"{CTE}, c AS (SELECT CASE WHEN confidence >= 70 THEN 'passed' WHEN confidence >= 50 THEN 'review' ELSE 'discarded' END AS tier, count(*) AS n FROM ev GROUP BY 1) SELECT tier, n, round_even(100.0::DOUBLE * n / (SELECT sum(n) FROM c), 1) AS percent FROM c",
    "dedup_first": f"{CTE} SELECT {SEQ}, category, event_type, date FROM ev QUALIFY row_number() OVER (PARTITION BY style_id, category, event_type, date ORDER BY {SEQ}) = 1",
    "top3_per_style": f"{CTE} SELECT {SEQ}, date, row_number() OVER (PARTITION BY style_id ORDER BY date DESC, order_id, line, factory_id) AS rn FROM ev QUALIFY rn <= 3",
    "latest_per_subject": "WITH s AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '(?i)^(回复:|Re:|答复:|Fw:|转发:)\\s*', ''), '^\\s+|\\s+$', '', 'g') AS subject FROM conversations) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY subject ORDER BY turn DESC, conv_id) = 1",
    "timeline_follows": f"{CTE}{_FOLLOWS} SELECT src, dst, CAST(date_diff('day', CAST(date AS DATE), CAST(next_date AS DATE)) AS BIGINT) AS time_gap_days FROM fol WHERE dst IS NOT NULL",
    "asof_previous_event": "WITH l AS (SELECT user_id, event_type, ts, max(event_id) AS event_id FROM events GROUP BY ALL) SELECT e.event_id, l.event_id AS prev_id FROM events e ASOF LEFT JOIN l ON e.user_id = l.user_id AND e.event_type = l.event_type AND e.ts > l.ts",
    "collaborators": f"{CTE}{_SLOTS}{_COLLAB} SELECT * FROM collab",
    "collaborators_topk": f"{CTE}{_SLOTS}{_COLLAB} SELECT other, event_count, style_count FROM collab WHERE person = '{PERSON}' ORDER BY event_count DESC, other LIMIT 10",
    "people_by_style": f"{CTE}{_SLOTS}{_OWNERS}{_PEOPLE} SELECT * FROM people",
    "styles_by_person": f"{CTE}{_SLOTS}{_OWNERS}{_PEOPLE} SELECT style_id, role, p.event_count, last_update, latest_category, total_delay_days FROM people p JOIN styles USING (style_id) WHERE person = '{PERSON}'",
    "styles_by_factory": f"{CTE} SELECT sf.factory_id, style_id, last_update, total_delay_days, latest_category FROM sf JOIN supplier ON s_suppkey = sf.factory_id JOIN styles USING (style_id) WHERE s_name = '{PERSON}' OR sf.factory_id = 7",
    "department_styles": f"{CTE}{_SLOTS} SELECT CAST(s_nationkey AS BIGINT) AS dept_id, style_id, min(person) AS first_member FROM ps JOIN supplier ON s_name = person GROUP BY 1, 2",
    "find_styles_all_categories": f"{CTE} SELECT style_id, total_delay_days FROM styles WHERE total_delay_days >= 100 AND style_id IN (SELECT style_id FROM ev WHERE category IN ('NO', 'RF', 'AF') GROUP BY 1 HAVING count(DISTINCT category) = 3)",
    "customers_by_style": f"{CTE} SELECT DISTINCT style_id, customer_id, party_to AS name FROM ev WHERE style_id = {STYLE}",
    "styles_by_customer": f"{CTE} SELECT DISTINCT customer_id, style_id, last_update, event_count FROM ev JOIN styles USING (style_id) WHERE lower(party_to) = 'customer#000000007'",
    "all_customers_active": f"{CTE} SELECT c_custkey AS customer_id, c_name AS name, n AS style_count FROM customer JOIN (SELECT customer_id, count(DISTINCT style_id) AS n FROM ev GROUP BY 1) ON c_custkey = customer_id WHERE n >= 5",
    "customer_details": f"{CTE}{_SLOTS}, own AS (SELECT DISTINCT customer_id, style_id FROM ev), p AS (SELECT customer_id, count(DISTINCT person) AS people FROM own JOIN ps USING (style_id) GROUP BY 1) SELECT customer_id, count(DISTINCT style_id) AS styles, array_to_string(list_sort(list(DISTINCT factory_id)), ',') AS factory_ids, any_value(people) AS people FROM own JOIN sf USING (style_id) JOIN p USING (customer_id) GROUP BY 1",
    "subordinates": "WITH h AS (SELECT s_nationkey, min(s_suppkey) AS manager_id FROM supplier GROUP BY 1) SELECT manager_id, s_suppkey AS factory_id, s_name AS name FROM supplier JOIN h USING (s_nationkey) WHERE s_suppkey <> manager_id",
    "style_overview_summary": f"{CTE}, b AS (SELECT style_id, category || '=' || count(*) AS line FROM ev GROUP BY style_id, category), l AS (SELECT style_id, string_agg(line, ',' ORDER BY line) AS by_category FROM b GROUP BY 1) SELECT style_id, by_category, event_count AS total_events, first_event_date AS first_date, last_update AS last_date, late_event_count AS late_events, late_days FROM styles JOIN l USING (style_id)",
    "last_update": f"{CTE} SELECT style_id, last_update, latest_category, CAST(date_diff('day', CAST(last_update AS DATE), DATE '{NOW}') AS BIGINT) AS days_since FROM styles",
    "style_timeline": f"{CTE} SELECT style_id, category, string_agg(date || ':' || order_id, ',' ORDER BY date, order_id, line, factory_id) AS timeline FROM ev WHERE style_id = {STYLE} GROUP BY ALL",
    "graph_node_edge_stats": f"{CTE}{_SLOTS}{_COLLAB}{_FOLLOWS}, g AS ({_NODES}{_EDGES}) SELECT kind, label, CAST(n AS BIGINT) AS n FROM g UNION ALL SELECT kind, 'total', CAST(sum(n) AS BIGINT) FROM g GROUP BY 1",
    "neighbours_of_person": f"{CTE}{_SLOTS} SELECT person AS node, CAST(style_id AS VARCHAR) AS neighbour FROM ps WHERE person = '{PERSON}'",
    "chain_person_to_summaries": f"{CTE}{_SLOTS}{_OWNERS}{_PEOPLE} SELECT style_id, latest_category, event_count, total_delay_days, CASE WHEN late_days > 0 THEN '延期' ELSE '正常' END AS status FROM styles WHERE style_id IN (SELECT style_id FROM people WHERE person = '{PERSON}')",
    "chain_conditions_to_timeline": f"{CTE} SELECT {SEQ}, category, date FROM ev WHERE style_id IN (SELECT style_id FROM styles WHERE total_delay_days >= 1500) AND style_id IN (SELECT style_id FROM ev WHERE category IN ('RF', 'NO') GROUP BY 1 HAVING count(DISTINCT category) = 2)",
    "stage_round_robin": f"{CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY date, order_id, line, factory_id) AS round FROM ev WHERE style_id = {STYLE}), f AS (SELECT category, date AS d, order_id AS o, line AS l, factory_id AS s FROM r WHERE round = 1) SELECT {SEQ}, category, round FROM r JOIN f USING (category) ORDER BY round, d, o, l, s LIMIT 10",
    "truncate_by_delay": f"{CTE} SELECT style_id, total_delay_days FROM styles ORDER BY coalesce(total_delay_days, 0) DESC, style_id LIMIT 20",
    "truncate_by_date": f"{CTE} SELECT style_id, last_update FROM styles ORDER BY last_update DESC, style_id LIMIT 20",
    "truncate_by_score": f"{CTE}{_SLOTS} SELECT person, count(*) AS event_count FROM slots GROUP BY 1 ORDER BY event_count DESC, person LIMIT 20",
    "truncation_conserves_rows": f"{CTE}, k AS (SELECT style_id FROM styles ORDER BY total_delay_days DESC, style_id LIMIT 50) SELECT latest_category, count(*) AS omitted, max(total_delay_days) AS max_omitted_delay FROM styles WHERE style_id NOT IN (SELECT style_id FROM k) GROUP BY 1",
    "page_n_of_results": f"{CTE} SELECT style_id, last_update FROM styles ORDER BY last_update DESC, style_id LIMIT 15 OFFSET 30",
    "continuation_page": f"{CTE} SELECT {SEQ}, date FROM ev WHERE order_id >= 100 ORDER BY {SEQ} LIMIT 15",
    "chunk_rounds": f"{CTE} SELECT {SEQ}, (row_number() OVER (PARTITION BY style_id ORDER BY date, order_id, line, factory_id) - 1) // 10 + 1 AS round, CAST(ceil(count(*) OVER (PARTITION BY style_id) / 10) AS BIGINT) AS total_rounds FROM ev",
    "most_common_stages": f"{CTE} SELECT event_type, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, min(order_id) LIMIT 3",
    "pii_masked_documents": f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{_MAIL}', '[EMAIL]', 'g'), '{PHONE}', '[PHONE]', 'g')) AS masked_md5 FROM documents",
    "id_extraction_all": f"""WITH m AS (SELECT doc_id, {bounded('text')} AS t, {bounded('upper(text)')} AS u FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(t, '{BOUND}([0-9]{{6}}){BOUND}', 1), lambda x: NOT (CAST(substr(x, 1, 2) AS INTEGER) <= 12 AND CAST(substr(x, 3, 2) AS INTEGER) <= 31)), regexp_extract_all(t, '{BOUND}([0-9]{{7,9}}){BOUND}', 1)))), ',') AS order_ids,
  array_to_string(list_sort(list_distinct(flatten([{", ".join(f"regexp_extract_all(u, '{BOUND}({p[2:-2].replace('}-[', '}' + BOUND + '-' + BOUND + '[')}){BOUND}', 1)" for p in L.STYLE_PATTERNS)}]))), ',') AS style_ids FROM m""",
    "html_to_text": f"SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>[^<]*</script>|<style[^>]*>[^<]*</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[{SPACE}]+', ' ', 'g'))) AS text_md5 FROM pages",
    "token_estimate": f"SELECT conv_id, CAST(sum({_MESSAGE}) AS BIGINT) AS tokens FROM conversations GROUP BY 1",
    "context_overflow": f"WITH u AS (SELECT conv_id, sum({_MESSAGE}) AS tokens FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN tokens >= 400 THEN 'overflow' WHEN tokens >= 320 THEN 'warning' ELSE 'ok' END AS status FROM u",
    "category_classifier": _classifier(),
    "router_strategy": _router(),
    "business_gate": f"SELECT doc_id, CASE WHEN {_any('lower(substr(text, 1, 300))', ['sample', 'fabric', 'delivery'])} THEN CASE WHEN length(text) < 50 THEN 'too_short' ELSE 'passed' END WHEN length(text) < CASE WHEN source = 'src0' THEN 300 ELSE 200 END THEN 'too_short' ELSE 'passed' END AS status FROM documents",
    "knn_topk": f"SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (ORDER BY {_COS} DESC, e.vec_id) AS rank, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 QUALIFY rank <= 10",
    "knn_filtered": f"SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label IN (1, 3) ORDER BY score DESC, e.vec_id LIMIT 5",
    "two_stage_retrieval": f"WITH k AS (SELECT e.vec_id, e.label, q.label AS ql, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 1 ORDER BY score DESC, e.vec_id LIMIT 20) SELECT vec_id, label, score FROM k WHERE label = ql OR score > 0.75",
    "stratified_sample": f"{CTE}, l AS (SELECT style_id, CASE WHEN event_count >= 10 THEN 'rich' WHEN event_count >= 5 THEN 'medium' WHEN event_count >= 2 THEN 'poor' END AS layer FROM styles) SELECT style_id, layer, row_number() OVER (PARTITION BY layer ORDER BY {_key('style_id')}, style_id) AS rank FROM l WHERE layer IS NOT NULL QUALIFY rank <= CASE layer WHEN 'rich' THEN 50 WHEN 'medium' THEN 35 ELSE 15 END",
    "stratified_split": f"WITH h AS (SELECT DISTINCT conv_id, CAST('0x' || substr({_key('conv_id')}, 1, 6) AS BIGINT) % 100 AS p FROM conversations) SELECT conv_id, CASE WHEN p < 80 THEN 'train' WHEN p < 90 THEN 'val' ELSE 'test' END AS split FROM h",
    "split_overlap": "SELECT conv_id, CAST(0 AS BIGINT) AS n FROM conversations WHERE false",
    "sharegpt_records": "SELECT conv_id, count(*) AS n, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS messages_md5 FROM conversations GROUP BY 1",
    "dpo_pairs": """WITH u AS (SELECT conv_id, arg_max(text, turn) AS instruction FROM conversations WHERE role = 'user' GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role = 'assistant'),
b AS (SELECT conv_id, max(text) FILTER (rn = 1) AS chosen, max(text) FILTER (rn = 2) AS before FROM r WHERE rn <= 2 GROUP BY 1)
SELECT conv_id, instruction, chosen, coalesce(before, substr(chosen, 1, length(chosen) // 2)) AS rejected FROM u JOIN b USING (conv_id)""",
    "output_quality_flags": "WITH f AS (SELECT doc_id, contains(text, '## 📋') AS has_title, contains(text, '### 一、') AS has_timeline, contains(text, '### 二、') AS has_risks, contains(text, '### 三、') AS has_path, contains(text, '| 阶段 |') AS has_table, contains(text, '📧') AS has_source, length(text) AS output_length FROM documents) SELECT *, has_title AND has_timeline AND has_risks AND has_path AND has_table AS passed FROM f",
    "completeness_check": f"{CTE}, s AS (SELECT style_id, category FROM ev QUALIFY row_number() OVER (PARTITION BY style_id ORDER BY date DESC, order_id, line, factory_id) <= 3) SELECT 'missing' AS problem, count(*) AS n FROM (SELECT DISTINCT style_id, category FROM ev EXCEPT SELECT style_id, category FROM s)",
    "daily_push": f"{CTE}, d AS (SELECT * FROM ev WHERE delay_days >= 1 QUALIFY row_number() OVER (PARTITION BY factory_id ORDER BY delay_days DESC, {SEQ}) = 1) SELECT factory_id, style_id, order_id, delay_days, '延期' || delay_days || '天' AS reason FROM d ORDER BY delay_days DESC, factory_id LIMIT 5",
    "stale_styles": f"{CTE} SELECT style_id, last_update FROM styles WHERE date_diff('day', CAST(last_update AS DATE), DATE '{NOW}') > 700",
    "style_notes_join": f"{CTE} SELECT style_id, coalesce(p_name, '') AS alias, p_name IS NOT NULL AS pinned FROM styles LEFT JOIN part ON p_partkey = style_id AND p_size > 40",
    "resume_anti_join": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "overview_markdown_rows": f"{CTE} SELECT concat_ws(' | ', category, count(*), count(*) FILTER (delay_days <> 0)) AS line FROM ev GROUP BY category",
    "stage_repetition": f"{CTE} SELECT style_id, category, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) >= 20",
    "stream_rollup_equals_batch": "SELECT user_id, count(*) AS event_count, round(CAST(sum(CAST(value AS DECIMAL(38,6))) AS DOUBLE), 4) AS total_value, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, first(event_type ORDER BY ts DESC, event_id) AS latest_type FROM events GROUP BY 1",
    "sliding_windows": "WITH s AS (SELECT event_type, date_trunc('day', ts) - INTERVAL (k) DAY AS start FROM events, range(7) r(k)) SELECT strftime(start, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM s GROUP BY ALL",
}
