"""Queries over whole training sets that jobs write from the given tables, each beside its SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import reports as P
from ..streaming.pointer import shared_folder
from . import dataset_jobs as J
from .asked import query
from .domain import CTE
from .queries import EV_SEQ

_NL = "chr(10)"
_LINES = lambda lines: "array_to_string([" + ", ".join(f"'{x}'" for x in lines) + f"], {_NL})"
_MD5 = lambda c: F.md5(F.col(c).cast("binary"))
SYSTEM = "Timeline of a style from its events: stages, delays, risks, critical path."
#: Training, validation and test samples that the two jobs draw.
TARGETS, ASKED = (500, 50, 50), (30, 8, 8)

#: Styles by priority, so that there are rich, medium and poor ones.
_STYLES = f"""{CTE}, e AS (SELECT * REPLACE (style_id * 10 + CAST(left(event_type, 1) AS BIGINT) AS style_id) FROM ev
), l AS (SELECT style_id, count(*) AS event_count, CASE WHEN count(*) >= 10 THEN 'rich' WHEN count(*) >= 5 THEN 'medium' WHEN count(*) >= 2 THEN 'poor' END AS layer FROM e GROUP BY 1
), k AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY md5(style_id || '-42'), style_id) - 1 AS rn, count(*) OVER (PARTITION BY layer) AS there FROM l WHERE layer IS NOT NULL
), d AS (SELECT layer, wanted, unnest(range(wanted)) AS draw FROM (VALUES ('rich', 250), ('medium', 175), ('poor', 75)) w(layer, wanted)
), tr AS (SELECT 'train' AS split, draw, style_id, event_count, layer FROM d JOIN k USING (layer) WHERE rn = CASE WHEN there >= wanted THEN draw ELSE CAST('0x' || substr(md5('draw:' || draw || '-42'), 1, 6) AS BIGINT) % there END
), va AS (SELECT 'val' AS split, row_number() OVER (ORDER BY md5(style_id || '-43'), style_id) - 1 AS draw, style_id, event_count, layer FROM k WHERE layer = 'poor' AND style_id NOT IN (SELECT style_id FROM tr) QUALIFY draw < 50
), te AS (SELECT 'test' AS split, row_number() OVER (ORDER BY md5(style_id || '-44'), style_id) - 1 AS draw, style_id, event_count, layer FROM k WHERE layer = 'poor' AND style_id NOT IN (SELECT style_id FROM tr UNION ALL SELECT style_id FROM va) QUALIFY draw < 50
), s AS (SELECT * FROM tr UNION ALL SELECT * FROM va UNION ALL SELECT * FROM te
)"""
_REPORTS = f""", n AS (SELECT *, (row_number() OVER w - 1) // {J.ROUND} + 1 AS round, CAST(ceil(count(*) OVER (PARTITION BY style_id) / {J.ROUND}.0) AS BIGINT) AS total FROM e WINDOW w AS (PARTITION BY style_id ORDER BY date, order_id, line, factory_id)
), p AS (SELECT style_id, round, '## 📋 款号 ' || style_id || ' 时间线分析（第 ' || round || '/' || total || ' 部分）' || {_NL} || {_NL} || {_LINES(P.REPORT_HEAD)} || {_NL} || string_agg('| ' || category || ' | ' || event_type || ' | ' || date || ' | ' || CASE WHEN delay_days > 0 THEN delay_days || '天' ELSE '-' END || ' |  | 📧  |', {_NL} ORDER BY date, order_id, line, factory_id) || {_NL} || {_LINES(P.REPORT_FOOT)} AS report FROM n GROUP BY style_id, round, total
), r AS (SELECT style_id, string_agg(report, {_NL} || {_NL} || '---' || {_NL} || {_NL} ORDER BY round) AS report FROM p GROUP BY 1
), g AS (SELECT style_id, string_agg(date || '|' || category || '|' || coalesce(delay_days, 0), {_NL} ORDER BY date, order_id, line, factory_id) AS given FROM e GROUP BY 1)"""


def _timelines(e) -> J.Job:
    ev = e.events.withColumn("style_id", F.col("style_id") * 10 + F.left("event_type", F.lit(1)).cast("long"))
    return J.timeline_dataset(e.spark, f"{shared_folder(e.spark)}/timelines", ev, ["date", *EV_SEQ], SYSTEM, targets=TARGETS)


@query(f"{_STYLES}{_REPORTS} SELECT split, draw, style_id, event_count, layer, '{SYSTEM}' AS system, md5(given) AS given_md5, md5(report) AS report_md5 FROM s JOIN g USING (style_id) JOIN r USING (style_id)")
def timeline_records(e, t):
    """Records of sampled styles by split, as a job wrote them."""
    job = _timelines(e)
    rows = e.spark.read.schema("split string, draw long, style_id long, event_count long, layer string, messages array<struct<role:string,content:string>>").json(f"{job.path}/out/sft")
    system, given, report = (F.col("messages")[i]["content"].cast("binary") for i in range(3))
    return rows.select("split", "draw", "style_id", "event_count", "layer", system.cast("string").alias("system"), F.md5(given).alias("given_md5"), F.md5(report).alias("report_md5"))


@query(f"{_STYLES} SELECT split, count(*) AS drawn, count(*) AS total, count(*) AS quality_passed, round(avg(event_count), 9) AS avg_events, count(*) FILTER (layer = 'rich') AS rich, count(*) FILTER (layer = 'poor') AS poor, CAST(0 AS BIGINT) AS no_icons, CAST(0 AS BIGINT) AS overlapping FROM s GROUP BY 1")
def timeline_figures(e, t):
    """What the job says of each split: samples, those that pass the checks, layers, styles in two splits."""
    rows = e.spark.read.schema("split string, drawn long, total long, quality_passed long, avg_events double, rich long, poor long, no_icons long, overlapping long").json(f"{_timelines(e).path}/out/figures")
    return rows.withColumn("avg_events", F.round("avg_events", 9))


#: What assistants say in four of five turns: a call with a result, a chain, two calls of which the first names a style, a call alone.
_CALLS = [
    json.dumps({"thought": "x", "function_calls": calls})
    for calls in (
        [{"name": "kg_query", "params": {"query": "q"}, "result": {"rows": 3}}],
        [{"name": "kg_query", "params": {"query": "q"}}, {"name": "rag_query", "params": {"style_id": "$1"}}],
        [{"name": "rag_query", "params": {"style_id": "7", "top_k": 5}, "result": ""}, {"name": "rag_query"}],
        [{"name": "ask_back", "params": {}, "result": []}],
    )
]
_SAID = "CASE WHEN role = 'assistant' AND (conv_id + turn) % 5 < 4 THEN [" + ", ".join(f"'{c}'" for c in _CALLS) + "][(conv_id + turn) % 5 + 1] ELSE text END"
_QUESTIONS = f"""WITH q AS (SELECT conv_id, CAST(max(turn) AS VARCHAR) AS scene, count(*) FILTER (role = 'assistant') AS rounds FROM conversations GROUP BY 1
), g AS (SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY scene) AS c, row_number() OVER (PARTITION BY scene ORDER BY md5(conv_id || '-42'), conv_id) AS rank FROM q WHERE rounds > 0
), o AS (SELECT *, n <= {sum(ASKED)} OR rank <= floor({sum(ASKED)} * (c / n)) AS own FROM g
), u AS (SELECT conv_id, scene FROM o WHERE own UNION ALL (SELECT conv_id, scene FROM o WHERE NOT own ORDER BY md5(conv_id || '-43'), conv_id LIMIT (SELECT {sum(ASKED)} - count(*) FILTER (own) FROM o))
), z AS (SELECT *, row_number() OVER (ORDER BY md5(conv_id || '-44'), conv_id) AS place FROM u
), s AS (SELECT conv_id, scene, CASE WHEN place <= {ASKED[0]} THEN 'train' WHEN place <= {ASKED[0] + ASKED[1]} THEN 'val' ELSE 'test' END AS split FROM z
), t AS (SELECT conv_id, turn, role, {_SAID} AS text FROM conversations JOIN s USING (conv_id)
), x AS (
  SELECT conv_id, count(*) AS messages, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS messages_md5, count(*) FILTER (role = 'assistant') AS rounds,
    count(*) FILTER (role = 'assistant' AND (conv_id + turn) % 5 = 0) AS results, count(*) FILTER (role = 'assistant' AND (conv_id + turn) % 5 = 1) AS chains, arg_max(text, turn) FILTER (role = 'assistant') AS chosen, count(*) FILTER (role = 'user') AS asked
  FROM t GROUP BY 1
)"""


def _questions(e, t) -> J.Job:
    said = t("conversations")
    rows = said.groupBy("conv_id").agg(F.max("turn").cast("string").alias("scene"), F.when(F.count_if(F.col("role") == "assistant") > 0, "success").otherwise("failed").alias("status"))
    at = ((F.col("conv_id") + F.col("turn")) % 5).cast("int")
    text = F.when((F.col("role") == "assistant") & (at < 4), F.get(F.array(*map(F.lit, _CALLS)), at)).otherwise(F.col("text"))
    turns = lambda drawn: said.join(F.broadcast(drawn.select("conv_id")), "conv_id").select("conv_id", "turn", "role", text.alias("text"))
    return J.question_dataset(e.spark, f"{shared_folder(e.spark)}/questions", rows, turns, "conv_id", ASKED)


@query(f"{_QUESTIONS} SELECT split, conv_id, scene, messages, messages_md5, CASE WHEN asked > 0 THEN md5(chosen) END AS chosen_md5 FROM s JOIN x USING (conv_id)")
def question_records(e, t):
    """Dialogues of sampled questions by split and what their preference pairs choose, as a job wrote them."""
    out = f"{_questions(e, t).path}/out"
    sft = e.spark.read.schema("split string, conv_id long, scene string, messages array<struct<role:string,content:string>>").json(f"{out}/sft")
    dpo = e.spark.read.schema("split string, conv_id long, chosen string").json(f"{out}/dpo").select("split", "conv_id", _MD5("chosen").alias("chosen_md5"))
    texts = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return sft.select("split", "conv_id", "scene", F.size("messages").cast("long").alias("messages"), F.md5(texts.cast("binary")).alias("messages_md5")).join(dpo, ["split", "conv_id"], "left")


@query(f"{_QUESTIONS}, r AS (SELECT split, rounds, count(*) AS n, CAST(sum(results) AS BIGINT) AS results, CAST(sum(chains) AS BIGINT) AS chains, count(*) FILTER (asked > 0) AS pairs FROM s JOIN x USING (conv_id) GROUP BY ALL) SELECT split, CAST(sum(n) AS BIGINT) AS drawn, CAST(sum(n) AS BIGINT) AS sft_count, CAST(sum(pairs) AS BIGINT) AS dpo_count, CAST(sum(chains) AS BIGINT) AS chain_count, CAST(sum(results) AS BIGINT) AS result_count, string_agg(rounds || ':' || n, ' ' ORDER BY rounds) AS rounds FROM r GROUP BY 1")
def question_figures(e, t):
    """What the job says of each split: dialogues, pairs, chains, results, and dialogues by their number of rounds."""
    rows = e.spark.read.schema("split string, drawn long, sft_count long, dpo_count long, chain_count long, result_count long, round_distribution array<struct<rounds:long,n:long>>").json(f"{_questions(e, t).path}/out/figures")
    return rows.withColumn("rounds", F.array_join(F.transform("round_distribution", lambda r: F.concat_ws(":", r["rounds"].cast("string"), r["n"].cast("string"))), " ")).drop("round_distribution")
