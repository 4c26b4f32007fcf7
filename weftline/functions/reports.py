"""Texts around answers: concise and detailed answers, reports without a model, warnings and the morning's message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .render import table_row

#: Wording of the texts, longest description in a table, names of the ways to cut a result.
NOTHING_NEW = "✅ 今日暂无风险提醒和新增动态。"
PUSH_FOOT = "*数据基于昨晚23点更新的数据库*"
REPORT_HEAD = ["### 一、📅 时间线梳理", "", "| 阶段 | 事件 | 时间 | 延期 | 描述 | 来源邮件 |", "|------|------|------|------|------|----------|"]
REPORT_FOOT = ["", "### 二、⚠️ 风险点", "- 🟡 **模型调用失败**：当前为降级输出，请检查 vLLM 服务", "", "### 三、🛤️ 关键路径", "（模型调用失败，无法生成关键路径分析）"]
LONGEST_DESCRIPTION = 30
SAMPLE_NAMES = {"HEAD": "前N个", "BY_STAGE": "按阶段采样", "BY_DELAY": "按延期优先", "BY_SCORE": "按相关度优先", "BY_DATE": "按时间最近", "STAT_ONLY": "仅统计"}
THOUGHT_NOTE = "（查询结果较长，如需详细数据请提供更具体的查询条件）"
NO_ANSWER = "根据查询结果，已为您整理相关信息。如需更详细的分析，请提供具体款号。"


def _lines(rows: DataFrame, key: list[str], order: list, line: Column) -> DataFrame:
    """(key, body, n): a text of each key's lines in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("__line")))), lambda x: x["__line"])
    return rows.groupBy(*key).agg(F.array_join(lines, "\n").alias("body"), F.count(F.lit(1)).alias("n"))


def _described(rows: DataFrame, head: str) -> Column:
    """A line of the description, where the rows have one and it is not empty."""
    return F.when(F.coalesce("description", F.lit("")) == "", "").otherwise(F.concat(F.lit(head), "description")) if "description" in rows.columns else F.lit("")


def latest(events: DataFrame, key: str = "style_id", seq: tuple[str, ...] = ("order_id", "line", "factory_id")) -> DataFrame:
    """(key, answer): a key's last event in a line; of equal dates the first in input order."""
    last = events.groupBy(key).agg(F.max_by(F.struct("category", "event_type", "date"), F.struct("date", *[(-F.col(c)).alias(c) for c in seq])).alias("e"))
    return last.select(key, F.concat(F.col(key).cast("string"), F.lit(" 最新："), "e.category", F.lit(" - "), "e.event_type", F.lit("（"), "e.date", F.lit("）")).alias("answer"))


def delay_details(events: DataFrame, key: str = "style_id", seq: tuple[str, ...] = ("order_id", "line", "factory_id")) -> DataFrame:
    """(key, answer): every late event of a key by date, and the days in all. Keys without late events are not there.

    A key's text holds all its late events, as the format asks.
    """
    late = events.where("delay_days > 0")
    line = F.concat(F.lit("- **"), "date", F.lit("** | "), "category", F.format_string("\n  - 延期天数：**%d 天**\n  - 事件类型：", "delay_days"), "event_type", _described(events, "\n  - 详情："), F.lit("\n"))
    body = _lines(late, [key], ["date", *seq], line).join(late.groupBy(key).agg(F.sum("delay_days").alias("days")), key)
    head = F.concat(F.lit("### 款号 "), F.col(key).cast("string"), F.format_string(" 延期分析\n\n共发现 **%d** 个延期事件：\n\n", "n"))
    return body.select(key, F.concat(head, "body", F.format_string("\n**累计延期：%d 天**", "days")).alias("answer"))


def responsible(by_style: DataFrame) -> DataFrame:
    """(style_id, answer): the owner in a line; without one the most active person."""
    owner = F.min(F.when(F.col("role") == "owner", F.col("person")))
    first = F.min_by("person", F.struct(-F.col("event_count"), "person"))
    return by_style.groupBy("style_id").agg(F.coalesce(owner, first).alias("who")).select("style_id", F.concat(F.col("style_id").cast("string"), F.lit(" 负责人："), "who").alias("answer"))


def plain_reports(rows: DataFrame, seq: list[str], key: str = "style_id") -> DataFrame:
    """(key, round, total_rounds, report): the report of each round(round, total_rounds) when no model answers."""
    text = F.coalesce("description", F.lit("")) if "description" in rows.columns else F.lit("")
    source = F.coalesce("source_filename", F.lit("")) if "source_filename" in rows.columns else F.lit("")
    short = F.when(F.length(text) > LONGEST_DESCRIPTION, F.concat(F.substring(text, 1, LONGEST_DESCRIPTION), F.lit("..."))).otherwise(text)
    late = F.when(F.col("delay_days") > 0, F.format_string("%d天", "delay_days")).otherwise("-")
    body = _lines(rows, [key, "round", "total_rounds"], seq, table_row(F.col("category"), F.col("event_type"), F.col("date"), late, short, F.concat(F.lit("📧 "), source)))
    title = F.concat(F.lit("## 📋 款号 "), F.col(key).cast("string"), F.format_string(" 时间线分析（第 %d/%d 部分）", "round", "total_rounds"))
    return body.select(key, "round", "total_rounds", F.concat_ws("\n", title, F.lit(""), F.lit("\n".join(REPORT_HEAD)), "body", F.lit("\n".join(REPORT_FOOT))).alias("report"))


def merged(parts: DataFrame, key: str = "style_id") -> DataFrame:
    """(key, report): the reports of a key's rounds with rules between them; a single round stands as it is."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("round", "report"))), lambda x: x["report"])
    return parts.groupBy(key).agg(F.array_join(ordered, "\n\n---\n\n").alias("report"))


def cut_note(total: Column, shown: Column, strategy: str) -> Column:
    """How much of a result is shown and how it was chosen; empty if all of it is."""
    return F.when(total > shown, F.format_string(f"共%d条，显示%d条（{SAMPLE_NAMES.get(strategy, '')}）", total, shown)).otherwise("")


def with_warning(content: Column, total: Column, shown: Column, unit: str = "条") -> Column:
    """The content, followed by a warning if some of it was left out."""
    said = F.format_string(f'\n[上下文警告] 结果已截断。原始%d{unit}，仅返回%d{unit}（达到上下文上限）。如需查看剩余内容，请说"继续"或"剩下的"。', total, shown)
    return F.when(total > shown, F.concat(content, said)).otherwise(content)


def fallback(rendered: Column, result: Column, thought: Column) -> Column:
    """What is answered at last: the rendered result, else its JSON, else the thought, else a fixed text."""
    some = lambda c: F.nullif(c, F.lit(""))
    as_json = F.concat(F.lit("【查询结果】\n\n```json\n"), some(result), F.lit("\n```"))
    return F.coalesce(some(rendered), as_json, F.concat(some(thought), F.lit("\n\n" + THOUGHT_NOTE)), F.lit(NO_ANSWER))


def morning(people: DataFrame, risks: DataFrame, news: DataFrame, key: str) -> DataFrame:
    """(key, content) of people(key, name, total): notes on risks(key, style_id, alias, reason, rank) and on
    news(key, style_id, alias, event, rank), each by rank and style; without either it says so."""

    def part(rows: DataFrame, head: str, said: str, name: str) -> DataFrame:
        style = F.col("style_id").cast("string")
        shown = F.when(F.coalesce("alias", F.lit("")) == "", style).otherwise(F.concat(style, F.lit("（"), "alias", F.lit("）")))
        body = _lines(rows, [key], ["rank", "style_id"], F.concat(F.lit("- **"), shown, F.lit("**："), said))
        return body.select(key, F.concat(F.format_string(head, "n"), F.lit("\n"), "body", F.lit("\n")).alias(name))

    both = people.join(part(risks, "## ⚠️ 风险提醒（%d个）", "reason", "risks"), key, "left").join(part(news, "## 📋 昨日动态（%d条）", "event", "news"), key, "left")
    quiet = F.when(F.col("risks").isNull() & F.col("news").isNull(), NOTHING_NEW)
    head = F.concat(F.lit("# 早安，"), "name", F.format_string("\n\n您负责 **%d** 个款号，今日概览如下：\n", "total"))
    return both.select(key, F.concat_ws("\n", head, "risks", "news", quiet, F.lit("\n---\n" + PUSH_FOOT)).alias("content"))
