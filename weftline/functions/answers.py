"""Answers in Markdown, one a key, as aggregations over the rows that they tell of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .render import delay_text, markdown_table, table_row

#: Lines of a detailed timeline, related terms shown, and what is said when nothing was found.
MOST_LINES, MOST_RELATED = 10, 3
NO_TERM = "抱歉，在知识库中没有找到相关术语。"
NO_EVENTS, NO_DELAY = "暂无事件记录。", "当前无延期记录。"
UNKNOWN = "抱歉，我不太理解您的问题。"


def _joined(rows: DataFrame, key: list[str], order: list, line: Column) -> DataFrame:
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "\n").alias("body"), F.count(F.lit(1)).alias("n"))


def timelines(events: DataFrame, newest: DataFrame, key: str = "style_id", seq: tuple[str, ...] = ("order_id", "line", "factory_id")) -> DataFrame:
    """(key, answer): the events of `newest` (some per key, numbered by rn), and how many there are in all."""
    total = events.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    mark = F.when(F.col("delay_days") > 0, " ⚠️").when(F.col("delay_days") < 0, " ✅")
    late = F.coalesce(F.concat(mark, delay_text(F.col("delay_days"))), F.lit(""))
    line = F.concat(F.lit("- **"), "date", F.lit("** | "), "category", F.lit(" · "), "event_type", late)
    body = _joined(newest, [key], ["rn"], line)
    note = F.when(F.col("total") > F.col("n"), F.format_string("\n\n*共 %d 条事件，以上为最近%d条*", "total", "n")).otherwise("")
    return body.join(total, key).select(key, F.concat(F.lit("### 款号 "), F.col(key).cast("string"), F.lit(" 时间线\n\n"), "body", note).alias("answer"))


def delays(styles: DataFrame, key: str = "style_id") -> DataFrame:
    """(key, answer) in a sentence from a rollup's late days and late events."""
    name = F.col(key).cast("string")
    none = F.concat(F.lit("款号 **"), name, F.lit("** " + NO_DELAY))
    return styles.select(key, F.when(F.col("late_event_count") == 0, none).otherwise(F.concat(name, F.format_string(" 累计延期 %d 天，涉及 %d 个阶段。", "late_days", "late_event_count"))).alias("answer"))


def people(by_style: DataFrame) -> DataFrame:
    """(style_id, answer): who is responsible and who takes part, the most active first."""
    shown = by_style.select("style_id", "role", "person", (-F.col("event_count")).alias("rank"))
    owner = shown.where("role = 'owner'").groupBy("style_id").agg(F.min("person").alias("owner"))
    body = _joined(shown, ["style_id"], ["rank", "person"], F.concat(F.lit("- "), "person"))
    head = F.coalesce(F.concat(F.lit("**主要负责人："), "owner", F.lit("**\n\n")), F.lit(""))
    return body.join(owner, "style_id", "left").select("style_id", F.concat(F.lit("### 款号 "), F.col("style_id").cast("string"), F.lit(" 涉及人员\n\n"), head, F.lit("参与人员：\n"), "body").alias("answer"))


def terms(hits: DataFrame, concise: bool = False) -> DataFrame:
    """(query_id, answer) from ranked term hits: the best one, and some that are related."""
    pair = F.concat("chinese", F.lit(" → "), "english")
    best = hits.where("rank = 1").select("query_id", pair.alias("pair"), F.concat(F.lit("**"), "chinese", F.lit("**\n\n英文："), "english", F.lit("\n分类："), "category").alias("head"))
    if concise:
        return best.select("query_id", F.col("pair").alias("answer"))
    rest = _joined(hits.where(F.col("rank").between(2, MOST_RELATED + 1)), ["query_id"], ["rank"], F.concat(F.lit("- "), pair))
    return best.join(rest, "query_id", "left").select("query_id", F.concat("head", F.coalesce(F.concat(F.lit("\n\n相关术语：\n"), "body"), F.lit(""))).alias("answer"))


def push(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content): a morning's notes, one line each, worst first."""
    body = _joined(rows, keys, [(-F.col("delay_days")).alias("rank"), "style_id"], F.concat(F.lit("- "), F.col("style_id").cast("string"), F.lit("："), delay_text(F.col("delay_days"))))
    return body.select(*keys, F.concat(F.lit("### 今日关注\n\n"), "body").alias("content"), F.col("n").alias("risk_count"))


#: A renderer for each shape of result; query types that share a shape share a renderer.
RENDERERS = {"timeline": timelines, "delays": delays, "people": people, "terms": terms, "push": push, "table": markdown_table}


def context_warning(used: Column, limit: int) -> Column:
    """A note on how full the context is, from four fifths of the limit on."""
    return F.when(used >= limit, "上下文已满，请开始新的会话。").when(used >= 0.8 * limit, F.format_string("上下文已使用 %d%%。", (100 * used / limit).cast("int"))).otherwise("")


__all__ = ["RENDERERS", "context_warning", "delays", "people", "push", "table_row", "terms", "timelines"]
