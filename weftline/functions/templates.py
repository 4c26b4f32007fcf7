"""Answers by template: one Markdown text a key, aggregated from the rows that it tells of.

A template that shows only the first rows of a key ranks them before they are gathered, so a key with many rows sends on
no more than are shown. Lists that show everything (`listed`, `factory_ranking`, `summaries`) hold all rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .render import table_row

#: Rows shown of long lists, of lists of styles and people, and of recent events; characters of a description.
SHOWN, FEW, RECENT, LONGEST = 20, 10, 5, 30
#: The names that queries call each template by.
TEMPLATES = {
    "translation": ["term_translation"],
    "listed": ["style_list"],
    "progress": ["my_styles_summary"],
    "counted": ["my_styles_count", "my_styles_total"],
    "factory_ranking": ["factory_delay_ranking", "factory_delays_ranking", "factory_delays_summary"],
    "factory_summary": ["factory_delay_summary"],
    "delayed": ["delayed_styles_list", "my_styles_delays", "delayed_styles", "delay_list", "delayed_styles_detail", "my_styles_delayed", "my_styles_delayed_summary"],
    "details": ["style_detail", "style_overview", "style_progress", "style_timeline", "style_people"],
    "collaborators": ["collaborators_list", "collaborator_list"],
    "delay_analysis": ["style_delay_analysis"],
    "factory_styles": ["factory_styles_with_delays", "factory_styles_timeline", "factory_delayed_styles_summary", "factory_delay_issues", "factory_styles_with_emails", "factory_no_delay_styles", "factory_style_count"],
    "event_table": ["event_list", "fabric_progress_abnormal", "delayed_stages_email", "my_styles_recent_emails", "delay_reasons", "transport_delay_summary"],
    "summaries": ["delayed_styles_summary", "style_summaries", "my_styles_update", "my_styles_recent_updates"],
    "overviews": ["my_styles_overview", "my_styles_event_count_analysis", "my_styles_and_events"],
}
#: The query that a result comes from, told by the name of its list.
QUERY_TYPES = {
    "events": "rag_query.semantic_search", "styles": "kg_query.my_styles", "summaries": "kg_query.style_summaries",
    "collaborators": "kg_query.collaborators", "factories": "kg_query.factory_delays", "translations": "rag_query.term_translation",
}
CHAIN_TYPE, UNKNOWN_TYPE = "kg_query.style_summaries", "unknown"


# columns


def template_of(name: Column) -> Column:
    """Which of this module's templates a name calls; null for a name that none has."""
    found = F.lit(None).cast("string")
    for template, names in TEMPLATES.items():
        found = F.when(name.isin(names), template).otherwise(found)
    return found


def query_type(result: Column) -> Column:
    """The query that a JSON result comes from. With _meta and one list it is a chain's; null and other JSON are unknown."""
    own = lambda json: F.filter(F.json_object_keys(json), lambda k: ~k.startswith("_") & (k != "status"))
    outer = own(result)
    call = F.get(outer, F.lit(0))
    inner = F.json_object_keys(F.get(F.map_values(F.from_json(result, "map<string,string>")), F.array_position(F.json_object_keys(result), call).cast("int") - 1))
    main = F.coalesce(F.get(F.filter(inner, lambda k: ~k.startswith("_")), F.lit(0)), call)
    told = F.lit(UNKNOWN_TYPE)
    for name, kind in QUERY_TYPES.items():
        told = F.when(main == name, kind).otherwise(told)
    chain = F.array_contains(F.json_object_keys(result), "_meta") & (F.size(outer) == 1)
    return F.when(chain, CHAIN_TYPE).otherwise(told)


def field(rows: DataFrame, *names: str, default: object = "") -> Column:
    """The first of these fields that a row has and that is neither null, empty nor zero; fields may be missing."""
    some = [F.when(~F.col(n).cast("string").isin("", "0"), F.col(n).cast("string")) for n in names if n in rows.columns]
    return F.coalesce(*some, F.lit(str(default)))


def one_decimal(x: Column) -> Column:
    """A number with one decimal, rounded by its exact binary value and ties to even, as C's %.1f does (Java's rounds the
    shortest decimal text). Twenty times the number is added up without loss: its rounded sum and what that lost."""
    size = F.abs(x)
    twenty = 16 * size + 4 * size
    lost = (16 * size - (twenty - (twenty - 16 * size))) + (4 * size - (twenty - 16 * size))
    low = F.floor(twenty / 2)
    over = (twenty - 2 * low - 1) + lost
    tenths = low + F.when(over > 0, 1).when(over < 0, 0).otherwise(low % 2)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.format_string("%d.%d", F.floor(tenths / 10), tenths % 10))


def translation(term: Column, said: Column, category: Column, note: Column) -> Column:
    part = lambda c, head, tail="": F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.concat(F.lit(head), c, F.lit(tail)))
    term = F.coalesce(term, F.lit(""))
    found = F.concat(F.lit("**"), term, F.lit("** 译为：**"), said, F.lit("**"), part(category, "\n\n分类："), part(note, "\n\n*", "*"))
    return F.when(F.coalesce(said, F.lit("")) == "", F.concat(F.lit("抱歉，未找到 **"), term, F.lit("** 的翻译。"))).otherwise(found)


def counted(total: Column) -> Column:
    return F.format_string("您目前负责 **%d** 个款号。", total)


def _name(column: str = "style_id") -> Column:
    return F.concat(F.lit("**"), F.col(column).cast("string"), F.lit("**"))


def _stage(default: str = "未知") -> Column:
    return F.coalesce(F.nullif(F.col("latest_category"), F.lit("")), F.lit(default))


def _days(days: str = "total_delay_days", none: str = "-") -> Column:
    return F.when(F.coalesce(days, F.lit(0)) != 0, F.format_string("%d天", days)).otherwise(none)


# lines of a key


def _ranked(rows: DataFrame, key: str, order: list, most: int | None = None) -> DataFrame:
    """Rows with their place in their key's order, the first `most` of them."""
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return placed if most is None else placed.where(F.col("place") <= most)


def _body(placed: DataFrame, key: str, line: Column, name: str = "body") -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])
    return placed.groupBy(key).agg(F.array_join(lines, "\n").alias(name))


def _size(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def _block(head, body: str, tail: Column | None = None) -> Column:
    """A heading, its lines and an empty line; null, and so left out, without lines."""
    return F.concat(F.lit(head) if isinstance(head, str) else head, F.lit("\n"), F.col(body), F.lit("") if tail is None else tail, F.lit("\n"))


# lists of styles(key, style_id, latest_category, total_delay_days)


def listed(styles: DataFrame, key: str, order: list) -> DataFrame:
    """(key, answer): all styles of a key, numbered."""
    stage = _stage("")
    line = F.concat(F.col("place").cast("string"), F.lit(". "), F.when(stage == "", F.col("style_id").cast("string")).otherwise(F.concat(_name(), F.lit(" - "), stage)))
    both = _body(_ranked(styles, key, order), key, line).join(_size(styles, key), key)
    return both.select(key, F.concat(F.format_string("共 **%d** 个：\n\n", "n"), "body").alias("answer"))


def progress(styles: DataFrame, key: str, order: list, most: int = SHOWN) -> DataFrame:
    """(key, answer): a key's first styles, late ones before the others, and how many there are."""
    shown = _ranked(styles, key, order, most)
    late = F.coalesce("total_delay_days", F.lit(0)) > 0
    line = F.concat(F.lit("  • "), _name(), F.lit(" - "), _stage())
    out = _size(styles, key, "total").join(_size(shown, key, "shown"), key)
    for part, rows, said in (("late", shown.where(late), F.concat(line, F.format_string(" - 延期%d天", "total_delay_days"))), ("fine", shown.where(~late), line)):
        out = out.join(_body(rows, key, said, part), key, "left").join(_size(rows, key, f"{part}_n"), key, "left")
    note = F.when(F.col("total") > F.col("shown"), F.format_string('*仅显示前 %d 个，共 %d 个款号。如需查看全部，请说"剩下的"*', "shown", "total"))
    blocks = _block(F.format_string("⚠️ **延期 (%d个)**：", "late_n"), "late"), _block(F.format_string("✅ **正常 (%d个)**：", "fine_n"), "fine")
    return out.select(key, F.concat_ws("\n", F.format_string("共查询到 **%d** 个款号：\n", "total"), *blocks, note).alias("answer"))


def delayed(styles: DataFrame, key: str) -> DataFrame:
    """(key, answer): the latest styles of a key first; keys without late styles say so."""
    days = F.coalesce("total_delay_days", F.lit(0))
    late = styles.where(days > 0)
    stage = _stage("")
    line = F.concat(F.lit("- "), _name(), F.format_string(" - 延期%d天", "total_delay_days"), F.when(stage == "", "").otherwise(F.concat(F.lit("（"), stage, F.lit("）"))))
    counts = styles.groupBy(key).agg(F.count_if(days > 0).alias("n"), F.count_if(days < 0).alias("ahead"))
    both = counts.join(_body(_ranked(late, key, [F.col("total_delay_days").desc(), "style_id"], SHOWN), key, line), key, "left")
    more = F.when(F.col("n") > SHOWN, F.format_string("\n*... 等共 %d 个款号*", "n"))
    early = F.when(F.col("ahead") > 0, F.format_string("\n✅ 提前完成：%d 个款号", "ahead"))
    text = F.concat_ws("\n", F.format_string("**延期款号**（共 %d 个）：\n", "n"), "body", more, early)
    return both.select(key, F.when(F.col("n") == 0, "暂无延期款号。").otherwise(text).alias("answer"))


def summaries(styles: DataFrame, key: str, order: list) -> DataFrame:
    """(key, answer): a table of all styles of a key with their state and last change."""
    state = F.when(F.col("total_delay_days") > 0, "延期").when(F.col("total_delay_days") < 0, "提前").otherwise("正常")
    line = table_row(F.col("style_id"), _stage("-"), state, _days(), F.col("last_update"))
    both = _body(_ranked(styles, key, order), key, line).join(_size(styles, key), key)
    head = "| 款号 | 当前阶段 | 状态 | 延期天数 | 最后更新 |\n|------|---------|------|---------|---------|"
    return both.select(key, F.concat_ws("\n", F.format_string("**款号摘要**（共 %d 个）：\n", "n"), F.lit(head), "body").alias("answer"))


def overviews(styles: DataFrame, key: str, order: list) -> DataFrame:
    """(key, answer): the first styles of a key with event_count and people, and how many more there are."""
    line = F.concat(F.lit("- "), _name(), F.lit("："), _stage(""), F.format_string("，%d 个事件，%d 人参与", "event_count", "people"))
    both = _body(_ranked(styles, key, order, FEW), key, line).join(_size(styles, key), key)
    more = F.when(F.col("n") > FEW, F.format_string("- ... 等共 %d 个", "n"))
    return both.select(key, F.concat_ws("\n", F.format_string("**款号概览**（共 %d 个）：\n", "n"), "body", more).alias("answer"))


# factories(key, factory_id, name, style_count, total_delay_days, avg_delay)


def _extremes(factories: DataFrame, key: str) -> DataFrame:
    """(key, worst, longest): the factories with the most days and the longest average, where those are not zero."""
    facts = F.struct("name", "total_delay_days", "avg_delay")
    top = lambda c: F.max_by(facts, F.when(F.col(c) != 0, F.struct(c, -F.col("factory_id"))))
    return factories.groupBy(key).agg(top("total_delay_days").alias("worst"), top("avg_delay").alias("longest"))


def factory_ranking(factories: DataFrame, key: str) -> DataFrame:
    """(key, answer): a table of a key's factories, most days first."""
    placed = _ranked(factories, key, [F.col("total_delay_days").desc(), "factory_id"])
    line = table_row(F.col("place"), F.col("name"), F.col("total_delay_days"), one_decimal(F.col("avg_delay")), F.col("style_count"))
    both = _body(placed, key, line).join(_extremes(factories, key), key)
    head = "**工厂延期排名**：\n\n| 排名 | 工厂 | 总延期天数 | 平均延期 | 涉及款号 |\n|------|------|-----------|---------|---------|"
    worst = F.concat(F.lit("\n🔴 延期最严重：**"), "worst.name", F.format_string("**（总延期 %d 天）", "worst.total_delay_days"))
    longest = F.concat(F.lit("🟡 平均延期最长：**"), "longest.name", F.lit("**（平均 "), one_decimal(F.col("longest.avg_delay")), F.lit(" 天）"))
    return both.select(key, F.concat_ws("\n", F.lit(head), "body", worst, longest).alias("answer"))


def factory_summary(factories: DataFrame, key: str) -> DataFrame:
    """(key, answer): the two extremes of a key's factories, and all of them in a line each."""
    placed = _ranked(factories, key, [F.col("total_delay_days").desc(), "factory_id"])
    line = F.concat(F.lit("- "), _name("name"), F.format_string("：总延期 %d 天，平均 ", "total_delay_days"), one_decimal(F.col("avg_delay")), F.format_string(" 天，%d 个款号", "style_count"))
    both = _body(placed, key, line).join(_extremes(factories, key), key)
    worst = F.concat(F.lit("🔴 延期最严重工厂：**"), "worst.name", F.format_string("**\n   - 总延期天数：%d\n   - 平均延期：", "worst.total_delay_days"), one_decimal(F.col("worst.avg_delay")), F.lit(" 天\n"))
    longest = F.concat(F.lit("🟡 平均延期最长工厂：**"), "longest.name", F.lit("**（"), one_decimal(F.col("longest.avg_delay")), F.lit(" 天/款）\n"))
    return both.select(key, F.concat_ws("\n", F.lit("**工厂延期统计**：\n"), worst, longest, F.lit("**工厂列表**："), "body").alias("answer"))


def factory_styles(styles: DataFrame, key: str = "name") -> DataFrame:
    """(key, answer) of styles(key, style_id, total_delay_days): counts, the latest styles, and those on time."""
    days = F.coalesce("total_delay_days", F.lit(0))
    late, fine = styles.where(days > 0), styles.where(days == 0)
    counts = styles.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(days > 0).alias("late_n"), F.count_if(days == 0).alias("fine_n"))
    some = lambda c, said: F.when(F.col(c) > 0, F.format_string(said, c))
    stats = F.concat(F.concat_ws(" | ", some("n", "在制款号：**%d** 个"), some("late_n", "⚠️ 延期：**%d** 个"), some("fine_n", "✅ 无延期：**%d** 个")), F.lit("\n"))
    shown = _body(_ranked(late, key, [F.col("total_delay_days").desc(), "style_id"], FEW), key, F.concat(F.lit("- "), _name(), F.format_string("（延期%d天）", "total_delay_days")), "late")
    on_time = _body(_ranked(fine, key, ["style_id"], FEW), key, F.col("style_id").cast("string"), "fine")
    both = counts.join(shown, key, "left").join(on_time, key, "left")
    more = F.when(F.col("late_n") > FEW, F.format_string("\n- ... 等共 %d 个", "late_n")).otherwise("")
    punctual = F.concat(F.format_string("**准时款号**（%d 个）：", "fine_n"), F.replace(F.col("fine"), F.lit("\n"), F.lit(", ")), F.lit("\n"))
    return both.select(key, F.concat_ws("\n", F.concat(F.lit("## 🏭 "), key, F.lit("\n")), stats, _block("**延期款号**：", "late", more), punctual).alias("answer"))


# people and events


def collaborators(rows: DataFrame, key: str = "person", most: int = SHOWN) -> DataFrame:
    """(key, answer) of rows(key, other, event_count, style_count): those with the most events together, and the number of all."""
    line = table_row(F.col("place"), F.col("other"), F.col("event_count"), F.col("style_count"))
    both = _body(_ranked(rows, key, [F.col("event_count").desc(), "other"], most), key, line).join(_size(rows, key), key)
    head = F.concat(_name(key), F.format_string(" 的协作对象（共 %d 人）：\n\n| 排名 | 姓名 | 共同事件 | 共同款号 |\n|------|------|---------|---------|", "n"))
    return both.select(key, F.concat_ws("\n", head, "body").alias("answer"))


def event_table(events: DataFrame, key: str, order: list) -> DataFrame:
    """(key, answer): a table of a key's first events, and how many there are in all."""
    said = F.substring(field(events, "description", "event_type"), 1, LONGEST)
    line = table_row(F.col("date"), F.col("style_id"), F.col("category"), said, _days("delay_days"))
    both = _body(_ranked(events, key, order, SHOWN), key, line).join(_size(events, key), key)
    head = "| 时间 | 款号 | 阶段 | 描述 | 延期 |\n|------|------|------|------|------|"
    more = F.when(F.col("n") > SHOWN, F.format_string("\n*... 等共 %d 个事件*", "n"))
    return both.select(key, F.concat_ws("\n", F.format_string("**事件详情**（共 %d 个）：\n", "n"), F.lit(head), "body", more).alias("answer"))


def delay_analysis(events: DataFrame, key: str = "style_id") -> DataFrame:
    """(key, answer): days late in all and by category, most first; the first of them is the bottleneck."""
    late = events.groupBy(key, "category").agg(F.sum(F.when(F.col("delay_days") > 0, F.col("delay_days"))).alias("days")).where("days > 0")
    placed = _ranked(late, key, [F.col("days").desc(), "category"])
    body = _body(placed, key, F.concat(F.lit("- "), "category", F.format_string("：%d 天", "days")))
    facts = placed.groupBy(key).agg(F.sum("days").alias("total"), F.min_by("category", "place").alias("first"), F.array_join(F.array_sort(F.collect_list("category")), ", ").alias("stages"))
    head = F.concat(F.lit("## ⚠️ 款号 "), F.col(key).cast("string"), F.format_string(" 延期分析\n\n**累计延期：%d 天**\n", F.coalesce("total", F.lit(0))))
    first = F.concat(F.lit("🔴 **当前瓶颈**："), "first", F.lit("\n"))
    stages = F.concat(F.lit("**延期阶段**："), "stages", F.lit("\n"))
    both = events.select(key).distinct().join(facts, key, "left").join(body, key, "left")
    return both.select(key, F.concat_ws("\n", head, first, _block("**各阶段延期分布**：", "body"), stages).alias("answer"))


def details(styles: DataFrame, people: DataFrame, events: DataFrame, seq: tuple[str, ...] = ("order_id", "line", "factory_id"), key: str = "style_id") -> DataFrame:
    """(key, answer): a style's state, its people(key, person, role, event_count), its events by category, the newest of
    them and the latest of them. Events are dealt out by key once, for all that is told of them."""
    said = field(events, "description", "event_type").alias("said")
    mine = events.select(key, "category", "date", "delay_days", *seq, said).repartition(key)
    place = lambda *order: F.row_number().over(Window.partitionBy(key).orderBy(*order, *seq))
    placed = mine.withColumns({"new": place(F.col("date").desc()), "worst": place(F.col("delay_days").desc())})
    delay = F.when(F.coalesce("delay_days", F.lit(0)) != 0, F.format_string(" [延期%d天]", "delay_days")).otherwise("")
    newest = F.when(F.col("new") <= RECENT, F.struct("new", F.concat(F.lit("- "), "date", F.lit(" "), "category", F.lit("："), "said", delay).alias("line")))
    late = F.when((F.col("delay_days") > 0) & (F.col("worst") <= RECENT), F.struct("worst", F.concat(F.lit("- "), "said", F.format_string("（延期%d天）", "delay_days")).alias("line")))
    by = placed.groupBy(key, "category").agg(F.count(F.lit(1)).alias("k"), F.collect_list(newest).alias("newest"), F.collect_list(late).alias("late"), F.count_if(F.col("delay_days") > 0).alias("late_n"))
    stage = F.struct(-F.col("k"), "category", F.concat(F.lit("- "), "category", F.format_string("：%d 个事件", "k")).alias("line"))
    joined = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda x: x["line"]), "\n")
    told = by.groupBy(key).agg(joined(F.collect_list(stage)).alias("stages"), joined(F.flatten(F.collect_list("newest"))).alias("newest"), F.when(F.sum("late_n") > 0, joined(F.flatten(F.collect_list("late")))).alias("late"), F.nullif(F.sum("late_n"), F.lit(0)).alias("late_n"))
    parts = [_body(_ranked(people, key, [F.col("event_count").desc(), "person"], FEW), key, F.concat("person", F.lit("（"), "role", F.lit("）")), "people"), told]
    both = styles
    for part in parts:
        both = both.join(part, key, "left")
    some = lambda c, text: F.when(~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0"), text)
    info = F.concat_ws(
        " | ", some("latest_category", F.concat(F.lit("当前阶段：**"), "latest_category", F.lit("**"))), some("event_count", F.format_string("事件数：%d", "event_count")),
        some("last_update", F.concat(F.lit("最后更新："), "last_update")), some("total_delay_days", F.format_string("⚠️ 累计延期：%d 天", "total_delay_days")),
    )
    who = F.concat(F.lit("**相关人员**："), F.replace(F.col("people"), F.lit("\n"), F.lit(", ")), F.lit("\n"))
    head = F.concat(F.lit("## 📋 款号 "), F.col(key).cast("string"), F.lit("\n"))
    blocks = _block("**阶段分布**：", "stages"), _block("**最近事件**：", "newest"), _block(F.format_string("**延期事件**（%d 个）：", "late_n"), "late")
    return both.select(key, F.concat_ws("\n", head, F.when(info != "", F.concat(info, F.lit("\n"))), who, *blocks).alias("answer"))
