"""Replies of a model: their JSON, cut off or not, and checks of the reports in them against the events they tell of."""

from __future__ import annotations

import json
import re
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicon as L

#: Headings that begin no data row, claims of delay, longest table row, what a report has to hold.
HEADINGS = ["阶段", "类别", "Category"]
CLAIMS = [r"延期主要集中在[*\s]*([^*\n]+)[*\s]*阶段", r"([*\s]*[^*\n]+[*\s]*)阶段出现延期", r"累计延期约\s*(\d+)\s*天", r"最大单次延期\s*(\d+)\s*天"]
LONGEST_ROW = 200
TIMELINE_WORDS, CONCLUSION_WORDS = ["时间线", "###"], ["根因", "结论", "分析"]


# JSON


def closed(text: str) -> str | None:
    """The JSON value that a text, cut off anywhere, begins: open strings, lists and objects closed, what dangles dropped.

    A stack of what is open is kept; the longest beginning that its closers make valid is taken, tried at the ends of
    values only. None if there is none.
    """
    text = text.strip()
    stack, ends, in_string, escaped = [], [], False, False
    for i, c in enumerate(text):
        if in_string:
            escaped, in_string = (c == "\\" and not escaped), (escaped or c != '"')
            if not in_string:
                ends.append((i + 1, list(stack)))
                if not stack:
                    break
        elif c == '"':
            in_string = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            ends.append((i + 1, list(stack)))
        elif c in "}]":
            if not stack or stack.pop() != c:
                break
            ends.append((i + 1, list(stack)))
            if not stack:
                break
        elif c.isalnum():
            ends.append((i + 1, list(stack)))
    candidates = [text + "".join(['"' if in_string else "", *reversed(stack)])] if text else []
    if in_string and escaped:
        candidates = [text[:-1] + '"' + "".join(reversed(stack))]
    try:
        json.loads(text)
        wrong = len(text)
    except json.JSONDecodeError as e:
        wrong = e.pos
    later = (text[:at] + "".join(reversed(open_)) for at, open_ in reversed(ends) if at <= wrong)  # no beginning beyond the first error is valid
    for candidate in chain(candidates, later):
        try:
            json.loads(candidate)
        except ValueError:
            continue
        return candidate
    return None


def repaired_json(text: Column) -> Column:
    """Valid JSON for each text, null where none can be made."""

    @F.pandas_udf(StringType())
    def repair(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else closed(t))

    return repair(text)


def field(text: Column, name: str) -> Column:
    """A string field's value out of a broken reply; null if it is not there."""
    return F.nullif(F.regexp_extract(text, rf'"{re.escape(name)}"\s*:\s*"([^"]*)', 1), F.lit(""))


def salvaged(text: Column) -> Column:
    """struct(thought, satisfied, template, message): what is complete in a reply that cannot be read as JSON."""
    said = F.regexp_extract(text, r'"satisfied"\s*:\s*(true|false)', 1)
    satisfied = F.when(said == "", True).otherwise(said == "true")
    answer = satisfied & text.rlike(r'"name"\s*:\s*"generate_answer"')
    return F.struct(F.coalesce(field(text, "thought"), F.lit("输出被截断")).alias("thought"), answer.alias("satisfied"), F.when(answer, F.coalesce(field(text, "template"), F.lit("not_found"))).alias("template"), F.when(answer, field(text, "message")).alias("message"))


def json_list(text: Column, schema: str) -> Column:
    """An array of this element schema, given as such or as the first list of an object."""
    inside = F.regexp_extract(text, r"(?s)^\s*\{[^\[]*(\[.*\])[^\]]*\}\s*$", 1)
    return F.from_json(F.when(inside != "", inside).otherwise(text), f"array<{schema}>")


def first_list(*lists: Column) -> Column:
    """The first list that is not empty."""
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])


def from_heading(text: Column) -> Column:
    """From the report's heading on, else from the first heading at all; without one all of it."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"(?s)(##\s+📋.*)", r"(?s)((?<![^\n])# .*)")], text)


# tables in Markdown


def tables(text: Column) -> Column:
    """Runs of lines with a bar, each an array of its lines."""
    lines = F.split(text, "\n")
    grown = F.aggregate(
        lines,
        F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open")),
        lambda a, x: F.when(x.contains("|"), F.struct(a["done"].alias("done"), F.array_append(a["open"], x).alias("open"))).otherwise(F.struct(F.when(F.size(a["open"]) > 0, F.array_append(a["done"], a["open"])).otherwise(a["done"]).alias("done"), F.array().cast("array<string>").alias("open"))),
    )
    return F.when(F.size(grown["open"]) > 0, F.array_append(grown["done"], grown["open"])).otherwise(grown["done"])


def data_rows(lines: Column) -> Column:
    """Cells of each data row: rules, headings and rows of fewer than four cells left out."""
    rows = F.filter(lines, lambda x: ~x.rlike(r"^\s*\|[-:\s|]+\|\s*$"))
    cells = F.transform(rows, lambda x: F.filter(F.transform(F.split(x, r"\|"), lambda y: F.trim(y)), lambda c: c != ""))
    return F.filter(cells, lambda c: (F.size(c) >= 4) & ~F.element_at(c, 1).isin(HEADINGS))


def all_rows(text: Column) -> Column:
    return F.flatten(F.transform(tables(text), data_rows))


def claims(text: Column) -> Column:
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in CLAIMS]))


# checks; each gives an array of messages


def structure_errors(text: Column) -> Column:
    found = all_rows(text)
    named = F.transform(F.filter(found, lambda r: ~F.element_at(r, 1).isin(L.CATEGORIES)), lambda r: F.concat(F.lit("未知类别: "), F.element_at(r, 1)))
    dated = F.transform(F.filter(found, lambda r: (F.element_at(r, 3) != "-") & ~F.element_at(r, 3).rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}$")), lambda r: F.concat(F.lit("日期格式错误: "), F.element_at(r, 3)))
    long = F.transform(F.filter(found, lambda r: F.length(F.array_join(r, "|")) > LONGEST_ROW), lambda r: F.concat(F.lit("行过长: "), F.length(F.array_join(r, "|")).cast("string")))
    return F.when(F.size(tables(text)) == 0, F.array(F.lit("未发现 Markdown 表格"))).when(F.size(found) == 0, F.array(F.lit("未解析到有效数据行"))).otherwise(F.concat(named, dated, long))


def temporal_errors(text: Column, given: Column) -> Column:
    """Dates that no event has (those after the word for plans may be plans), and dates out of order."""
    shown = F.regexp_extract_all(text, F.lit(r"(\d{4}[-/]\d{2}[-/]\d{2})"), F.lit(1))
    plain = lambda xs: F.transform(xs, lambda d: F.replace(d, F.lit("/"), F.lit("-")))
    before_plan = F.element_at(F.split(text, "计划", 2), 1)
    invented = F.filter(shown, lambda d: ~F.array_contains(plain(given), F.replace(d, F.lit("/"), F.lit("-"))) & (~text.contains("计划") | before_plan.contains(d)))
    order = F.when(shown == F.array_sort(shown), F.array().cast("array<string>")).otherwise(F.array(F.lit("日期未按时间顺序排列")))
    return F.concat(F.transform(invented, lambda d: F.concat(F.lit("输入没有的日期: "), d)), order)


def missing_categories(text: Column, given: Column) -> Column:
    shown = F.transform(all_rows(text), lambda r: F.element_at(r, 1))
    return F.transform(F.array_sort(F.array_except(F.array_except(given, shown), F.array(F.lit(""), F.lit(L.OTHER)))), lambda c: F.concat(F.lit("未包含类别: "), c))


def unfounded_claims(text: Column, descriptions: Column) -> Column:
    said = F.transform(claims(text), lambda y: F.trim(y))
    return F.transform(F.filter(said, lambda c: ~descriptions.contains(c) & ~c.isin(L.CATEGORIES)), lambda c: F.concat(F.lit("延期归因无依据: "), c))


def format_errors(text: Column) -> Column:
    has = lambda words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    none = F.array().cast("array<string>")
    short = F.filter(tables(text), lambda t: F.size(t) < 3)
    return F.concat(F.when(has(TIMELINE_WORDS), none).otherwise(F.array(F.lit("缺少时间线"))), F.when(has(CONCLUSION_WORDS), none).otherwise(F.array(F.lit("缺少根因分析"))), F.transform(short, lambda t: F.lit("表格少于3行")))


def validate(text: Column, dates: Column, categories: Column, descriptions: Column) -> Column:
    """struct(valid, errors, warnings): structure and invented dates are errors, the rest are warnings."""
    errors = F.array_distinct(F.concat(structure_errors(text), temporal_errors(text, dates)))
    warnings = F.array_distinct(F.concat(missing_categories(text, categories), unfounded_claims(text, descriptions), format_errors(text)))
    return F.struct((F.size(errors) == 0).alias("valid"), errors.alias("errors"), warnings.alias("warnings"))
