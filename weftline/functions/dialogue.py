"""Rules on a conversation: what a question refers to, whether it asks for two things, and the messages of a session."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_style_id

#: Words that refer to one style, to several, and to a person's styles; what is said to a mixed question.
THIS, THESE, OWN = ["这个款号", "该款号", "这款"], ["这几个款号", "这些款号"], ["所有款号", "我跟的", "我的款号"]
MIXED = "您的问题包含多个意图（有款号查询+无款号查询），请拆分后分别提问。"


def rewritten(text: Column, remembered: Column) -> Column:
    """The question with its references resolved from an array of remembered style ids: an ordinal takes one of them, `these`
    all, `this` the last. It stays as it is if nothing is referred to or the list is too short."""
    ordinal = r"第(\d{1,4})个(?:款号)?"
    n = F.regexp_extract(text, ordinal, 1).try_cast("int")
    nth = F.when(n.between(1, F.size(remembered)), F.replace(text, F.regexp_extract(text, ordinal, 0), F.get(remembered, n - 1)))
    swap = lambda words, by: F.when(text.rlike("|".join(words)), reduce(lambda a, w: F.replace(a, F.lit(w), by), words, text))
    found = F.coalesce(nth, swap(THESE, F.array_join(remembered, ", ")), swap(THIS, F.try_element_at(remembered, F.lit(-1))))
    return F.coalesce(F.when(F.size(remembered) > 0, found), text)


def mixed(text: Column) -> Column:
    """Whether a question asks for a style and for somebody's styles at once."""
    return first_style_id(text).isNotNull() & text.rlike("|".join(OWN))


def session(user: Column, routed: Column, rounds: Column, report: Column, answer: Column) -> Column:
    """array<struct(role, content)>: the user, the router, call and result of each of rounds(call, result), the report if
    there is one, and the answer."""
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    one = lambda role, c: F.when(c.isNotNull(), F.array(said(role, c))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    between = F.flatten(F.transform(rounds, lambda r: F.array(said("v2", r["call"]), said("tool", r["result"]))))
    return F.concat(one("user", user), one("v3", routed), F.coalesce(between, F.array().cast("array<struct<role:string,content:string>>")), one("v1", report), one("assistant", answer))
