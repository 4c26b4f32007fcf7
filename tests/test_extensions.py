"""Graph state by batches, term pages, replies and answers."""

import json

import pytest

from pyspark.sql import functions as F

from weftline.functions import replies as Q
from weftline.operators import graph as G
from weftline.operators import rollups as A
from weftline.operators import terms as T
from weftline.plans.domain import events
from weftline.streaming import graph_state as S


def same(a, b):
    b = b.select(*a.columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_batches_equal_rebuild(spark, sf_dir, tmp_path, monkeypatch):
    ev = events(spark, sf_dir).where("order_id <= 200").cache()
    state = S.GraphState(spark, str(tmp_path))
    for batch, n in enumerate((2, 0, 1)):
        part = ev.where(F.col("order_id") % 3 == n)
        if batch == 1:  # written, but lost before the pointer moved
            monkeypatch.setattr(state.pointer, "write", lambda *_: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                state.apply(part.limit(5), batch)
            state = S.GraphState(spark, str(tmp_path))
        state.apply(part, batch)
        state.apply(part, batch)  # tried again after it moved
        state = S.GraphState(spark, str(tmp_path))  # a new driver
    tables = state.tables()
    same(S.styles(tables), A.style_rollup(ev))
    same(S.people(tables), A.person_rollup(ev))
    same(S.collaborations(tables), A.collaborations(ev))
    same(S.categories(tables), A.category_rollup(ev))
    same(S.emails(tables), A.email_rollup(ev))
    same(state.table("follows"), G.follows(ev))


def test_closed():
    assert json.loads(Q.closed('{"a": "x", "b": [1, 2')) == {"a": "x", "b": [1, 2]}
    assert json.loads(Q.closed('{"a": "x", "b": ')) == {"a": "x"} or json.loads(Q.closed('{"a": "x", "b": '))["a"] == "x"
    assert json.loads(Q.closed('{"a": "cut of')) == {"a": "cut of"}
    assert Q.closed("") is None


def test_pages(spark):
    def line(page, y, text, x=50.0):
        return [(page, x + i, y, c) for i, c in enumerate(text)]

    rows = line(20, 300.0, "一、服装成品") + line(20, 200.0, "上衣") + line(20, 180.5, "ｃｏａｔ") + line(170, 200.0, "ｄｒｅｓｓ［x］连衣裙") + line(3, 10.0, "封面")
    chars = spark.createDataFrame(rows, "page int, x0 double, y0 double, text string")
    got = {(r.chinese, r.english, r.category, r.page, r.type) for r in T.page_terms(chars).collect()}
    assert ("上衣", "coat", "服装成品", 20, "汉英") in got and ("连衣裙", "dress", "英汉词汇", 170, "英汉") in got and len(got) == 2


def test_validate(spark):
    text = "### 时间线\n| 阶段 | 类型 | 日期 | 说明 |\n|---|---|---|---|\n| 面料 | 提交 | 2024-01-05 | x |\n| 外星 | 提交 | 2024-13 | y |\n结论"
    one = spark.createDataFrame([(text,)], "t string")
    out = one.select(Q.validate(F.col("t"), F.array(F.lit("2024-01-05")), F.array(F.lit("面料"), F.lit("封样")), F.lit("")).alias("v")).first().v
    assert not out.valid and out.errors == ["未知类别: 外星", "日期格式错误: 2024-13"] and out.warnings == ["未包含类别: 封样"]
