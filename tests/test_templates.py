import pytest
from pyspark.sql import functions as F

from weftline.functions import templates as P


def test_one_decimal_is_that_of_c(spark):
    xs = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 12.35, 12.45, 12.55, 2.5, 99.95, 1e6 + 0.25, -3.25, -0.04, 7.0, 1 / 3, 1234.549999, 1e12 + 0.75]
    xs += [i / 100 for i in range(-300, 300)] + [i / 37 for i in range(200)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", P.one_decimal(F.col("x")).alias("s")).collect()
    assert [(r.x, r.s) for r in got] == [(r.x, "%.1f" % r.x) for r in got]


def test_fields_that_are_missing_null_or_zero(spark):
    df = spark.createDataFrame([(None, "b", 0), ("", None, 3), ("a", "b", 0)], "x string, y string, n int")
    assert [r[0] for r in df.select(P.field(df, "nothing", "x", "y", default="-")).collect()] == ["b", "-", "a"]
    assert [r[0] for r in df.select(P.field(df, "n", default=0)).collect()] == ["0", "3", "0"]


def test_query_type_of_null_and_of_no_json(spark):
    df = spark.createDataFrame([(None,), ("",), ("{",), ("{}",)], "r string")
    assert {r[0] for r in df.select(P.query_type(F.col("r"))).collect()} == {P.UNKNOWN_TYPE}


def test_styles_without_days_or_stage(spark):
    rows = spark.createDataFrame([("k", 1, None, None), ("k", 2, "", 5), ("k", 3, "s", -1)], "key string, style_id long, latest_category string, total_delay_days long")
    assert P.listed(rows, "key", ["style_id"]).first().answer == "共 **3** 个：\n\n1. 1\n2. 2\n3. **3** - s"
    assert P.progress(rows, "key", ["style_id"], 2).first().answer.endswith('*仅显示前 2 个，共 3 个款号。如需查看全部，请说"剩下的"*')
    assert P.delayed(rows, "key").first().answer == "**延期款号**（共 1 个）：\n\n- **2** - 延期5天\n\n✅ 提前完成：1 个款号"
    assert P.factory_styles(rows, "key").first().answer.endswith("**准时款号**（1 个）：1\n")


@pytest.mark.parametrize("make", [lambda d: P.listed(d, "key", ["style_id"]), lambda d: P.delayed(d, "key"), lambda d: P.factory_styles(d, "key")])
def test_no_rows_no_answers(spark, make):
    assert make(spark.createDataFrame([], "key string, style_id long, latest_category string, total_delay_days long")).count() == 0
