import pytest
from pyspark.sql import functions as F

from weftline.functions import lexicon as L
from weftline.functions import text as X
from weftline.operators import datasets as B
from weftline.operators import shaping as O
from weftline.plans import planner as R

CASES = [
    (X.mask_pii, "mail a.b@x.com or 13812345678", "mail [EMAIL] or [PHONE]"),
    (X.order_ids, "010125 310052 2023621", ["2023621", "310052"]),
    (X.normalize_subject, "Re: 回复: CCSS230021 sample", "回复: CCSS230021 sample"),
    (X.person_name, "ANN", "Ann"), (X.person_name, "lisa/vivi", "Lisa/Vivi"), (X.person_name, "工厂", None), (X.person_name, "", None), (X.person_name, "o'neil-x", "O'Neil-X"),
    (X.estimate_tokens, "hello world", 2), (X.estimate_tokens, "面料 ok", 3), (X.estimate_tokens, None, 0),
    (X.style_ids, "款号CCSS230021的 CCSS230022 ok", ["CCSS230022"]),
    (X.classify_category, "the lab dip and fabric", "Lab Dip"), (X.classify_category, "", "其他"),
    (X.parse_date, "Tue, 5 Mar 2024 10:00:00 +0800", "2024-03-05"), (X.parse_date, "on 2024/3/7 we", "2024-03-07"), (X.parse_date, "none", None),
    (X.iso_date_or_blank, "2024-1-1", ""), (X.slug, "面料 a-b", "面料_a_b"), (X.half_width, "ＡＢ　１", "AB 1"),
    (X.is_continuation, "继续", True), (X.is_continuation, "查", True), (X.is_continuation, "查货", False),
    (X.event_focus, "why the Shipment", "出货"), (X.first_style_id, "1234567 and ccss230021", "CCSS230021"),
    (X.clean_html, "<p>a&amp;b</p><script>x</script> c", "a&b c"), (X.title_of, "x" * 25, "x" * 20 + "..."), (X.local_part, "a.b@c", "a.b"),
    (X.json_block, 'so ```json\n{"a": 1}\n``` ok', '{"a": 1}'), (X.strip_controls, "a\x01b\tc", "ab\tc"),
    (X.remove_noise, "hello\nFrom: x\nTo: y\nbody\n--\nsig\n\nend", "hello\nbody\nend"),
    (X.html_tables, "<table><tr><td>a</td><td></td></tr><tr><th>b</th></tr></table><table><tr><td>x</td></tr></table>", [[["a"], ["b"]]]),
    (X.dates_in, "2024-01-02 and 2024/03/04", ["2024-01-02", "2024/03/04"]), (X.potential_terms, "the 面料 is fabric", ["面料", "fabric"]),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_scalar(spark, n):
    f, given, wanted = CASES[n]
    assert spark.createDataFrame([(given,)], "t string").select(f(F.col("t")).alias("x")).first()[0] == wanted


def test_enum_backfill_route(spark):
    one = spark.createDataFrame([("x",)], "t string")
    pick = lambda c: one.select(c.alias("x")).first()[0]
    assert pick(X.coerce_enum(F.lit("面料确认"), L.CATEGORIES)) == "面料"
    assert pick(X.coerce_enum(F.lit(""), L.CATEGORIES)) == "其他"
    assert pick(X.backfill_id(F.lit("UNKNOWN"), F.array(F.lit("A")))) == "A"
    assert pick(R.route(F.lit("和谁合作"), F.lit(False)))["strategy"] == "kg_relational"
    assert pick(X.blacklisted(F.lit("Out of Office: x"), F.lit("a@b"))).startswith("subject:")
    assert pick(X.event_document({"a": F.lit("1"), "b": F.lit(""), "c": F.lit("未知")})) == "a: 1"
    assert len(R.CHAINS) == 33 and len(R.SINGLES) == 13
    with pytest.raises(ValueError):
        R.chain("timeline", "my_styles", {})
    assert B.scaled_counts({"a": 1, "b": 3}, 0.5, 10, "b") == {"a": 1, "b": 9}


def test_entities_are_resolved_once_and_in_order(spark):
    rows = ["a &amp;lt; b", "&lt;b&gt; &amp; &nbsp;c", "x\u3000\xa0 y\x1c z", "<SCRIPT a=1>no</script>t<style>p</style>", ""]
    df = spark.createDataFrame([(x,) for x in rows], "s string")
    got = [r[0] for r in df.select(X.clean_html(F.col("s"))).collect()]
    assert got == ["a &lt; b", "<b> & c", "x y z", "t", ""]
    assert df.select(X.clean_html(F.lit("&amp;quot;&#160;x"), full=True)).first()[0] == '" x'


def test_no_digit_of_a_telephone_number_is_left(spark):
    rows = {"8613812345678": "[PHONE]", "+86 13812345678.": "[PHONE].", "+86-021-12345678": "[PHONE]", "tel 010-1234567 or 0571 12345678": "tel [PHONE] or [PHONE]", "a.b@c.com 13912345678": "[EMAIL] [PHONE]", "12345": "12345"}
    df = spark.createDataFrame([(x,) for x in rows], "s string")
    assert [r[0] for r in df.select(X.mask_pii(F.col("s"))).collect()] == list(rows.values())


def test_rows_without_a_stage_are_dealt_too(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, ""), (5, "其他")], "seq int, category string")
    got = [(r.seq, r["round"]) for r in O.by_stage(rows, 10, "category", ["seq"]).collect()]
    assert got == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)]
