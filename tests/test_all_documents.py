"""Text queries over documents of every language against Python's re, as the reference reads them."""

import os
import re
from collections import Counter

import pytest

from weftline.functions import lexicon as L
from weftline.plans import catalogue, queries

TEXTS = [
    "订单 123456 和 2023621，款号 CCSS230021 好", "款号CCSS230021的 订单310052号 310052", "010125 991231 130199 123456789 1234567890", "naïve order 654321 – ccss230022 é1234567",
    "面料fabric 辅料 the fabric, and 请 lab-dip cafés", "“quoted” trim\x85 谢谢 面料", "plain fabric text\x07", "clean fabric text", "", None, "ok é",
]


@pytest.fixture(scope="module")
def given(spark, sf_dir, tmp_path_factory):
    at = tmp_path_factory.mktemp("all_documents")
    for name in os.listdir(sf_dir):
        if name != "documents.parquet":
            os.symlink(os.path.join(sf_dir, name), at / name)
    rows = [(i, x, "zh", "s", len(x or "")) for i, x in enumerate(TEXTS)] + [(100 + r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return str(at), {r[0]: r[1] for r in rows}


def order_ids(text):
    found = {x for n in (6, 7, 8, 9) for x in re.findall(rf"\b[0-9]{{{n}}}\b", text)}
    return sorted(x for x in found if not (len(x) == 6 and int(x[:2]) <= 12 and int(x[2:4]) <= 31))


def terms(text):
    return (set(re.findall("[一-龥]{2,10}", text)) | set(re.findall(r"\b[a-zA-Z][a-zA-Z\-]{2,20}\b", text))) - set(L.TERM_STOPWORDS)


def test_ids(spark, given):
    got = {r.doc_id: (r.order_ids, r.style_ids) for r in queries.QUERIES["id_extraction_all"](spark, given[0]).collect()}
    assert set(got) == set(given[1])
    for i, text in given[1].items():
        styles = sorted({x for p in L.STYLE_PATTERNS for x in re.findall(p, (text or "").upper())})
        assert text is None or got[i] == (",".join(order_ids(text)), ",".join(styles)), text
    assert got[0] == ("123456,2023621", "2023621,CCSS230021") and got[1][0] == "310052" and got[3][0] == "654321"


def test_terms(spark, given):
    got = {r.doc_id: r.terms for r in catalogue.QUERIES["candidate_terms_all"](spark, given[0]).collect()}
    wanted = {i: terms(x) for i, x in given[1].items() if x is not None}
    assert {i: got[i] for i in wanted} == {i: len(x) for i, x in wanted.items()} and len(got) == len(given[1])
    counts = Counter(x for found in wanted.values() for x in found)
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:20]
    assert [(r.term, r.docs) for r in queries.QUERIES["term_frequency_all"](spark, given[0]).collect()] == top
    assert "面料" in wanted[5] and "fabric" in wanted[4] and got[4] == len(terms(TEXTS[4]))


def test_controls(spark, given):
    got = {r.doc_id: r.clean for r in catalogue.QUERIES["control_characters_all"](spark, given[0]).collect()}
    assert got == {i: None if x is None else not re.search("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", x) for i, x in given[1].items()}
    assert not got[5] and not got[6] and got[10]
