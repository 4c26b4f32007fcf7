import json

from weftline.sources import readers as S


def test_mails(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes("Subject: =?utf-8?b?6Z2i5paZ?=\nFrom: x@y\nDate: d\nContent-Type: text/plain; charset=gb18030\n\n".encode() + "面料确认".encode("gb18030"))
    (tmp_path / "b.eml").write_bytes(b"Subject: h\nContent-Type: text/html\n\n<p>hi&nbsp;there</p>")
    rows = {r.path.rsplit("/", 1)[1]: r for r in S.read_mails(spark, str(tmp_path)).collect()}
    assert rows["a.eml"].subject == "面料" and rows["a.eml"].content == "面料确认"
    assert rows["b.eml"].content == "hi there" and rows["b.eml"].error is None


def test_json_csv(spark, tmp_path):
    (tmp_path / "org.json").write_text(json.dumps({"departments": [{"id": "d", "name": "D", "manager": "m"}], "users": [], "style_assignments": [{"style_id": "s", "primary_owner": "u", "secondary_owners": ["v"]}]}))
    org = S.read_organization(spark, str(tmp_path / "org.json"))
    assert org["departments"].count() == 1 and org["users"].count() == 0 and org["style_assignments"].first().secondary_owners == ["v"]
    (tmp_path / "f.csv").write_bytes("﻿style_id,factory_name\nS1, F1 \n,F2\nS2,\n".encode())
    assert [tuple(r) for r in S.read_factories(spark, str(tmp_path / "f.csv")).collect()] == [("S1", "F1")]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert S.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2
    (tmp_path / "s.json").write_text(json.dumps({"company_people": {"C": {"members": [{"email": "E@x", "name": "N"}]}}, "top_senders": {"E@x": {"style_list": ["S1", "S2"]}}, "top_recipients": {"e@X": {"style_list": ["S2"]}}}))
    summary = S.read_summary(spark, str(tmp_path / "s.json"))
    assert summary["styles"].count() == 2 and summary["people"].first().email == "E@x"
