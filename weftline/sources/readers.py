"""Readers of the domain's inputs. Schemas are fixed; broken records become error rows, not failures."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator
from email.header import decode_header, make_header

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_html, html_tables

EVENT_SCHEMA = "style_id string, order_id string, category string, event_type string, date string, related_date string, delay_days int, party_from string, party_to string, description string, confidence double, source_filename string, source_subject string"
ORGANIZATION_SCHEMA = "departments array<struct<id:string,name:string,manager:string>>, users array<struct<id:string,name:string,email:string,department:string,role:string,reports_to:string,type:string>>, style_assignments array<struct<style_id:string,primary_owner:string,secondary_owners:array<string>,watchers:array<string>,assigned_date:string>>"
SUMMARY_SCHEMA = "company_people map<string,struct<members:array<struct<email:string,name:string>>>>, top_senders map<string,struct<style_list:array<string>>>, top_recipients map<string,struct<style_list:array<string>>>"
MAIL_SCHEMA = "path string, plain string, html string, subject string, sender string, date string, error string"
CHARSETS = ("utf-8", "gb18030", "big5", "latin-1")


def decoded_header(raw: str | None) -> str:
    try:
        return str(make_header(decode_header(raw or "")))
    except (LookupError, UnicodeError, ValueError):
        return raw or ""


def _text(part) -> str:
    data = part.get_payload(decode=True) or b""
    for charset in (part.get_content_charset(), *CHARSETS):
        try:
            return data.decode(charset) if charset else data.decode("utf-8")
        except (LookupError, UnicodeError):
            continue
    return data.decode("utf-8", "ignore")


def parse_mail(content: bytes) -> dict:
    plain, html = [], []
    message = email.message_from_bytes(content, policy=email.policy.compat32)
    for part in message.walk():
        if part.is_multipart() or "attachment" in str(part.get("Content-Disposition") or ""):
            continue
        {"text/plain": plain, "text/html": html}.get(part.get_content_type(), []).append(_text(part))
    return {"plain": "\n".join(plain), "html": "\n".join(html), "subject": decoded_header(message.get("Subject")), "sender": decoded_header(message.get("From")), "date": str(message.get("Date") or ""), "error": None}


def read_mails(spark: SparkSession, folder: str, head_bytes: int | None = None) -> DataFrame:
    """A row a mail file, in order of path; head_bytes parses just that much of each. Parsing errors are in `error`."""
    return parse_mails(spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(folder), head_bytes)


def parse_mails(files: DataFrame, head_bytes: int | None = None) -> DataFrame:
    """read_mails() of files(path, content), wherever they come from."""
    files = files.select("path", F.col("content") if head_bytes is None else F.substring("content", 1, head_bytes).alias("content"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append({"path": path} | parse_mail(bytes(content)))
                except Exception as e:  # noqa: BLE001  a broken mail is a row that says so
                    rows.append({"path": path, "error": repr(e)})
            yield pd.DataFrame(rows, columns=["path", "plain", "html", "subject", "sender", "date", "error"])

    mails = files.mapInPandas(run, MAIL_SCHEMA)
    return mails.withColumn("content", F.when(F.trim("plain") != "", F.col("plain")).otherwise(clean_html(F.col("html"), full=True)))


def mail_details(mails: DataFrame, keyword: str | None = None) -> DataFrame:
    """(path, subject, sender, date, found, tables) of parsed mails: the tables of their HTML that have the keyword, in
    either case, in their cells (all, if there is none), and how many tables there are."""
    every = html_tables(F.coalesce("html", F.lit("")))
    cells = lambda table: F.lower(F.array_join(F.flatten(table), " "))
    shown = every if keyword is None else F.filter(every, lambda t: cells(t).contains(keyword.lower()))
    return mails.select("path", "subject", "sender", "date", F.size(every).alias("found"), shown.alias("tables"))


def find_file(files: DataFrame, name: str) -> DataFrame:
    """The file of that name, else the first that begins with it."""
    base = F.element_at(F.split("path", "/"), -1)
    return files.where(base.startswith(name)).orderBy((base != name), base).limit(1)


def read_events(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Events of one JSON array, or of files of an event a line."""
    return spark.read.schema(EVENT_SCHEMA).option("multiLine", not lines).json(path)


def with_defaults(events: DataFrame) -> DataFrame:
    """Events with what is missing filled in: texts with the empty one, confidence with 0."""
    return events.fillna("", [f.name for f in events.schema if f.dataType.typeName() == "string"]).fillna(0.0, ["confidence"])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that are no JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_factories(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed columns; rows without a style or a factory name are left out."""
    rows = spark.read.csv(path, header=True)
    rows = rows.select(*[F.trim(c).alias(c.lstrip("﻿")) for c in rows.columns])
    return rows.where((F.coalesce("style_id", F.lit("")) != "") & (F.coalesce("factory_name", F.lit("")) != ""))


def _parsed(spark: SparkSession, path: str, schema: str, lines: bool, kept: str | None) -> DataFrame:
    """JSON documents; with `kept`, a new folder, they are parsed once, whatever is then made of them."""
    docs = spark.read.schema(schema).option("multiLine", not lines).json(path)
    if kept is None:
        return docs
    docs.write.parquet(kept)
    return spark.read.parquet(kept)


def _entries(docs: DataFrame, array: str) -> DataFrame:
    """The entries of an array, with their place in it as `seq`."""
    return docs.select(F.posexplode(array).alias("seq", "v")).select("v.*", "seq")


def read_organization(spark: SparkSession, path: str, lines: bool = False, kept: str | None = None) -> dict[str, DataFrame]:
    """The chart's three arrays as tables, entries in their order (seq). With `lines` every line is a chart, or a part of
    one, so that a large one is read in parallel; entries of different lines have no order. `kept`: a folder that what was
    parsed is stored in, for charts that are read more than once."""
    org = _parsed(spark, path, ORGANIZATION_SCHEMA, lines, kept)
    return {k: _entries(org, k) for k in ("departments", "users", "style_assignments")}


def read_summary(spark: SparkSession, path: str, lines: bool = False, kept: str | None = None) -> dict[str, DataFrame]:
    """Members by company, in their order (seq), and the styles that each address sent or received mail about; `lines` and
    `kept` as for read_organization."""
    raw = _parsed(spark, path, SUMMARY_SCHEMA, lines, kept)
    people = raw.select(F.explode("company_people").alias("company", "v")).select("company", F.posexplode("v.members").alias("seq", "m")).select("company", "m.*", "seq")
    styles = raw.select(F.explode("top_senders").alias("email", "v")).unionByName(raw.select(F.explode("top_recipients").alias("email", "v")))
    return {"people": people, "styles": styles.select(F.lower("email").alias("email"), F.explode("v.style_list").alias("style_id")).repartition("email").distinct()}
