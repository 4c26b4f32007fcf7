"""Queries over readers, writers and single fields, their inputs made from the given tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import shaping as O
from ..operators import terms as T
from ..sources import readers, writers
from ..streaming.pointer import shared_folder
from .asked import query
from .domain import BOUND, CTE, bounded


@query("SELECT CAST(doc_id AS VARCHAR) AS path, 'Doc ' || doc_id || ' of ' || source AS subject, source || '@x' AS sender, 'day ' || doc_id AS date, CASE WHEN doc_id % 3 <> 0 THEN md5(text) ELSE md5('') END AS plain_md5, CASE WHEN doc_id % 3 = 0 THEN md5('<p>' || text || '</p>') ELSE md5('') END AS html_md5 FROM documents")
def mails_parsed(e, t):
    """Mails made of all documents, plain ones and HTML, one in five with an encoded subject, parsed."""
    d = t("documents")
    title = F.concat(F.lit("Doc "), "doc_id", F.lit(" of "), "source")
    subject = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("=?utf-8?b?"), F.base64(title.cast("binary")), F.lit("?="))).otherwise(title)
    html = F.col("doc_id") % 3 == 0
    kind = F.when(html, "text/html").otherwise("text/plain")
    body = F.when(html, F.concat(F.lit("<p>"), "text", F.lit("</p>"))).otherwise(F.col("text"))
    mail = F.concat(F.lit("Subject: "), subject, F.lit("\nFrom: "), "source", F.lit("@x\nDate: day "), "doc_id", F.lit("\nContent-Type: "), kind, F.lit("; charset=utf-8\n\n"), body)
    parsed = readers.parse_mails(d.select(F.col("doc_id").cast("string").alias("path"), mail.cast("binary").alias("content")))
    return parsed.select("path", "subject", "sender", "date", F.md5(F.col("plain").cast("binary")).alias("plain_md5"), F.md5(F.col("html").cast("binary")).alias("html_md5"))


@query(f"{CTE} SELECT category, count(*) AS n, count(*) FILTER (order_id % 4 = 0) AS no_party, CAST(sum(delay_days) FILTER (order_id % 3 <> 0) AS BIGINT) AS delay_days, min(date) AS first_date FROM ev GROUP BY 1")
def events_read(e, t):
    """Events written as lines of JSON and read again, what is missing filled in."""
    at = f"{shared_folder(e.spark)}/events"
    k = F.col("order_id")
    rows = e.events.select(F.col("style_id").cast("string"), k.cast("string").alias("order_id"), "category", "event_type", "date", F.when(k % 3 != 0, F.col("delay_days")).alias("delay_days"), F.when(k % 4 != 0, F.col("party_from")).alias("party_from"))
    rows.write.json(at)
    found = readers.with_defaults(readers.read_events(e.spark, at, lines=True))
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("party_from") == "").alias("no_party"), F.sum("delay_days").alias("delay_days"), F.min("date").alias("first_date"))


@query("SELECT k, path FROM (SELECT 'exact' AS k, '/in/' || max(doc_id) || '.eml' AS path FROM documents UNION ALL SELECT 'prefix', '/in/' || min(CAST(doc_id AS VARCHAR) || '.eml') || '' FROM documents WHERE starts_with(CAST(doc_id AS VARCHAR), '1'))")
def files_found(e, t):
    """The file of a name, and the first one that begins with another."""
    files = t("documents").select(F.concat(F.lit("/in/"), "doc_id", F.lit(".eml")).alias("path"))
    last = t("documents").agg(F.max("doc_id").alias("m")).first().m
    pick = lambda k, name: readers.find_file(files, name).select(F.lit(k).alias("k"), "path")
    return pick("exact", f"{last}.eml").unionByName(pick("prefix", "1"))


@query("SELECT o_orderkey AS order_id, strftime(o_orderdate, '%Y-%m-%d') AS parsed, CASE WHEN o_orderkey % 6 = 3 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS guarded FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, NULL, '' FROM orders WHERE o_orderkey % 7 = 0")
def dates_parsed(e, t):
    """Dates in six forms, and texts without one, as one form; and the guard that lets only that form pass."""
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    as_ = lambda f: F.date_format(d, f)
    forms = [as_("EEE, d MMM yyyy"), as_("d MMM yyyy"), F.concat(as_("yyyy-MM-dd"), F.lit(" 10:11:12")), as_("yyyy-MM-dd"), F.concat(F.lit("on "), as_("yyyy/M/d"), F.lit(" we")), as_("yyyy/MM/dd")]
    tail = F.when(k % 6 < 2, " 23:59:01 +0800").otherwise("")
    raw = F.when(k % 7 == 0, F.concat(F.lit("order "), k.cast("string"))).otherwise(F.concat(F.get(F.array(*forms), (k % 6).cast("int")), tail))
    return t("orders").select(k.alias("order_id"), X.parse_date(raw).alias("parsed"), F.coalesce(X.iso_date_or_blank(raw), F.lit("")).alias("guarded"))


_NEAR = "list_filter(" + str(L.CATEGORIES) + ", lambda v: contains(lower(v), lower(raw)) OR contains(lower(raw), lower(v)))"
_RAW = f"CASE p_partkey % 4 WHEN 0 THEN {L.CATEGORIES}[p_partkey % {len(L.CATEGORIES)} + 1] WHEN 1 THEN {L.CATEGORIES}[p_partkey % {len(L.CATEGORIES)} + 1] || '的' WHEN 2 THEN p_type ELSE '' END"


@query(f"""WITH p AS (SELECT *, {_RAW} AS raw, CASE p_partkey % 5 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN '' WHEN 2 THEN 'none' ELSE 'S' || p_partkey END AS sid FROM part)
SELECT p_partkey AS part_id, CASE WHEN raw = '' THEN '{L.OTHER}' WHEN list_contains({L.CATEGORIES}, raw) THEN raw ELSE coalesce({_NEAR}[1], '{L.OTHER}') END AS category,
  CASE WHEN upper(sid) IN ('UNKNOWN', '', 'NONE') AND p_partkey % 3 = 0 THEN p_brand ELSE sid END AS style_id, greatest(0.0, least(1.0, CASE WHEN p_partkey % 6 = 5 THEN 0.5 ELSE (p_size - 10) / 20.0::DOUBLE END)) AS confidence,
  regexp_replace(p_name || ' é面', '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]', '_', 'g') AS slug, p_name || ' 1!' AS narrow, 'CN: ' || p_name || ' EN: ' || p_type || ' CAT: ' || p_brand AS document, lower(p_brand) AS mailbox FROM p""")
def fields_cleaned(e, t):
    """Fields of all parts made valid: categories, ids, confidence, slugs, widths, documents of terms, mail boxes."""
    k, n = F.col("p_partkey"), len(L.CATEGORIES)
    some = F.get(F.array(*map(F.lit, L.CATEGORIES)), (k % n).cast("int"))
    raw = F.when(k % 4 == 0, some).when(k % 4 == 1, F.concat(some, F.lit("的"))).when(k % 4 == 2, F.col("p_type")).otherwise("")
    sid = F.when(k % 5 == 0, "UNKNOWN").when(k % 5 == 1, "").when(k % 5 == 2, "none").otherwise(F.concat(F.lit("S"), k.cast("string")))
    ids = F.when(k % 3 == 0, F.array("p_brand")).otherwise(F.array("p_brand", "p_name"))
    sure = F.when(k % 6 == 5, "much").otherwise(((F.col("p_size") - 10) / F.lit(20.0)).cast("string"))
    narrow, wide = "".join(map(chr, range(0x21, 0x7F))) + " ", "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
    return t("part").select(
        k.alias("part_id"), X.coerce_enum(raw, L.CATEGORIES).alias("category"), X.backfill_id(sid, ids).alias("style_id"), X.confidence(sure).alias("confidence"), X.slug(F.concat("p_name", F.lit(" é面"))).alias("slug"),
        X.half_width(F.translate(F.concat("p_name", F.lit(" 1!")), narrow, wide)).alias("narrow"), T.term_document(F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("document"), X.local_part(F.concat(F.lower("p_brand"), F.lit("@x.y"))).alias("mailbox"),
    )


_LOOSE = ", ".join(f"nullif(regexp_extract(m, '({p})', 1), '')" if not p.startswith(r"\b") else f"nullif(regexp_extract(m, '{BOUND}({p[2:-2]}){BOUND}', 1), '')" for p in (p.replace("-", BOUND + "-" + BOUND).replace(f"[A{BOUND}-{BOUND}Z]", "[A-Z]") for p in L.LOOSE_STYLE_PATTERNS))


@query(f"WITH d AS (SELECT doc_id, {bounded('upper(text)')} AS m FROM documents) SELECT doc_id, replace(coalesce({_LOOSE}), '{BOUND}', '') AS style_id FROM d")
def loose_ids(e, t):
    """The first id by the looser patterns in every document."""
    return t("documents").select("doc_id", X.loose_style_id(F.col("text")).alias("style_id"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '{"n": ' || length(text) || '}' WHEN 1 THEN '{"turn": {"n": ' || turn || '}}' END AS block FROM conversations""")
def json_blocks(e, t):
    """The JSON inside replies: fenced, between other words, or none."""
    k, text = F.col("turn") % 3, F.translate("text", "{}`", "")
    fenced = F.concat(text, F.lit('\n```json\n{"n": '), F.length("text"), F.lit("}\n```\n"), text)
    reply = F.when(k == 0, fenced).when(k == 1, F.concat(text, F.lit(' {"turn": {"n": '), "turn", F.lit("}} "), text)).otherwise(text)
    return t("conversations").select("conv_id", "turn", X.json_block(reply).alias("block"))


_STEPS = sorted(O.LADDER, reverse=True)


@query(f"""{CTE}, r AS (SELECT ev.factory_id, style_id, order_id, line, date, 4 + delay_days % 7 AS tokens, row_number() OVER (PARTITION BY ev.factory_id ORDER BY date DESC, order_id, line, style_id) AS rn FROM ev),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY factory_id ORDER BY rn) AS so_far FROM r),
s AS (SELECT factory_id, coalesce({", ".join(f"CASE WHEN max(so_far) FILTER (rn <= {n}) <= factory_id % 12 * 60 THEN {n} END" for n in _STEPS)}) AS step FROM c GROUP BY 1)
SELECT c.factory_id, order_id, line, style_id, step FROM c JOIN s ON s.factory_id = c.factory_id AND rn <= step""")
def results_shrunk(e, t):
    """Each factory's newest events, cut step by step until their tokens are within its budget."""
    rows = e.events.select("factory_id", "style_id", "order_id", "line", "date", (4 + F.col("delay_days") % 7).alias("tokens"), (F.col("factory_id") % 12 * 60).alias("room"))
    return O.shrink_to_budget(rows, "factory_id", [F.col("date").desc(), "order_id", "line", "style_id"], F.col("tokens"), F.col("room")).select("factory_id", "order_id", "line", "style_id", F.col("step").cast("long").alias("step"))


@query("SELECT l.doc_id, l.quality, l.toxic, d.n, d.good FROM labels l, (SELECT count(*) AS n, count(*) FILTER (quality = 1) AS good FROM labels) d")
def evaluation_written(e, t):
    """Cases and figures of an evaluation, written and read again."""
    at = f"{shared_folder(e.spark)}/evaluation"
    writers.write_evaluation(t("labels").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good")), t("labels"), at)
    summary = e.spark.read.schema("n long, good long").json(f"{at}/summary")
    return e.spark.read.schema("doc_id long, quality int, toxic int").json(f"{at}/details").join(F.broadcast(summary), F.lit(True))


#: What is put after the sentences of every second, third ... conversation turn: signatures, headers, blanks, in any order.
_PUT = ["\nBest regards,\nBob\nTel: 1\n\nback to it\n", "\n发件人: a\nTo: b\nword: x\nbody [image12]\n--\nsig\t  ture\n", "\n--\nFrom: me\nnot a header\n\nOriginal\n", "\n\n\n\nSent: now\n\nCc: x\nthanks\nThanks,\n"]
_PUT_SQL = "[" + ", ".join(f"E{x!r}" for x in _PUT) + "]"
_ANY = lambda ps: "(?i)" + "|".join(ps)


@query(rf"""WITH c AS (SELECT conv_id, turn, string_split(replace(text, '. ', {_PUT_SQL}[turn % 4 + 1]), chr(10)) AS lines FROM conversations
), l AS (SELECT conv_id, turn, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM c
), k AS (
  SELECT *, CASE WHEN regexp_matches(line, '{_ANY(L.FORWARD_MARKERS)}') THEN 'F' WHEN regexp_matches(line, '{_ANY(L.SIGNATURE_MARKERS)}') THEN 'S' WHEN trim(line, ' ' || chr(9) || chr(13)) = '' THEN 'B' WHEN regexp_matches(line, '^\s*[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+[:\s]') THEN 'H' ELSE 'X' END AS kind FROM l
), o AS (
  SELECT *, max(CASE WHEN kind = 'F' THEN n ELSE -1 END) OVER w AS f, max(CASE WHEN kind = 'X' THEN n ELSE -1 END) OVER w AS x, max(CASE WHEN kind = 'S' THEN n ELSE -1 END) OVER p AS s, max(CASE WHEN kind = 'B' THEN n ELSE -1 END) OVER p AS b
  FROM k WINDOW w AS (PARTITION BY conv_id, turn ORDER BY n), p AS (PARTITION BY conv_id, turn ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (SELECT conv_id, turn, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT coalesce(f > x, false) AND kind <> 'S' AND NOT coalesce(s > b, false)), '') AS kept FROM o GROUP BY 1, 2)
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(kept, '(?i)\[IMAGE\d+\]', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS clean FROM t""")
def noise_removed_text(e, t):
    """Conversation turns with signatures and forwarded headers between their sentences, freed of them."""
    put = F.get(F.array(*map(F.lit, _PUT)), (F.col("turn") % 4).cast("int"))
    return t("conversations").select("conv_id", "turn", X.remove_noise(F.replace("text", F.lit(". "), put)).alias("clean"))


_HTML_TABLES = r"""WITH cells AS (SELECT page_id, html, list_filter(list_transform(regexp_extract_all(html, '(?is)<table[^>]*>(.*?)</table>', 1), lambda tb: list_filter(list_transform(regexp_extract_all(tb, '(?is)<tr[^>]*>(.*?)</tr>', 1), lambda r: list_filter(list_transform(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: trim(regexp_replace(regexp_replace(c, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))), lambda c: c <> '')), lambda r: len(r) > 0)), lambda tb: len(tb) >= 2) AS ts FROM pages)"""


@query(rf"{_HTML_TABLES} SELECT 'Page ' || page_id AS subject, 'p' || page_id || '@x' AS sender, 'day' AS date, CAST(len(ts) AS BIGINT) AS tables, CAST(len(list_filter(ts, lambda tb: contains(lower(array_to_string(list_transform(tb, lambda r: array_to_string(r, ' ')), ' ')), '1'))) AS BIGINT) AS with_keyword FROM cells")
def mail_details(e, t):
    """Headers of mails made of all pages, their tables, and those of them that have a keyword."""
    mail = F.concat(F.lit("Subject: Page "), "page_id", F.lit("\nFrom: p"), "page_id", F.lit("@x\nDate: day\nContent-Type: text/html; charset=utf-8\n\n"), "html")
    found = readers.mail_details(readers.parse_mails(t("pages").select(F.col("page_id").cast("string").alias("path"), mail.cast("binary").alias("content"))), "1")
    return found.select("subject", "sender", "date", F.col("found").cast("long").alias("tables"), F.size("tables").cast("long").alias("with_keyword"))
