"""Scalar text functions as column expressions: they stay inside generated code and push through to scans."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


#: White space of any kind, inside a class, and telephone numbers; both engines read them alike.
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_PREFIX = rf"(?:\+?86[-{SPACE}]?)?"
PHONE = rf"{_PREFIX}1[3-9]\p{{Nd}}{{9}}|{_PREFIX}\p{{Nd}}{{3,4}}[-{SPACE}]?\p{{Nd}}{{7,8}}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def any_of(c: Column, words: list[str]) -> Column:
    """Plain containment of any word."""
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def first_group(c: Column, groups: dict[str, list[str]], pattern: bool = False) -> Column:
    """The first key one of whose words (or patterns) occurs."""
    tests = [(k, F.lower(c).rlike("(?i)" + "|".join(v)) if pattern else any_of(F.lower(c), v)) for k, v in groups.items()]
    return F.coalesce(*[F.when(t, F.lit(k)) for k, t in tests])


def clean_html(c: Column, full: bool = False) -> Column:
    """Drops scripts, styles and tags, resolves the commonest entities, collapses white space. What `&amp;` leaves is not
    resolved again, but for the entities that come after it in the full list."""
    c = F.regexp_replace(c, r"(?is)<script[^>]*>[^<]*</script>|<style[^>]*>[^<]*</style>", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for name, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), *((("&quot;", '"'), ("&apos;", "'"), ("&#160;", " "), ("&#10;", " "), ("&#13;", " ")) if full else ())):
        c = F.replace(c, F.lit(name), F.lit(to))
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def mask_pii(c: Column) -> Column:
    """E-mail addresses, then telephone numbers with or without the country's prefix, as placeholders."""
    c = F.regexp_replace(c, r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]")
    return F.regexp_replace(c, PHONE, "[PHONE]")


def _all(c: Column, patterns: list[str], flags: str) -> Column:
    found = [F.regexp_extract_all(c, F.lit(f"{flags}({p})"), F.lit(1)) for p in patterns]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def style_ids(c: Column, full: bool = False) -> Column:
    return F.transform(_all(F.upper(c), [*L.STYLE_PATTERNS, *([L.P_SERIES] if full else [])], "(?U)"), F.upper)


def order_ids(c: Column) -> Column:
    """Numbers of 6 to 9 digits, dates of six digits left out."""
    ids = _all(c, [rf"\b[0-9]{{{n}}}\b" for n in (6, 7, 8, 9)], "(?U)")
    return F.filter(ids, lambda x: ~((F.length(x) == 6) & (F.substring(x, 1, 2).cast("int") <= 12) & (F.substring(x, 3, 2).cast("int") <= 31)))


def normalize_subject(c: Column) -> Column:
    """One reply or forward prefix removed, no more."""
    return strip(F.regexp_replace(c, L.REPLY_PREFIX, ""))


def classify_category(text: Column) -> Column:
    """The category most of whose keywords occur; of equal ones the first; none: the rest category."""
    t = F.lower(text)
    scores = F.array(*[F.struct(reduce(lambda a, b: a + b, [t.contains(w).cast("int") for w in ws]).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, ws) in enumerate(L.CATEGORY_KEYWORDS.items())])
    best = F.array_max(scores)
    return F.when(best["n"] > 0, best["k"]).otherwise(L.OTHER)


def blacklisted(subject: Column, sender: Column) -> Column:
    """The first pattern that matches, as the reason; null if none does."""
    return F.coalesce(*[F.when(subject.rlike(f"(?iU){p}"), F.lit(f"subject:{p}")) for p in L.SUBJECT_BLACKLIST], *[F.when(sender.rlike(f"(?i){p}"), F.lit(f"sender:{p}")) for p in L.SENDER_BLACKLIST])


def has_business_keyword(c: Column) -> Column:
    return F.substring(c, 1, 300).rlike("(?i)" + "|".join(map(re.escape, L.BUSINESS_KEYWORDS)))


def gate_status(length: Column, protected: Column, system: Column, least: int = 200) -> Column:
    return F.when(protected, F.when(length < 50, "too_short").otherwise("passed")).when(length < F.when(system, 300).otherwise(least), "too_short").otherwise("passed")


def coerce_enum(c: Column, values: list[str]) -> Column:
    """An exact value, else the first that contains it or is contained, else the rest category; empty counts as none."""
    options = F.array(*map(F.lit, values))
    near = F.filter(options, lambda v: F.lower(v).contains(F.lower(c)) | F.lower(c).contains(F.lower(v)))
    return F.when(F.coalesce(c, F.lit("")) == "", L.OTHER).when(c.isin(values), c).otherwise(F.coalesce(F.get(near, F.lit(0)), F.lit(L.OTHER)))


def backfill_id(c: Column, ids: Column) -> Column:
    return F.when(F.coalesce(F.upper(c), F.lit("")).isin("", "UNKNOWN", "NONE") & (F.size(ids) == 1), F.get(ids, F.lit(0))).otherwise(c)


def confidence(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double"), F.lit(0.5))))


def iso_date_or_blank(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c).otherwise("")


def parse_date(c: Column) -> Column:
    """Header dates of six formats, else a year-month-day anywhere; null if there is none."""
    formats = ("EEE, d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd")
    tried = [F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in formats[2:]]
    part = lambda n: F.regexp_extract(c, r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", n)
    found = F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))
    months = "JanFebMarAprMayJunJulAugSepOctNovDec"
    dmy = lambda n: F.regexp_extract(c, r"(\d{1,2}) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (\d{4})", n)
    header = F.try_to_date(F.concat_ws("-", dmy(3), F.lpad(((F.position(dmy(2), F.lit(months)) + 2) / 3).cast("int").cast("string"), 2, "0"), F.lpad(dmy(1), 2, "0")))
    return F.date_format(F.coalesce(F.when(dmy(1) != "", header), *tried, F.when(part(1) != "", found)), "yyyy-MM-dd")


def person_name(c: Column, variants: dict[str, str] | None = None) -> Column:
    """Trimmed, in title case after any character that is no letter, variants unified; role words and blanks are null."""
    low = F.lower(strip(c))
    letters = F.split(low, "")
    titled = F.aggregate(letters, F.struct(F.lit("").alias("s"), F.lit(False).alias("in_word")), lambda a, x: F.struct(F.concat(a["s"], F.when(a["in_word"], x).otherwise(F.upper(x))).alias("s"), x.rlike(r"\p{L}").alias("in_word")), lambda a: a["s"])
    for old, new in (variants or {}).items():
        titled = F.when(titled == old, new).otherwise(titled)
    return F.when((low != "") & ~strip(c).isin(L.ROLE_WORDS), titled)


def half_width(c: Column) -> Column:
    return F.translate(c, "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　", "".join(chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F)) + " ")


def slug(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\w]", "_")


def event_document(fields: dict[str, Column]) -> Column:
    """Labelled fields joined by bars; empty ones and the unknown party are left out."""
    return F.concat_ws(" | ", *[F.when(F.coalesce(c.cast("string"), F.lit("")).isin("", L.UNKNOWN_PARTY), None).otherwise(F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in fields.items()])


def potential_terms(c: Column) -> Column:
    found = F.array_union(F.regexp_extract_all(c, F.lit("([一-龥]{2,10})"), F.lit(1)), F.regexp_extract_all(c, F.lit(r"(?U)\b([a-zA-Z][a-zA-Z\-]{2,20})\b"), F.lit(1)))
    return F.array_except(found, F.array(*map(F.lit, L.TERM_STOPWORDS)))


def is_continuation(c: Column) -> Column:
    t = strip(F.lower(c))
    return any_of(t, L.CONTINUATION) | t.isin(L.CONTINUATION_ALONE)


def event_focus(c: Column) -> Column:
    return first_group(c, L.EVENT_FOCUS, pattern=True)


def first_style_id(c: Column) -> Column:
    """By the order of patterns, not of places."""
    ordered = [p for p in L.STYLE_PATTERNS if p != L.STYLE_PATTERNS[3]]
    return F.coalesce(*[F.nullif(F.regexp_extract(F.upper(c), f"(?U)({p})", 1), F.lit("")) for p in [*ordered[:-1], L.P_SERIES, ordered[-1]]])


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]", "")


def json_block(c: Column) -> Column:
    """The JSON of a reply: in a fence, else from the first brace to the last."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit("")), F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit("")))


def estimate_tokens(c: Column) -> Column:
    """Han characters, words that have a letter, and half the other characters (rounded down, may be negative)."""
    c = F.coalesce(c, F.lit(""))
    han = F.length(c) - F.length(F.regexp_replace(c, "[一-鿿]", ""))
    lettered = F.filter(F.split(c, r"\s+"), lambda w: w.rlike(r"\p{L}"))
    inside = F.aggregate(lettered, F.lit(0), lambda a, w: a + F.length(w))
    return (han + F.size(lettered) + F.floor((F.length(c) - han - inside) / 2)).cast("long")


def message_tokens(role: Column, content: Column) -> Column:
    return estimate_tokens(role) + estimate_tokens(content) + 20


def overflow_status(used: Column, limit: int) -> Column:
    return F.when(used >= limit, "overflow").when(used >= 0.8 * limit, "warning").otherwise("ok")


def dates_in(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([0-9]{4}[-/][0-9]{2}[-/][0-9]{2})"), F.lit(1))


def title_of(c: Column) -> Column:
    return F.when(F.length(c) > 20, F.concat(F.left(c, F.lit(20)), F.lit("..."))).otherwise(c)


def local_part(c: Column) -> Column:
    return F.split_part(c, F.lit("@"), F.lit(1))


def html_tables(c: Column) -> Column:
    """Tables as arrays of rows of cells; empty cells and rows dropped, tables of fewer than two rows too."""
    def inner(x: Column, tag: str) -> Column:
        return F.regexp_extract_all(x, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    cells = lambda row: F.filter(F.transform(inner(row, "t[dh]"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"\s+", " "))), lambda x: x != "")
    rows = lambda table: F.filter(F.transform(inner(table, "tr"), cells), lambda r: F.size(r) > 0)
    return F.filter(F.transform(inner(c, "table"), rows), lambda t: F.size(t) >= 2)


def remove_noise(c: Column) -> Column:
    """Forwarded headers and signatures dropped, line by line.

    A forward marker opens a header part, which the next line that is not `word:` closes; a signature marker opens a
    signature, which a blank line closes, itself dropped. Every line is told by a letter, forward marker first: F, S, B
    (blank), H (`word:`) or X; on the text of these letters the parts are two patterns, whatever lines say.
    """
    mark = lambda ps: "(?iU)" + "|".join(ps)
    letter = lambda x: F.when(x.rlike(mark(L.FORWARD_MARKERS)), "F").when(x.rlike(mark(L.SIGNATURE_MARKERS)), "S").when(strip(x) == "", "B").when(x.rlike(r"(?U)^\s*\w+[:\s]"), "H").otherwise("X")
    lines = F.split(c, "\n")
    letters = F.array_join(F.transform(lines, letter), "")
    forwarded = F.regexp_replace(letters, r"F|\G(?<!^)[^X]", "-")
    signed = F.regexp_replace(letters, r"S|\G(?<!^)(?<!B).", "-")
    shown = F.zip_with(F.split(forwarded, ""), F.split(signed, ""), lambda x, y: (x != "-") & (y != "-"))
    told = F.filter(F.arrays_zip(lines.alias("line"), shown.alias("shown")), lambda x: x["shown"])
    kept = F.array_join(F.transform(told, lambda x: x["line"]), "\n")
    kept = F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"(?i)\[IMAGE\d+\]", ""), r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    return strip(kept)


def party_or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(L.UNKNOWN_PARTY))


def day_label(at: Column, now: Column) -> Column:
    """Today, yesterday, the day before, or the day and minute of earlier (and later) times."""
    days = F.datediff(F.to_date(now), F.to_date(at))
    moment = F.concat(F.month(at), F.lit("月"), F.day(at), F.lit("日 "), F.hour(at), F.lit(":"), F.lpad(F.minute(at).cast("string"), 2, "0"))
    return F.when(days == 0, "今天").when(days == 1, "昨天").when(days == 2, "前天").otherwise(moment)


def loose_style_id(c: Column) -> Column:
    """The first match of the looser patterns, by the order of patterns; null if none matches."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.upper(c), f"(?U)({p})", 1), F.lit("")) for p in L.LOOSE_STYLE_PATTERNS])
