"""Term entries from page layouts: characters to lines, lines to pairs of terms, terms to a clean dictionary.

A page comes as characters(page, x0, y0, text), y growing upwards. A page's characters are bounded by the page, so a
(page, column) group is small however many pages there are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import half_width, strip

#: Where columns part, how near characters of a line are, page ranges by layout, word stems, what is no term.
SPLIT_X, NEAR_Y = 195, 2.0
LAYOUTS = {"pairs": ((16, 163), (402, 435)), "entries": ((166, 399),)}
STEMS = "clothes dress wear coat jacket shirt skirt suit pants garment apparel trousers blouse vest shorts jeans clothing robe gown uniform costume".split()
NO_TERMS = ["图书在版编目", "中国版本图书馆", "前言", "目录", "凡购本书", "服装分类词汇", "汉英英汉服装分类词汇", "语词目为中心", "所有物种均被列入", "濒危野生动植物种国际贸易公约", "名录", "英汉服装词汇", "主编", "副主编", "参编", "中国纺织出版社", "内容提要", "版权", "ISBN", "CIP"]
NO_CATEGORY, ENGLISH_CATEGORY, HYPHEN = "未分类", "英汉词汇", "⁃"
_HAN, _WIDE = r"[一-鿿]", "[ａ-ｚＡ-Ｚ]"
_PHONETIC = "ˈˌæəɒɔːʊʌɜŋʃɪʒɛɑ"


def layout(page: Column) -> Column:
    """pairs (a Han line above its English ones), entries (English first) or null (skipped)."""
    return F.coalesce(*[F.when(page.between(a, b), name) for name, ranges in LAYOUTS.items() for a, b in ranges])


def lines(chars: DataFrame) -> DataFrame:
    """(page, is_left, line_no, line) from the top down: a character joins a line within NEAR_Y of the mean of its members.

    The running mean makes this sequential inside a page's column, hence a function over that group.
    """

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        members: list[list[tuple]] = []
        total = 0.0
        for y, x, t in frame.sort_values("y0", kind="stable")[["y0", "x0", "text"]].itertuples(index=False):
            if not members or abs(y - total / len(members[-1])) >= NEAR_Y:
                members.append([])
                total = 0.0
            members[-1].append((x, t))
            total += y
        texts = ["".join(t for _, t in sorted(m, key=lambda c: c[0])).strip() for m in reversed(members)]
        return pd.DataFrame({"page": frame["page"].iloc[0], "is_left": frame["is_left"].iloc[0], "line_no": range(len(texts)), "line": texts})

    placed = chars.where(strip(F.col("text")) != "").withColumn("is_left", F.col("x0") < SPLIT_X).select("page", "is_left", "x0", "y0", "text")
    return placed.groupBy("page", "is_left").applyInPandas(gather, "page int, is_left boolean, line_no int, line string")


def page_categories(rows: DataFrame) -> DataFrame:
    """(page, category): the headings among the first lines of the left column, else those of the last page that had some."""
    numerals = "[一二三四五六七八九十]+"
    head = rows.where("is_left AND line_no < 15")
    first = F.nullif(F.regexp_extract("line", rf"^{numerals}、({_HAN}+)$", 1), F.lit(""))
    second = F.nullif(F.regexp_extract("line", rf"^（{numerals}）({_HAN}+)", 1), F.lit(""))
    found = head.groupBy("page").agg(F.max_by(first, F.when(first.isNotNull(), F.col("line_no"))).alias("a"), F.max_by(second, F.when(second.isNotNull(), F.col("line_no"))).alias("b"))
    named = rows.select("page").distinct().join(found, "page", "left").select("page", F.nullif(F.concat_ws("·", "a", "b"), F.lit("")).alias("category"))
    # a book's pages, not a corpus's rows: one window over them is small
    w = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return named.withColumn("category", F.last("category", ignorenulls=True).over(w))


def tidy(c: Column) -> Column:
    """Half width, empty brackets and outer punctuation gone, single spaces."""
    c = F.regexp_replace(half_width(c), r"\(\s*\)|\[\s*\]|〔\s*〕", "")
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?U)^[;:,，、.\s]+|[;:,，、.\s]+$", ""), r"(?U)\s+", " "))


def spaced(c: Column) -> Column:
    """Spaces put back around garment stems and before capitals that follow a small letter."""
    stems = "|".join(STEMS)
    c = F.regexp_replace(c, f"({stems})([A-Z])", "$1 $2")
    return F.regexp_replace(F.regexp_replace(c, f"([a-z])({stems})", "$1 $2"), "([a-z])([A-Z])", "$1 $2")


def _column(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("line_no")


def pairs(rows: DataFrame) -> DataFrame:
    """A Han line and the English line below it, with those that a hyphen at its end leads to."""
    keys = ["page", "is_left"]
    han, wide = F.col("line").rlike(_HAN), F.col("line").rlike(_WIDE)
    useful = rows.where(F.length("line") > 1).where(~F.col("line").rlike("^[０-９]{1,4}$"))
    marked = useful.withColumn("starts", (han & ~wide).cast("int")).withColumn("group", F.sum("starts").over(_column(keys)))
    english = wide & ~han
    # only the first run counts: a line stays while every English line before it in the group ended with a hyphen
    before = Window.partitionBy(*keys, "group").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(F.when((english & ~F.col("line").endswith(HYPHEN)) | (han & wide), 1)).over(before), F.lit(0))
    kept = marked.where("group > 0").withColumn("english", english & (stopped == 0))
    grouped = kept.groupBy(*keys, "group").agg(F.max(F.when(F.col("starts") == 1, F.col("line"))).alias("cn"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("english"), F.struct("line_no", "line")))), lambda x: x["line"]), " ").alias("en"))
    out = grouped.select("page", tidy(F.col("cn")).alias("chinese"), spaced(tidy(F.col("en"))).alias("english"))
    return out.where("length(chinese) >= 2 AND english <> ''").withColumn("phonetic", F.lit(None).cast("string")).withColumn("type", F.lit("汉英"))


def entries(rows: DataFrame) -> DataFrame:
    """An entry starts with a wide letter and holds Han characters; lines without such a start continue it."""
    keys = ["page", "is_left"]
    useful = rows.where(~F.col("line").rlike("^[０-９]{1,4}$") & ~F.col("line").rlike("^[ａ-ｚＡ-Ｚ]{1,2}$"))
    starts = F.col("line").rlike(f"^{_WIDE}") & F.col("line").rlike(_HAN)
    numbered = useful.withColumn("entry", F.sum(starts.cast("int")).over(_column(keys))).where("entry > 0")
    text = numbered.groupBy(*keys, "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("t"))
    head, meaning = strip(F.regexp_extract("t", r"^([^一-鿿]*)", 1)), F.regexp_extract("t", r"(?s)([一-鿿].*)$", 1)
    word = F.regexp_extract(head, r"^([ａ-ｚＡ-Ｚ][ａ-ｚＡ-Ｚ\s\-0-9]*)", 1)
    phonetic = F.regexp_extract(head, r"^[ａ-ｚＡ-Ｚ][ａ-ｚＡ-Ｚ\s\-0-9]*(［[^［］]*］)$", 1)
    clean = F.regexp_replace(F.regexp_replace(meaning, rf"\s*[ˈˌ][^一-鿿]*?(?=\s|$)|\s*[{_PHONETIC}]+(?=\s|$)", " "), r"\s*[；，./（）]+\s*", " ")
    out = text.select("page", tidy(clean).alias("chinese"), tidy(F.when(word == "", head).otherwise(word)).alias("english"), F.nullif(tidy(phonetic), F.lit("")).alias("phonetic"), F.lit("英汉").alias("type"))
    return out.where("length(english) >= 2 AND chinese <> ''")


def page_terms(chars: DataFrame) -> DataFrame:
    """chinese, english, phonetic, category, page, type of every page of characters."""
    rows = lines(chars.where(layout(F.col("page")).isNotNull()))
    by = lambda name: rows.where(layout(F.col("page")) == name)
    cats = page_categories(by("pairs"))
    first = pairs(by("pairs")).join(cats, "page", "left").withColumn("category", F.coalesce("category", F.lit(NO_CATEGORY)))
    second = entries(by("entries")).withColumn("category", F.lit(ENGLISH_CATEGORY))
    return first.unionByName(second).select("chinese", "english", "phonetic", "category", "page", "type")


def usable(terms: DataFrame, cn: str = "chinese", en: str = "english", least_en: int = 2) -> DataFrame:
    """Terms with both sides long enough and nothing of a book's front matter."""
    bad = F.exists(F.array(*map(F.lit, NO_TERMS)), lambda w: F.col(cn).contains(w) | F.col(en).contains(w))
    return terms.where((F.length(cn) >= 2) & (F.length(en) >= least_en) & ~bad)


def distinct_terms(terms: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The first term of those that differ in case only."""
    cols = [c for c in terms.columns]
    folded = [F.lower(k).alias(f"folded_{i}") for i, k in enumerate(keys)]
    return terms.groupBy(*folded).agg(F.min_by(F.struct(*cols), F.struct(*seq)).alias("r")).select("r.*")


def term_document(cn: Column, en: Column, category: Column) -> Column:
    return F.concat_ws(" ", F.concat(F.lit("CN: "), cn), F.concat(F.lit("EN: "), en), F.concat(F.lit("CAT: "), category))


def expanded(texts: DataFrame, key: str, text: str, glossary: DataFrame, least: int = 3) -> DataFrame:
    """(key, text): each run of Latin letters and spaces that the glossary(term, translation) knows, whatever its case, is
    followed by its translation, unless the text has that already."""
    runs = F.regexp_extract_all(F.col(text), F.lit(r"(?U)(\b[a-zA-Z\s]+\b)"), F.lit(1))
    words = texts.select(key, F.posexplode(F.transform(runs, strip)).alias("at", "run")).where(F.length("run") >= least)
    known = glossary.where(F.coalesce("translation", F.lit("")) != "").groupBy(F.lower("term").alias("low")).agg(F.min("translation").alias("translation"))
    found = words.join(known, F.lower("run") == F.col("low")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "run", "translation"))).alias("found"))
    step = lambda a, x: F.when(a.contains(x["translation"]), a).otherwise(F.replace(a, x["run"], F.concat(x["run"], F.lit(" "), x["translation"])))
    return texts.select(key, text).join(found, key, "left").select(key, F.when(F.col("found").isNull(), F.col(text)).otherwise(F.aggregate("found", F.col(text), step)).alias("text"))


def notes(found: DataFrame, key: str, glossary: DataFrame) -> DataFrame:
    """(key, note): a line for each term of found(key, term) that the glossary knows, in the terms' order."""
    known = glossary.groupBy(F.lower("term").alias("low")).agg(F.min("translation").alias("translation"))
    line = F.concat(F.lit("• "), "term", F.lit(" → "), "translation")
    lines = found.select(key, "term").distinct().join(known, F.lower("term") == F.col("low")).groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return lines.select(key, F.concat(F.lit("=== 术语注释 ===\n"), F.array_join("lines", "\n")).alias("note"))
