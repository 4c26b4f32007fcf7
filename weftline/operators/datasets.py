"""Training sets: strata, seeded samples, disjoint splits, records and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_key(key: Column, seed: int = 42) -> Column:
    """A seeded pseudo-random order that any engine can repeat."""
    return F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))).cast("binary"))


def layer(n: Column) -> Column:
    return F.when(n >= 10, "rich").when(n >= 5, "medium").when(n >= 2, "poor")


def stratified(rows: DataFrame, stratum: str, key: str, targets: dict[str, int], seed: int = 42) -> DataFrame:
    """So many rows of each stratum, in seeded order."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(rank_key(F.col(key), seed), key))
    wanted = F.coalesce(*[F.when(F.col(stratum) == k, n) for k, n in targets.items()], F.lit(0))
    return rows.withColumn("rank", rank).where(F.col("rank") <= wanted)


def split(key: Column, train: int = 80, val: int = 10, seed: int = 42) -> Column:
    """train, val or test by the key's hash alone: disjoint, and a key stays where it is when others come."""
    at = F.conv(F.substring(rank_key(key, seed), 1, 6), 16, 10).cast("long") % 100
    return F.when(at < train, "train").when(at < train + val, "val").otherwise("test")


def split_overlap(rows: DataFrame, key: str) -> DataFrame:
    """Keys in more than one split: none should be."""
    return rows.groupBy(key).agg(F.countDistinct("split").alias("n")).where("n > 1")


def sharegpt(turns: DataFrame, key: str, order: str) -> DataFrame:
    """A record a conversation: its messages in order. A conversation of any length is one row, as the format asks."""
    messages = F.transform(F.array_sort(F.collect_list(F.struct(order, "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return turns.groupBy(key).agg(messages.alias("messages"))


def dpo_pairs(turns: DataFrame, key: str, order: str) -> DataFrame:
    """The last user turn, the last assistant turn as chosen, the one before as rejected (none: its text cut in half)."""
    last = lambda role: turns.where(F.col("role") == role)
    user = last("user").groupBy(key).agg(F.max_by("text", order).alias("instruction"))
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    best = last("assistant").withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy(key).agg(F.max(F.when(F.col("rn") == 1, F.col("text"))).alias("chosen"), F.max(F.when(F.col("rn") == 2, F.col("text"))).alias("before"))
    half = F.substring("chosen", F.lit(1), F.floor(F.length("chosen") / 2).cast("int"))
    return user.join(best, key).select(key, "instruction", "chosen", F.coalesce("before", half).alias("rejected"))


def max_tokens(n: Column) -> Column:
    return F.least(F.lit(8192), F.greatest(F.lit(2048), F.lit(800) + 60 * n))


def quality_flags(text: Column) -> dict[str, Column]:
    flags = {"has_title": text.contains("## 📋"), "has_timeline": text.contains("### 一、"), "has_risks": text.contains("### 二、"), "has_path": text.contains("### 三、"), "has_table": text.contains("| 阶段 |"), "has_source": text.contains("📧")}
    passed = flags["has_title"] & flags["has_timeline"] & flags["has_risks"] & flags["has_path"] & flags["has_table"]
    return flags | {"passed": passed, "output_length": F.length(text).cast("long")}


def completeness(given: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are given and not shown (missing), and those shown and not given (invented)."""
    a, b = given.select(*keys).distinct(), shown.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("problem", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("problem", F.lit("invented")))


def dates_monotone(dates: Column) -> Column:
    return dates == F.array_sort(dates)


def markdown_rows(text: Column) -> Column:
    """Cells of table lines with four cells at least, separators left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains("|") & ~x.rlike(r"^\s*\|?[\s:|-]+\|?\s*$"))
    cells = F.transform(lines, lambda x: F.filter(F.transform(F.split(F.trim(x), r"\|"), lambda y: F.trim(y)), lambda y: y != ""))
    return F.filter(cells, lambda c: F.size(c) >= 4)


def scaled_counts(base: dict[str, int], factor: float, total: int, rest: str) -> dict[str, int]:
    """Counts scaled, at least one each, what is left over to one cell."""
    out = {k: max(1, int(v * factor)) for k, v in base.items()}
    out[rest] += total - sum(out.values())
    return out


def usable_questions(rows: DataFrame, text: str, must: str = "我", styles: str = "CCSS|INDO|AW|SS", never: list[str] = ("订单", "order")) -> DataFrame:
    """Questions of 5 to 100 characters that speak of the asker and name neither a style nor an order."""
    out = rows.where(F.length(text).between(5, 100) & F.col(text).contains(must) & ~F.upper(text).rlike(styles))
    for word in never:
        out = out.where(~F.lower(text).contains(word))
    return out


def proportional(rows: DataFrame, stratum: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """The same share of every stratum (rounded down), in seeded order."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(rank_key(F.col(key), seed), key))
    sizes = rows.groupBy(stratum).agg(F.floor(F.count(F.lit(1)) * share).alias("wanted"))
    ranked = rows.withColumn("rank", rank)
    return ranked.join(sizes, ranked[stratum].eqNullSafe(sizes[stratum])).where("rank <= wanted").select(*[ranked[c] for c in rows.columns])


def seed_styles(styles: DataFrame, least: int = 4, most: int = 20, stages: int = 2) -> DataFrame:
    """Styles with enough events in enough stages, and not too many."""
    return styles.where(F.col("event_count").between(least, most) & (F.col("stages") >= stages))


def router_pairs(rows: DataFrame, routes: list[str], key: str = "case_id", seed: int = 42) -> DataFrame:
    """A pair a case: its expected route, and as rejected another one, chosen by the key's hash."""
    others = F.filter(F.array(*map(F.lit, routes)), lambda r: r != F.col("expected_route"))
    at = F.conv(F.substring(rank_key(F.col(key), seed), 1, 6), 16, 10).cast("long") % (len(routes) - 1)
    return rows.select(key, F.col("user_input").alias("instruction"), F.col("expected_route").alias("chosen"), F.get(others, at.cast("int")).alias("rejected"))


def instantiated(templates: DataFrame, entities: DataFrame, per_template: int, seed: int = 42) -> DataFrame:
    """Texts of a bounded list of templates(template_id, scene, template), each with entities(slot_value) in seeded order.

    Entities are ranked once and each template takes so many of the first, shifted by its id: no cross join.
    """
    top = entities.orderBy(rank_key(F.col("slot_value"), seed), "slot_value").limit(per_template)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(rank_key(F.col("slot_value"), seed), "slot_value")))
    wanted = templates.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(per_template))))
    return wanted.join(F.broadcast(ranked), "rank").select("template_id", "scene", F.replace("template", F.lit("{}"), F.col("slot_value")).alias("text"))
