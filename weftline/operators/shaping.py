"""Result shaping: first-of-group, top-k, sampling, paging and token budgets. Ties always go by input order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L


def first_n(rows: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """The first n rows of each group. The ranking is limited before its shuffle as well as after."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def head(rows: DataFrame, n: int, seq: list) -> DataFrame:
    return rows.orderBy(*seq).limit(n)


def by_delay(rows: DataFrame, n: int, seq: list, total: str = "total_delay_days", own: str = "delay_days") -> DataFrame:
    """Largest delay first: the total unless it is 0 or missing, else the row's own."""
    known = [c for c in (total, own) if c in rows.columns]
    value = F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in known], F.lit(0))
    return rows.orderBy(value.desc(), *seq).limit(n)


def by_score(rows: DataFrame, n: int, seq: list) -> DataFrame:
    known = [F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in ("score", "event_count") if c in rows.columns]
    return rows.orderBy(F.coalesce(*known, F.lit(0.0)).desc(), *seq).limit(n)


def by_date(rows: DataFrame, n: int, seq: list) -> DataFrame:
    known = [F.nullif(F.col(c), F.lit("")) for c in ("date", "last_update") if c in rows.columns]
    return rows.orderBy(F.coalesce(*known, F.lit("")).desc(), *seq).limit(n)


def by_stage(rows: DataFrame, n: int, stage: str, seq: list[str]) -> DataFrame:
    """Round robin over stages in the order of their first row; rows without a stage are of the rest category. Each stage
    is limited to n before rounds are dealt, and of stages the first n matter: that many rows are broadcast."""
    named = rows.withColumn("__stage", F.coalesce(F.nullif(F.col(stage).cast("string"), F.lit("")), F.lit(L.OTHER)))
    first = named.groupBy("__stage").agg(F.min(F.struct(*seq)).alias("stage_first"))
    dealt = first_n(named, ["__stage"], seq, n).withColumnRenamed("rn", "round")
    return dealt.join(F.broadcast(first.orderBy("stage_first").limit(n)), "__stage").orderBy("round", "stage_first").limit(n).drop("stage_first", "__stage")


def stat_only(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))


#: Strategy by intent, and by query type for intents that are not among these; tokens an item takes.
INTENT_STRATEGY = {"overview": "stage", "risk": "delay", "recent": "date", "detail": "head", "count_only": "stat"}
RULES = {
    "kg_query.my_styles": ("stage", 50), "kg_query.person_styles": ("stage", 50), "kg_query.factory_styles": ("delay", 50), "kg_query.style_summaries": ("delay", 80),
    "kg_query.timeline": ("date", 120), "kg_query.collaborators": ("score", 40), "kg_query.factory_delays": ("delay", 40),
    "rag_query.semantic_search": ("score", 150), "rag_query.term_translation": ("head", 30),
}


def truncate(rows: DataFrame, query_type: str, n: int, seq: list, intent: str = "overview", strategy: str | None = None, stage: str = "latest_category") -> DataFrame:
    """The strategy that is asked for, else the intent's, else the query type's; an unknown type comes back whole."""
    if query_type not in RULES:
        return rows
    chosen = strategy or INTENT_STRATEGY.get(intent) or RULES[query_type][0]
    if chosen == "stage" and stage in rows.columns:
        return by_stage(rows, n, stage, seq)
    shapes: dict[str, Callable] = {"delay": by_delay, "score": by_score, "date": by_date}
    return stat_only(rows) if chosen == "stat" else shapes.get(chosen, head)(rows, n, seq)


def omitted(rows: DataFrame, kept: DataFrame, key: list[str]) -> DataFrame:
    """What truncation left out: shown and omitted rows together are all rows."""
    return rows.join(kept.select(*key), key, "left_anti")


def truncated_tokens(query_type: str, n: int) -> int:
    return n * RULES[query_type][1] if query_type in RULES else 0


def max_items(item_tokens: int, remaining: int, least: int = 1, reserve: int = 100) -> int:
    return max(least, (remaining - reserve) // item_tokens)


#: Numbers of rows that a result is cut to in turn until it fits its budget.
LADDER = (200, 150, 100, 50, 30, 20, 10)


def shrink_to_budget(rows: DataFrame, group: str, order: list, tokens: Column, available: Column | int, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """Each group's first rows, as many as the first step of the ladder whose rows have at most `available` tokens; a group
    whose last step is over it keeps none. step is the number of rows that the group was cut to."""
    w = Window.partitionBy(group).orderBy(*order)
    ranked = rows.withColumn("__rank", F.row_number().over(w)).withColumn("__sum", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    limit = F.lit(available) if isinstance(available, int) else available
    held = [F.max(F.when(F.col("__rank") <= n, F.col("__sum"))) <= F.max(limit) for n in sorted(ladder, reverse=True)]
    step = F.coalesce(*[F.when(ok, n) for ok, n in zip(held, sorted(ladder, reverse=True), strict=True)])
    steps = ranked.groupBy(group).agg(step.cast("long").alias("step")).where("step IS NOT NULL")
    return ranked.join(steps, group).where(F.col("__rank") <= F.col("step")).drop("__rank", "__sum")


def within_budget(rows: DataFrame, keys: list[str], order: list, cost: str, budget: int) -> DataFrame:
    """Rows of each group, in order, while their running cost (`used`) stays within the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def page(rows: DataFrame, number: int, size: int, order: list) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def after_cursor(rows: DataFrame, cursor: Column, key: list[str], size: int | None = None) -> DataFrame:
    """Continuation by key, not by offset: what follows the last row shown; without a size all of it."""
    rest = rows.where(F.struct(*key) > cursor)
    return rest if size is None else rest.orderBy(*key).limit(size)


def chunks(rows: DataFrame, keys: list[str], order: list, size: int = 60) -> DataFrame:
    """Rounds of so many rows within each group, and how many rounds there are."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("round", (F.floor((F.row_number().over(w.orderBy(*order)) - 1) / size) + 1).cast("long")).withColumn("total_rounds", F.ceil(F.count(F.lit(1)).over(w) / size).cast("long"))


def carried_forward(rows: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """The last value seen, where a row has none."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def assembled(rows: DataFrame, keys: list[str], order: str, starts: Column, text: str) -> DataFrame:
    """Entries of a start line and the lines up to the next start, joined by a space."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("entry", F.sum(starts.cast("int")).over(w))
    return numbered.where("entry > 0").groupBy(*keys, "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("text"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key, that with the greatest version; of equal ones the new."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    cols = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(version, "__new")).alias("r")).select(*keys, "r.*")
