"""Routing and query chains: keywords choose a strategy, a chain of two interfaces becomes one join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import any_of

#: Interfaces that give style ids, and those that take them; every pair is a legal chain, but for the
#: retrieval ones as a first step, which lead only to the first three.
PRIMARIES = {"kg": ("my_styles", "person_styles", "factory_styles", "find_styles_with_conditions"), "rag": ("semantic_search", "semantic_search_by_date", "semantic_search_by_conditions")}
SECONDARIES = ("style_overview", "style_summaries", "timeline", "semantic_search", "semantic_search_by_date", "semantic_search_by_conditions")
CHAINS = {(p, s) for p in PRIMARIES["kg"] for s in SECONDARIES} | {(p, s) for p in PRIMARIES["rag"] for s in SECONDARIES[:3]}
SINGLES = (*PRIMARIES["kg"], "style_summaries", "style_overview", "timeline", "collaborators", "factory_delays", "term_translation", *PRIMARIES["rag"])


def route(text: Column, has_style: Column) -> Column:
    """struct(strategy, confidence): the first rule that holds."""
    low = F.lower(text)
    has = {k: any_of(low, v) for k, v in L.ROUTE_KEYWORDS.items()}
    rule = lambda s, c: F.struct(F.lit(s).alias("strategy"), F.lit(c).alias("confidence"))
    timed = has["temporal"] & ~has["overview"]
    return (
        F.when(has["relational"] & ~has_style, rule("kg_relational", 0.9))
        .when(timed & (text.contains("工厂") | low.contains("factory")), rule("kg_temporal", 0.85))
        .when(timed, rule("kg_temporal", 0.8))
        .when(has_style & has["entity"], rule("hybrid", 0.85))
        .when(has["overview"] & has_style, rule("kg_overview", 0.85))
        .when(has["semantic"] & has_style, rule("hybrid", 0.75))
        .when(has["semantic"], rule("rag_semantic", 0.75))
        .when(has_style, rule("kg_overview", 0.7))
        .otherwise(rule("rag_semantic", 0.6))
    )


def chain(primary: str, secondary: str, sources: dict[str, DataFrame]) -> DataFrame:
    """Rows of the second interface for styles of the first: one semi-join instead of a call a style.

    An illegal pair is an error before anything is planned. The first interface's rows are not returned.
    """
    if (primary, secondary) not in CHAINS:
        raise ValueError(f"{primary} does not lead to {secondary}")
    return sources[secondary].join(sources[primary].select("style_id").distinct(), "style_id", "left_semi")


def execute(calls: list[str], sources: dict[str, DataFrame]) -> list[DataFrame]:
    """Two calls that form a legal chain become one result; any other calls stand alone."""
    if len(calls) == 2 and tuple(calls) in CHAINS:
        return [chain(calls[0], calls[1], sources)]
    return [sources[c] for c in calls]


def project(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Columns by (dotted) path; none asked for: all. Unknown ones are left out."""
    known = [f for f in fields if f.split(".")[0] in rows.columns]
    return rows.select(*[F.col(f).alias(f.replace(".", "_")) for f in known]) if fields else rows


def narrow_scope(styles: DataFrame, events: DataFrame, text: str) -> DataFrame:
    """Styles with an event in a category that the text speaks of; if none of them has, all."""
    labels = [k for k, ws in L.SCOPE_KEYWORDS.items() if any(w in text.lower() for w in ws)]
    if not labels:
        return styles
    match = events.where(any_of(F.col("category"), labels)).select("style_id").distinct()
    found = styles.join(match, "style_id", "left_semi")
    return styles if found.isEmpty() else found


def resolve_styles(context: DataFrame | None, person: DataFrame | None, factory: DataFrame | None, order: list, most: int = 5) -> DataFrame:
    """Styles of the context, else the person's most recent ones, then the factory's."""
    if context is not None:
        return context.limit(most)
    ranked = [d.withColumn("source_rank", F.lit(i)) for i, d in enumerate((person, factory)) if d is not None]
    both = ranked[0] if len(ranked) == 1 else ranked[0].unionByName(ranked[1].join(ranked[0].select("style_id"), "style_id", "left_anti"))
    return both.orderBy("source_rank", *order).limit(most)


REGISTRY: dict[str, Callable] = {"route": route, "chain": chain, "execute": execute, "project": project}
