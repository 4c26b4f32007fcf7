"""One entry to all interfaces: calls by name, chains of two calls, and questions in plain text."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import collection as C
from ..operators import graph as G
from ..operators import retrieval as V
from ..operators import rollups as A
from ..operators import shaping as O
from . import planner as R
from .domain import events, factories, style_factory, table

LOG = logging.getLogger(__name__)
SEQ = ("order_id", "line", "factory_id")
#: Styles that an answer looks at, and results it shows.
MOST_STYLES, TOP_K = 5, 10

_STYLE = "style_id long, role string, event_count long, last_update string, latest_category string, total_delay_days long"
_EVENT = "style_id long, order_id long, line long, factory_id long, category string, event_type string, date string, delay_days long"
#: What each interface returns; also what is left of it, without rows, where a call cannot be made.
SHAPES = {
    "my_styles": _STYLE, "person_styles": _STYLE,
    "factory_styles": "style_id long, last_update string, total_delay_days long, latest_category string",
    "style_summaries": "style_id long, latest_category string, total_events long, total_delay_days long, last_update string",
    "style_overview": "style_id long, people long, customers long, event_count long, last_update string, latest_category string, total_delay_days long",
    "timeline": _EVENT,
    "collaborators": "other string, event_count long, style_count long",
    "factory_delays": "factory_id long, name string, style_count long, total_delay_days long, delay_event_count long",
    "find_styles_with_conditions": "style_id long, total_delay_days long",
    "term_translation": "wanted string, translation string, confidence double",
    "semantic_search": f"{_EVENT}, score double", "semantic_search_by_conditions": f"{_EVENT}, score double", "semantic_search_by_date": f"{_EVENT}, score double",
}


@dataclass
class Answer:
    """What was asked for, how it was routed, the styles it was narrowed to, and the rows of each part."""

    strategy: str
    confidence: float
    styles: list[int] | None = None
    parts: dict[str, DataFrame] = field(default_factory=dict)


class Engine:
    """The interfaces over one set of tables. terms(term, translation) is the glossary, encode turns a text into a vector."""

    def __init__(self, spark: SparkSession, sf_dir: str, terms: DataFrame | None = None, encode: Callable[[Column], Column] | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.terms = terms if terms is not None else table(spark, sf_dir, "part").select(F.lower("p_name").alias("term"), F.col("p_type").alias("translation"))
        self.encode = encode or V.hashing_encoder()
        self.collection: C.VectorCollection | None = None
        self.exact = False

    # what interfaces are made of

    @cached_property
    def events(self) -> DataFrame:
        return events(self.spark, self.sf_dir)

    @cached_property
    def unnamed(self) -> DataFrame:
        """The events without the parties' names."""
        return events(self.spark, self.sf_dir, names=False)

    @cached_property
    def styles(self) -> DataFrame:
        return A.style_rollup(self.events, SEQ)

    @cached_property
    def made_by(self) -> DataFrame:
        return style_factory(self.spark, self.sf_dir).join(factories(self.spark, self.sf_dir), "factory_id")

    def of_styles(self, style_ids) -> DataFrame:
        """Events of the styles asked for, filtered where they are read."""
        return self.events if style_ids is None else self.events.where(F.col("style_id").isin(list(style_ids)))

    # interfaces

    def my_styles(self, person_name: str | None = None) -> DataFrame:
        return self.person_styles(person_name or self.default_person())

    def default_person(self) -> str | None:
        """Whoever takes part in the most styles."""
        row = A.person_rollup(self.events).orderBy(F.col("style_count").desc(), "person").first()
        return row and row.person

    def person_styles(self, person_name: str) -> DataFrame:
        mine = A.person_style(self.events.where((F.col("party_from") == person_name) | (F.col("party_to") == person_name))).where(F.col("person") == person_name)
        owned = self.made_by.where(F.col("name") == person_name).select("style_id", F.col("name").alias("person"))
        return G.styles_by_person(mine, owned, self.styles).select("style_id", "role", "event_count", "last_update", "latest_category", "total_delay_days")

    def factory_styles(self, factory_name: str) -> DataFrame:
        return self.made_by.where(F.col("name") == factory_name).join(self.styles, "style_id").select("style_id", "last_update", "total_delay_days", "latest_category")

    def style_summaries(self, style_ids: list[int] | None = None) -> DataFrame:
        rollup = A.style_rollup(self.of_styles(style_ids), SEQ)
        return rollup.select("style_id", "latest_category", F.col("event_count").alias("total_events"), "total_delay_days", "last_update")

    def style_overview(self, style_id: int | None = None, style_ids: list[int] | None = None) -> DataFrame:
        own = self.of_styles([style_id] if style_id is not None else style_ids)
        people = A.person_style(own).groupBy("style_id").agg(F.count(F.lit(1)).alias("people"))
        customers = own.groupBy("style_id").agg(F.countDistinct("customer_id").alias("customers"))
        joined = A.style_rollup(own, SEQ).join(people, "style_id").join(customers, "style_id")
        return joined.select("style_id", "people", "customers", "event_count", "last_update", "latest_category", "total_delay_days")

    def timeline(self, style_id: int | None = None, style_ids: list[int] | None = None) -> DataFrame:
        return self._as_events(self.of_styles([style_id] if style_id is not None else style_ids)).orderBy("style_id", "date", *SEQ)

    def _as_events(self, rows: DataFrame, *more: str) -> DataFrame:
        return rows.select("style_id", *SEQ, "category", "event_type", "date", "delay_days", *more)

    def collaborators(self, person_name: str, top_k: int = TOP_K) -> DataFrame:
        return A.collaborators_of(self.events, person_name).orderBy(F.col("event_count").desc(), "other").limit(top_k)

    def factory_delays(self, top_k: int = TOP_K) -> DataFrame:
        ranked = A.factory_rollup(factories(self.spark, self.sf_dir), style_factory(self.spark, self.sf_dir), self.styles)
        return ranked.orderBy(F.col("total_delay_days").desc(), "factory_id").limit(top_k)

    def find_styles_with_conditions(self, categories=None, min_delay_days=None, factory_name=None, person_name=None) -> DataFrame:
        factory = self.factory_styles(factory_name) if factory_name else None
        people = self.person_styles(person_name) if person_name else None
        return G.find_styles(self.events, self.styles, categories or [], min_delay_days, factory, people).select("style_id", "total_delay_days")

    def term_translation(self, query: str) -> DataFrame:
        return V.batch_translate(self.terms, self.spark.createDataFrame([(query,)], "wanted string"))

    def semantic_search(self, query: str, style_ids: list[int] | None = None, top_k: int = TOP_K) -> DataFrame:
        return self._nearest(query, lambda rows: rows if style_ids is None else rows.where(F.col("style_id").isin(list(style_ids))), top_k)

    def semantic_search_by_conditions(self, query: str, top_k: int = TOP_K, **conditions) -> DataFrame:
        return self._nearest(query, lambda rows: V.by_conditions(rows, **conditions), top_k)

    def semantic_search_by_date(self, query: str, start: str | None = None, end: str | None = None, top_k: int = TOP_K) -> DataFrame:
        return self._nearest(query, lambda rows: V.by_conditions(rows, start=start, end=end), top_k)

    def document(self) -> Column:
        return X.event_document({"款号": F.col("style_id"), "阶段": F.col("category"), "类型": F.col("event_type"), "日期": F.col("date"), "延期": F.col("delay_days")})

    def _encoded(self, rows: DataFrame) -> DataFrame:
        """Rows with their vectors. These come out of generators, which no filter above takes apart: text and vector are
        made once a row, however often they are referred to."""
        told = rows.select("*", F.explode(F.array(self.document())).alias("__text"))
        return told.select("*", F.explode(F.array(self.encode(F.col("__text")))).alias("embedding")).drop("__text").withColumn("key", G.event_id())

    def store_vectors(self, path: str, exact: bool = False) -> None:
        """Encodes all events once, into a collection under path; from then on searches read its cells, or, with `exact`,
        all of its vectors, instead of encoding events anew."""
        kept = self.unnamed.select("style_id", *SEQ, "category", "event_type", "date", "delay_days", "shipped")
        self.open_vectors(C.create(self._encoded(kept), path, "key", cells=1 if exact else None), exact)

    def open_vectors(self, collection: C.VectorCollection, exact: bool = False) -> None:
        self.collection, self.exact = collection, exact

    def _nearest(self, query: str, narrow: Callable[[DataFrame], DataFrame], top_k: int) -> DataFrame:
        asked = self.spark.range(1).select(F.lit(0).alias("query_id"), self.encode(F.lit(query)).alias("query"))
        if self.collection is not None:
            return self._as_events(self.collection.search(asked, top_k, narrow, exact=self.exact), "score")
        return self._as_events(V.top_k(self._encoded(narrow(self.events)), asked, top_k, id_col="key"), "score")

    # calls

    def call(self, name: str, **params) -> DataFrame:
        """The interface's rows. One that is not known, or whose parameters do not fit it, is logged and has no rows."""
        try:
            if name not in SHAPES:
                raise ValueError(f"no interface {name}")
            return getattr(self, name)(**params)
        except (TypeError, ValueError, PySparkException) as e:
            LOG.warning("%s: %s", name, e)
            return self.spark.createDataFrame([], SHAPES.get(name, "error string"))

    def execute(self, calls: list[tuple[str, dict]]) -> list[DataFrame]:
        """Two calls are a chain, the second for the styles of the first, if they may be one; any others stand alone."""
        names = tuple(name for name, _ in calls)
        if len(calls) == 2 and names in R.CHAINS:
            first, second = (self.call(name, **params) for name, params in calls)
            return [R.chain(*names, {names[0]: first, names[1]: second})]
        return [self.call(name, **params) for name, params in calls]

    # questions

    def route(self, question: str, has_style: bool) -> tuple[str, float]:
        r = self.spark.range(1).select(R.route(F.lit(question), F.lit(has_style)).alias("r")).first().r
        return r.strategy, float(r.confidence)

    def resolve(self, person_name: str | None, factory_name: str | None, context: list[int] | None) -> list[int]:
        """The styles that a question without one is about, MOST_STYLES at most."""
        if context:
            return context[:MOST_STYLES]
        given = [("person_styles", person_name), ("factory_styles", factory_name)]
        found = [self.call(name, **{name.split("_")[0] + "_name": who}).select("style_id", "last_update") if who else None for name, who in given]
        if not any(d is not None for d in found):
            return []
        return [r.style_id for r in R.resolve_styles(None, *found, [F.col("last_update").desc(), "style_id"]).collect()]

    def ask(self, question: str, person_name: str | None = None, factory_name: str | None = None, style_ids: list[int] | None = None, context: list[int] | None = None, top_k: int = TOP_K) -> Answer:
        """Routes a question, finds the styles it is about where it needs some and names none, routes again, answers."""
        strategy, sure = self.route(question, bool(style_ids))
        of_a_style = strategy in ("kg_overview", "hybrid") or (strategy == "rag_semantic" and ("款号" in question or "style" in question.lower()))
        if of_a_style and not style_ids:
            style_ids = self.resolve(person_name, factory_name, context) or None
            if style_ids:
                strategy, sure = self.route(question, True)
        answer = Answer(strategy, sure, style_ids)
        few = (style_ids or [])[:MOST_STYLES]
        if strategy == "kg_overview" and few:
            answer.parts["overview"] = self.call("style_overview", style_id=few[0])
        elif strategy == "hybrid":
            answer.parts["overview"] = self.call("style_overview", style_ids=few)
            answer.parts["hits"] = self.call("semantic_search", query=question, style_ids=style_ids, top_k=top_k)
        elif strategy == "rag_semantic":
            if person_name and not style_ids:
                own = self.call("person_styles", person_name=person_name).select("style_id")
                answer.parts["hits"] = self._nearest(question, lambda rows: rows.join(own, "style_id", "left_semi"), top_k)
            else:
                answer.parts["hits"] = self.call("semantic_search", query=question, style_ids=style_ids, top_k=top_k)
        elif strategy == "kg_temporal":
            if "工厂" in question or "factory" in question.lower():
                answer.parts["factories"] = self.call("factory_delays", top_k=top_k)
            elif person_name:
                late = self.call("person_styles", person_name=person_name).where("total_delay_days > 0")
                answer.parts["delays"] = O.by_delay(late, top_k, ["style_id"])
            elif few:
                answer.parts["timeline"] = self.call("timeline", style_ids=few)
        elif strategy == "kg_relational":
            answer.parts["people"] = self.call("collaborators", person_name=person_name or "", top_k=top_k)
        return answer
