"""The whole graph in stages: events, factories, organization, customers. Each stage's tables are kept by label.

The order matters: a stage adds edges only to nodes that the stages before have written, so it reads those tables, never
plans of theirs. A stage whose tables are complete has a marker, written last and renamed into place; a run redoes the
stages without one and leaves all others as they are, so a build that was stopped goes on and a lost stage is redone alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import organization as N
from ..operators import rollups as A
from ..streaming.pointer import Pointer

#: Key of each label's nodes.
NODES = {"Event": "event_id", "Style": "style_id", "Person": "person", "Category": "category", "Email": "email", "Factory": "factory_id", "Department": "dept_id", "Customer": "email"}

#: Folder of what a stage stores for its own tables only.
ASIDE = "_aside"


@dataclass
class Inputs:
    """What a build reads. events(style_id, order_id, line, factory_id, category, date, delay_days, party_from, party_to);
    style_factory(style_id, factory_id) and factories(factory_id, name); charts and summaries as their readers give them."""

    events: DataFrame
    style_factory: DataFrame
    factories: DataFrame
    organization: dict[str, DataFrame]
    summary: dict[str, DataFrame]
    customer_sources: list[str]


def _edge(rows: DataFrame, src: str, dst: str, *props: str) -> DataFrame:
    return rows.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), *props)


#: A stage's tables, each as rows or as what makes them when the tables before it are written.
Tables = dict[str, "DataFrame | Callable[[], DataFrame]"]


def of_events(build: GraphBuild, given: Inputs) -> Tables:
    events = build.keep("events", "given", given.events.select("style_id", "order_id", "line", "factory_id", "category", "date", "delay_days", "party_from", "party_to"))
    e = events.withColumn("event_id", G.event_id())
    slots = G.participations(events)
    return {
        "nodes/Event": e.select("event_id", "category", "date", "delay_days"),
        "nodes/Style": A.style_rollup(events).withColumn("style_id", F.col("style_id").cast("string")),
        "nodes/Person": A.person_rollup(events).withColumns({"name": F.col("person"), "is_from_email": F.lit(True)}),
        "nodes/Category": A.category_rollup(events),
        "nodes/Email": A.email_rollup(events).withColumn("email", F.col("email").cast("string")),
        "edges/BELONGS_TO": _edge(e, "event_id", "style_id"),
        "edges/HAS_CATEGORY": _edge(e, "event_id", "category"),
        "edges/FROM_EMAIL": _edge(e, "event_id", "order_id"),
        "edges/PARTICIPATED_IN": _edge(slots.withColumn("event_id", G.event_id()), "person", "event_id", "role"),
        "edges/INVOLVED_IN": _edge(A.person_style(events), "person", "style_id", "event_count"),
        "edges/COLLABORATED_WITH": _edge(A.collaborations(events), "person", "other", "event_count", "style_count"),
        "edges/FOLLOWS": _edge(G.follows(events), "src", "dst", "time_gap_days"),
    }


def of_factories(build: GraphBuild, given: Inputs) -> Tables:
    styles = build.read("events", "nodes/Style")
    made = given.style_factory.select(F.col("style_id").cast("string").alias("style_id"), "factory_id").join(styles.select("style_id"), "style_id", "left_semi")
    sums = A.factory_rollup(given.factories, made, styles)
    return {"nodes/Factory": sums.withColumn("factory_id", F.col("factory_id").cast("string")), "edges/PRODUCED_BY": _edge(made.join(given.factories.select("factory_id"), "factory_id", "left_semi"), "style_id", "factory_id")}


def of_organization(build: GraphBuild, given: Inputs) -> Tables:
    rows = build.keep("organization", "users", N.users(given.organization))
    linked = build.keep("organization", "edges", N.edges(given.organization, rows, build.read("events", "nodes/Style")))
    props = {"RESPONSIBLE_FOR": ["assigned_date"], "INVOLVED_IN": ["involvement_type"]}
    return {
        "nodes/Person": N.people(rows), "nodes/Department": N.departments(given.organization, rows),
        **{f"edges/{k}": _edge(linked.where(F.col("rel_type") == k), "src", "dst", *props.get(k, [])) for k in ("BELONGS_TO_DEPT", "REPORTS_TO", "MANAGES", "RESPONSIBLE_FOR", "INVOLVED_IN")},
    }


def of_customers(build: GraphBuild, given: Inputs) -> Tables:
    found = N.customers(given.summary["people"], given.customer_sources)
    linked = N.customer_styles(found, given.summary["styles"], build.read("events", "nodes/Style"))
    has = lambda: build.read("customers", "edges/HAS_STYLE")
    return {
        "nodes/Customer": linked["customers"], "edges/HAS_STYLE": _edge(linked["edges"].where("rel_type = 'HAS_STYLE'"), "src", "dst"),
        "edges/ORDERED_BY": lambda: has().select(F.col("dst").alias("src"), F.col("src").alias("dst")),
        "nodes/Style": lambda: has().groupBy(F.col("dst").alias("style_id")).agg(F.count(F.lit(1)).alias("customer_count")),
    }


#: The stages in their order, each with its function.
STAGES: list[tuple[str, Callable[[GraphBuild, Inputs], Tables]]] = [("events", of_events), ("factories", of_factories), ("organization", of_organization), ("customers", of_customers)]


class GraphBuild:
    """A build in a folder of the shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.marks = spark, path, Pointer(spark, path)

    def done(self) -> dict[str, list[str]]:
        """The tables of every stage that is complete."""
        return {name: content["tables"] for name, content in self.marks.read_all().items()}

    def run(self, given: Inputs) -> list[str]:
        """Does the stages that are not complete, in order; returns their names."""
        redone = []
        for stage, make in STAGES:
            if stage in self.done():
                continue
            tables = make(self, given)
            for name, rows in tables.items():
                (rows() if callable(rows) else rows).write.mode("overwrite").parquet(f"{self.path}/{stage}/{name}")
            self.marks.write_named(stage, {"tables": sorted(tables)})
            self.marks.delete(f"{self.path}/{stage}/{ASIDE}")
            redone.append(stage)
        return redone

    def drop(self, stage: str) -> None:
        """Forgets a stage, so that the next run redoes it and no other."""
        self.marks.remove(stage)

    def keep(self, stage: str, name: str, rows: DataFrame) -> DataFrame:
        """Rows that several of a stage's tables are made of, stored until they are complete."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{stage}/{ASIDE}/{name}")
        return self.read(stage, f"{ASIDE}/{name}")

    def read(self, stage: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{stage}/{name}")

    def _parts(self, name: str) -> list[DataFrame]:
        done = self.done()
        return [self.read(stage, name) for stage, _ in STAGES if name in done.get(stage, [])]

    def nodes(self, label: str) -> DataFrame:
        """The nodes of a label, a row each: what a stage knows stays, later ones fill in what it lacks."""
        out, *more = self._parts(f"nodes/{label}")
        for rows in more:
            missing = lambda df, other: df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema if f.name not in df.columns])
            if label == "Style":  # counts of customers are about styles that are there
                out = out.join(rows, NODES[label], "left")
            else:
                out = G.fill_missing(missing(out, rows), missing(rows, out), NODES[label])
        return out

    def edges(self, rel_type: str) -> DataFrame:
        """The edges of a relation, a row for each (src, dst), with every stage's properties."""
        parts = self._parts(f"edges/{rel_type}")
        if len(parts) == 1:
            return parts[0]
        rows = parts[0].withColumn("seq", F.lit(0))
        for i, p in enumerate(parts[1:]):
            rows = rows.unionByName(p.withColumn("seq", F.lit(i + 1)), allowMissingColumns=True)
        props = [c for c in rows.columns if c not in ("src", "dst", "seq")]
        return G.merge_edges(rows.withColumn("rel_type", F.lit(rel_type)), props, "seq").drop("rel_type")

    def names(self, kind: str) -> list[str]:
        return sorted({n.split("/")[1] for names in self.done().values() for n in names if n.startswith(f"{kind}/")})

    def stats(self) -> DataFrame:
        """(kind, label, n): nodes by label, edges by relation, and the totals of both."""
        counted = [rows(n).agg(F.lit(kind).alias("kind"), F.lit(n).alias("label"), F.count(F.lit(1)).alias("n")) for kind, what, rows in (("node", "nodes", self.nodes), ("edge", "edges", self.edges)) for n in self.names(what)]
        out = counted[0]
        for d in counted[1:]:
            out = out.unionByName(d)
        return out.rollup("kind", "label").agg(F.sum("n").alias("n")).where("kind IS NOT NULL").select("kind", F.coalesce("label", F.lit("total")).alias("label"), "n")
