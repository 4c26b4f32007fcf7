"""The library's queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.render import delay_text
from ..operators import datasets as B
from ..operators import graph as G
from ..operators import retrieval as V
from ..operators import rollups as A
from ..operators import shaping as O
from ..streaming import incremental as I
from ..streaming.pointer import shared_folder
from . import planner as R
from .domain import SEQ, departments, events, factories, style_factory, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: "Now" of the queries that look back, and the person, style and item that single look-ups ask for.
NOW, NOW_TS, STYLE, PERSON = "2000-06-01", "2024-01-20 00:00:00", 42, "Supplier#000000001"
EV_SEQ = ("order_id", "line", "factory_id")
#: Queries that need the parties' names; the others read events without the two joins that bring them.
NAMED = frozenset(
    "person_rollup person_style_counts collaborators collaborators_topk people_by_style styles_by_person department_styles customers_by_style styles_by_customer "
    "graph_node_edge_stats neighbours_of_person chain_person_to_summaries truncate_by_score".split()
)


def query(f):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(lambda name: table(spark, sf_dir, name), events(spark, sf_dir, names=f.__name__ in NAMED), spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def styles_of(ev: DataFrame) -> DataFrame:
    return A.style_rollup(ev, EV_SEQ)


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(style_id, person): each style's responsible person, its factory's name."""
    return style_factory(spark, sf_dir).join(factories(spark, sf_dir), "factory_id").select("style_id", F.col("name").alias("person"))


@query
def factory_delay_ranking(t, ev, spark, sf):
    ranked = A.factory_rollup(factories(spark, sf), style_factory(spark, sf), styles_of(ev))
    avg = F.bround(F.col("total_delay_days") / F.greatest(F.col("delay_event_count"), F.lit(1)), 2)
    return ranked.select("factory_id", "name", "style_count", "total_delay_days", "delay_event_count", avg.alias("avg_delay")).orderBy(F.col("total_delay_days").desc(), "factory_id").limit(10)


@query
def style_rollup(t, ev, spark, sf):
    return styles_of(ev)


@query
def person_rollup(t, ev, spark, sf):
    return A.person_rollup(ev)


@query
def person_style_counts(t, ev, spark, sf):
    return A.person_style(ev)


@query
def category_rollup(t, ev, spark, sf):
    return A.category_rollup(ev)


@query
def email_rollup(t, ev, spark, sf):
    return A.email_rollup(ev)


@query
def customer_rollup(t, ev, spark, sf):
    return A.customer_rollup(ev).select("customer_id", "style_count", F.array_join(F.transform("style_list", lambda x: x.cast("string")), ",").alias("styles"))


@query
def department_members(t, ev, spark, sf):
    return A.department_members(factories(spark, sf))


@query
def events_by_conditions(t, ev, spark, sf):
    found = V.by_conditions(ev, categories=["RF", "AF"], event_types=["1-URGENT", "2-HIGH"], min_delay_days=30, start="1993-01-01", end="1998-12-31")
    return found.select(*SEQ, "category", "event_type", "date", "delay_days").orderBy(F.col("date").desc(), *SEQ).limit(100)


@query
def events_of_styles(t, ev, spark, sf):
    return ev.where(F.col("style_id").isin(1, 2, 3, 42)).select(*SEQ, "category", "date", "delay_days")


@query
def recent_events(t, ev, spark, sf):
    latest = t("events")
    cutoff = F.lit(NOW_TS).cast("timestamp_ntz") - F.expr("interval 7 days")
    return latest.where(F.col("ts") >= cutoff).select("event_id", "user_id", "event_type").orderBy("event_id")


@query
def quality_tiers(t, ev, spark, sf):
    return A.processing_stats(ev)


@query
def tier_funnel(t, ev, spark, sf):
    return A.funnel(A.tiers(ev), "tier")


@query
def dedup_first(t, ev, spark, sf):
    return O.first_n(ev, ["style_id", "category", "event_type", "date"], list(SEQ)).select(*SEQ, "category", "event_type", "date")


@query
def top3_per_style(t, ev, spark, sf):
    return O.first_n(ev, ["style_id"], [F.col("date").desc(), *EV_SEQ], 3).select(*SEQ, "date", F.col("rn").cast("long").alias("rn"))


@query
def latest_per_subject(t, ev, spark, sf):
    rows = t("conversations").select("conv_id", "turn", X.normalize_subject(F.col("text")).alias("subject"))
    return O.first_n(rows, ["subject"], [F.col("turn").desc(), "conv_id"]).select("conv_id", "turn", "subject")


@query
def timeline_follows(t, ev, spark, sf):
    return G.follows(ev).select("src", "dst", "time_gap_days")


@query
def asof_previous_event(t, ev, spark, sf):
    rows = t("events").select("event_id", "user_id", "event_type", "ts")
    found = G.previous_event(rows, ["user_id", "event_type"], "ts", "event_id", "event_id")
    return found.select("event_id", F.col("prev_value").alias("prev_id"))


@query
def collaborators(t, ev, spark, sf):
    return A.collaborations(ev)


@query
def collaborators_topk(t, ev, spark, sf):
    mine = A.collaborators_of(ev, PERSON)
    return mine.select("other", "event_count", "style_count").orderBy(F.col("event_count").desc(), "other").limit(10)


@query
def people_by_style(t, ev, spark, sf):
    return G.people_by_style(A.person_style(ev), owners(spark, sf))


@query
def styles_by_person(t, ev, spark, sf):
    found = G.styles_by_person(A.person_style(ev), owners(spark, sf), styles_of(ev)).where(F.col("person") == PERSON)
    return found.select("style_id", "role", "event_count", "last_update", "latest_category", "total_delay_days")


@query
def styles_by_factory(t, ev, spark, sf):
    made = style_factory(spark, sf).join(factories(spark, sf), "factory_id").where((F.col("name") == PERSON) | (F.col("factory_id") == 7))
    return made.join(styles_of(ev), "style_id").select("factory_id", "style_id", "last_update", "total_delay_days", "latest_category")


@query
def department_styles(t, ev, spark, sf):
    members = factories(spark, sf).select(F.col("name").alias("person"), "dept_id")
    return G.department_styles(A.person_style(ev), members)


@query
def find_styles_all_categories(t, ev, spark, sf):
    found = G.find_styles(ev, styles_of(ev), ["NO", "RF", "AF"], min_delay_days=100)
    return found.select("style_id", "total_delay_days").orderBy(F.col("total_delay_days").desc(), "style_id")


@query
def customers_by_style(t, ev, spark, sf):
    return ev.where(F.col("style_id") == STYLE).select("style_id", "customer_id", F.col("party_to").alias("name")).distinct()


@query
def styles_by_customer(t, ev, spark, sf):
    own = ev.where(F.lower("party_to") == "customer#000000007").select("customer_id", "style_id").distinct()
    return own.join(styles_of(ev), "style_id").select("customer_id", "style_id", "last_update", "event_count")


@query
def all_customers_active(t, ev, spark, sf):
    counts = A.customer_rollup(ev).select("customer_id", "style_count")
    all_ = t("customer").select(F.col("c_custkey").cast("long").alias("customer_id"), F.col("c_name").alias("name")).join(counts, "customer_id", "left")
    return all_.select("customer_id", "name", F.coalesce("style_count", F.lit(0)).alias("style_count")).where("style_count >= 5")


@query
def customer_details(t, ev, spark, sf):
    return G.customer_details(ev, style_factory(spark, sf))


@query
def subordinates(t, ev, spark, sf):
    f = factories(spark, sf)
    head = f.groupBy("dept_id").agg(F.min("factory_id").alias("manager_id"))
    return f.join(head, "dept_id").where("factory_id <> manager_id").select("manager_id", "factory_id", "name")


@query
def style_overview_summary(t, ev, spark, sf):
    return A.overview_summary(ev)


@query
def last_update(t, ev, spark, sf):
    since = F.datediff(F.lit(NOW).cast("date"), F.try_to_date("last_update")).cast("long")
    return styles_of(ev).select("style_id", "last_update", "latest_category", since.alias("days_since"))


@query
def style_timeline(t, ev, spark, sf):
    rows = ev.where(F.col("style_id") == STYLE)
    return rows.groupBy("style_id", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", *EV_SEQ))), lambda x: F.concat_ws(":", x["date"], x["order_id"])), ",").alias("timeline"))


@query
def graph_node_edge_stats(t, ev, spark, sf):
    return G.graph_stats(ev, style_factory(spark, sf), factories(spark, sf), departments(spark, sf))


@query
def neighbours_of_person(t, ev, spark, sf):
    e = G.edges(ev, style_factory(spark, sf), factories(spark, sf))["INVOLVED_IN"]
    return G.neighbours(e, F.lit(PERSON), "both")


@query
def chain_person_to_summaries(t, ev, spark, sf):
    mine = G.styles_by_person(A.person_style(ev), owners(spark, sf), styles_of(ev)).where(F.col("person") == PERSON)
    late = F.when(F.col("late_days") > 0, "延期").otherwise("正常")
    summaries = styles_of(ev).select("style_id", "latest_category", "event_count", "total_delay_days", "last_update", late.alias("status"))
    return R.project(R.chain("my_styles", "style_summaries", {"my_styles": mine, "style_summaries": summaries}), ["style_id", "latest_category", "event_count", "total_delay_days", "status"])


@query
def chain_conditions_to_timeline(t, ev, spark, sf):
    styles = G.find_styles(ev, styles_of(ev), ["RF", "NO"], min_delay_days=1500)
    return R.chain("find_styles_with_conditions", "timeline", {"find_styles_with_conditions": styles, "timeline": ev.select(*SEQ, "category", "date")})


@query
def stage_round_robin(t, ev, spark, sf):
    return O.by_stage(ev.where(F.col("style_id") == STYLE).select(*SEQ, "category", "date"), 10, "category", ["date", *EV_SEQ]).select(*SEQ, "category", F.col("round").cast("long").alias("round"))


@query
def truncate_by_delay(t, ev, spark, sf):
    return O.truncate(styles_of(ev), "kg_query.style_summaries", 20, ["style_id"], intent="risk").select("style_id", "total_delay_days")


@query
def truncate_by_date(t, ev, spark, sf):
    return O.truncate(styles_of(ev), "kg_query.my_styles", 20, ["style_id"], intent="recent").select("style_id", "last_update")


@query
def truncate_by_score(t, ev, spark, sf):
    return O.truncate(A.person_rollup(ev), "kg_query.collaborators", 20, ["person"], intent="other").select("person", "event_count")


@query
def truncation_conserves_rows(t, ev, spark, sf):
    s = styles_of(ev).select("style_id", "total_delay_days", "latest_category")
    kept = O.by_delay(s, 50, ["style_id"])
    rest = O.omitted(s, kept, ["style_id"])
    return rest.groupBy("latest_category").agg(F.count(F.lit(1)).alias("omitted"), F.max("total_delay_days").alias("max_omitted_delay"))


@query
def page_n_of_results(t, ev, spark, sf):
    return O.page(styles_of(ev).select("style_id", "last_update"), 3, 15, [F.col("last_update").desc(), "style_id"])


@query
def continuation_page(t, ev, spark, sf):
    return O.after_cursor(ev.select(*SEQ, "date"), F.struct(F.lit(100).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")), list(SEQ), 15)


@query
def chunk_rounds(t, ev, spark, sf):
    return O.chunks(ev.select(*SEQ, "date"), ["style_id"], ["date", *EV_SEQ], 10).select(*SEQ, "round", "total_rounds")


@query
def most_common_stages(t, ev, spark, sf):
    return A.most_common(ev, "event_type", 3, "order_id").select("event_type", "n")



@query
def pii_masked_documents(t, ev, spark, sf):
    return t("documents").select("doc_id", F.md5(X.mask_pii(F.col("text")).cast("binary")).alias("masked_md5"))


@query
def id_extraction_all(t, ev, spark, sf):
    """Order ids and style ids in the texts of all documents."""
    return t("documents").select("doc_id", F.array_join(X.order_ids(F.col("text")), ",").alias("order_ids"), F.array_join(X.style_ids(F.col("text")), ",").alias("style_ids"))


@query
def html_to_text(t, ev, spark, sf):
    return t("pages").select("page_id", F.md5(X.clean_html(F.col("html")).cast("binary")).alias("text_md5"))


@query
def html_tables(t, ev, spark, sf):
    return t("pages").select("page_id", F.size(X.html_tables(F.col("html"))).cast("long").alias("tables"))


@query
def token_estimate(t, ev, spark, sf):
    return t("conversations").groupBy("conv_id").agg(F.sum(X.message_tokens(F.col("role"), F.col("text"))).alias("tokens"))


@query
def context_overflow(t, ev, spark, sf):
    used = t("conversations").groupBy("conv_id").agg(F.sum(X.message_tokens(F.col("role"), F.col("text"))).alias("tokens"))
    return used.select("conv_id", X.overflow_status(F.col("tokens"), 400).alias("status"))


@query
def category_classifier(t, ev, spark, sf):
    return t("documents").select("doc_id", X.classify_category(F.col("text")).alias("category"))


@query
def router_strategy(t, ev, spark, sf):
    r = R.route(F.col("text"), F.col("turn") % 2 == 1)
    return t("conversations").select("conv_id", "turn", r["strategy"].alias("strategy"), r["confidence"].alias("confidence"))


@query
def business_gate(t, ev, spark, sf):
    protected = X.any_of(F.lower(F.substring("text", 1, 300)), ["sample", "fabric", "delivery"])
    return t("documents").select("doc_id", X.gate_status(F.length("text"), protected, F.col("source") == "src0").alias("status"))


@query
def term_frequency_all(t, ev, spark, sf):
    """Candidate terms, Han ones too, by the number of documents of any language that have them."""
    terms = t("documents").select(F.explode(F.array_distinct(X.potential_terms(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("docs")).orderBy(F.col("docs").desc(), "term").limit(20)


@query
def knn_topk(t, ev, spark, sf):
    one = t("embeddings").where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return V.top_k(t("embeddings"), one, 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), "score")


@query
def knn_filtered(t, ev, spark, sf):
    one = t("embeddings").where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return V.top_k(t("embeddings"), one, 5, where=F.col("label").isin(1, 3)).select("vec_id", "label", "score")


@query
def two_stage_retrieval(t, ev, spark, sf):
    one = t("embeddings").where("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))
    return V.two_stage(t("embeddings"), one, "label", 20).select("vec_id", "label", "score")


@query
def stratified_sample(t, ev, spark, sf):
    s = styles_of(ev).select("style_id", B.layer(F.col("event_count")).alias("layer")).where("layer IS NOT NULL")
    return B.stratified(s, "layer", "style_id", {"rich": 50, "medium": 35, "poor": 15}).select("style_id", "layer", F.col("rank").cast("long").alias("rank"))


@query
def stratified_split(t, ev, spark, sf):
    return t("conversations").select("conv_id").distinct().select("conv_id", B.split(F.col("conv_id")).alias("split"))


@query
def split_overlap(t, ev, spark, sf):
    rows = t("conversations").select("conv_id", B.split(F.col("conv_id")).alias("split"))
    return B.split_overlap(rows, "conv_id").select("conv_id", "n")


@query
def sharegpt_records(t, ev, spark, sf):
    r = B.sharegpt(t("conversations"), "conv_id", "turn")
    return r.select("conv_id", F.size("messages").cast("long").alias("n"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "\n").cast("binary")).alias("messages_md5"))


@query
def dpo_pairs(t, ev, spark, sf):
    return B.dpo_pairs(t("conversations"), "conv_id", "turn")


@query
def output_quality_flags(t, ev, spark, sf):
    return t("documents").select("doc_id", *[c.alias(k) for k, c in B.quality_flags(F.col("text")).items()])


@query
def completeness_check(t, ev, spark, sf):
    shown = O.first_n(ev, ["style_id"], [F.col("date").desc(), *EV_SEQ], 3)
    return B.completeness(ev, shown, ["style_id", "category"]).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query
def daily_push(t, ev, spark, sf):
    latest = O.first_n(V.by_conditions(ev, min_delay_days=1), ["factory_id"], [F.col("delay_days").desc(), *SEQ])
    return latest.select("factory_id", "style_id", "order_id", "delay_days", delay_text(F.col("delay_days")).alias("reason")).orderBy(F.col("delay_days").desc(), "factory_id").limit(5)


@query
def stale_styles(t, ev, spark, sf):
    return styles_of(ev).where(F.datediff(F.lit(NOW).cast("date"), F.try_to_date("last_update")) > 700).select("style_id", "last_update")


@query
def style_notes_join(t, ev, spark, sf):
    notes = t("part").where("p_size > 40").select(F.col("p_partkey").cast("long").alias("style_id"), F.col("p_name").alias("alias"))
    return styles_of(ev).join(notes, "style_id", "left").select("style_id", F.coalesce("alias", F.lit("")).alias("alias"), F.col("alias").isNotNull().alias("pinned"))


@query
def resume_anti_join(t, ev, spark, sf):
    done = t("labels").select("doc_id").distinct()
    return t("documents").join(done, "doc_id", "left_anti").select("doc_id")


@query
def overview_markdown_rows(t, ev, spark, sf):
    return A.category_rollup(ev).select(F.concat_ws(" | ", "category", F.col("event_count").cast("string"), F.col("delay_event_count").cast("string")).alias("line"))


@query
def stage_repetition(t, ev, spark, sf):
    return ev.groupBy("style_id", "category").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query
def stream_rollup_equals_batch(t, ev, spark, sf):
    """A real stream: files of events in micro-batches through the persisted state."""
    out = shared_folder(spark)
    t("events").repartition(3, "event_id").write.parquet(f"{out}/in")
    return I.rollup(I.replay(spark, f"{out}/in", t("events").schema, out))


@query
def sliding_windows(t, ev, spark, sf):
    return I.windowed(t("events")).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")
