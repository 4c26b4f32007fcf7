"""More of the library's queries, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers as M
from ..functions import lexicon as L
from ..functions import replies as Q
from ..functions import text as X
from ..functions.render import delay_text
from ..operators import datasets as B
from ..operators import graph as G
from ..operators import retrieval as V
from ..operators import rollups as A
from ..operators import shaping as O
from ..operators import terms as T
from ..streaming import graph_state as S
from ..streaming.pointer import shared_folder
from . import planner as R
from .domain import BOUND, CTE, SEQ, bounded, events, factories, style_factory, table
from .oracles import _COS, _OWNERS, _PEOPLE, _SLOTS, _any, _key
from .queries import EV_SEQ, NOW, PERSON, STYLE, owners, styles_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries that need the parties' names, as in queries.py.
NAMED = frozenset("keyword_events_in_style distinct_path_values entity_thresholds style_overview resolved_styles person_delays default_person person_names graph_state_equals_rebuild".split())
_SEQ = ", ".join(SEQ)
_EV_SEQ = ", ".join(EV_SEQ)


def query(sql: str | None = None):
    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: table(spark, sf_dir, name), events(spark, sf_dir, names=f.__name__ in NAMED), spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return run

    return register


# filters and projections


@query(f"{CTE} SELECT {_SEQ}, category, date FROM ev WHERE style_id IN (7, {STYLE}) ORDER BY {_SEQ} LIMIT 25")
def first_events_of_styles(t, ev, spark, sf):
    return O.head(ev.where(F.col("style_id").isin(7, STYLE)).select(*SEQ, "category", "date"), 25, list(SEQ))


@query(f"{CTE} SELECT {_SEQ}, party_to FROM ev WHERE style_id = {STYLE} AND (contains(lower(party_to), 'customer#00000000') OR contains(lower(party_from), 'customer#00000000'))")
def keyword_events_in_style(t, ev, spark, sf):
    word = "Customer#00000000".lower()
    return ev.where((F.col("style_id") == STYLE) & (F.lower("party_to").contains(word) | F.lower("party_from").contains(word))).select(*SEQ, "party_to")


@query(f"{CTE}, s AS (SELECT style_id, min(order_id) AS first_order FROM ev WHERE party_from = '{PERSON}' GROUP BY 1) SELECT * FROM s")
def distinct_path_values(t, ev, spark, sf):
    found = ev.where(F.col("party_from") == PERSON).groupBy("style_id").agg(F.min(F.struct(*EV_SEQ)).alias("at"))
    return found.select("style_id", F.col("at.order_id").alias("first_order"))


@query(f"{CTE}, s AS (SELECT customer_id, list_sort(list(DISTINCT style_id)) AS l FROM ev GROUP BY 1) SELECT customer_id, array_to_string(l[1:3], ',') AS shown, CAST(len(l) AS BIGINT) AS styles_count FROM s")
def result_lists_cut(t, ev, spark, sf):
    cut = F.transform(F.slice("style_list", 1, 3), lambda x: x.cast("string"))
    return A.customer_rollup(ev).select("customer_id", F.array_join(cut, ",").alias("shown"), F.size("style_list").cast("long").alias("styles_count"))


@query(r"""WITH q AS (SELECT DISTINCT regexp_replace(text, '^\s+|\s+$', '', 'g') AS question FROM conversations WHERE role = 'user')
SELECT question FROM q WHERE length(question) BETWEEN 5 AND 100 AND contains(question, 'a') AND NOT regexp_matches(upper(question), 'CCSS|INDO') AND NOT contains(lower(question), 'order')""")
def usable_questions(t, ev, spark, sf):
    q = t("conversations").where("role = 'user'").select(X.strip(F.col("text")).alias("question")).distinct()
    return B.usable_questions(q, "question", must="a", styles="CCSS|INDO", never=["order"])


@query(f"{CTE} SELECT style_id, count(*) AS n, max(delay_days) AS worst FROM ev WHERE delay_days > 0 GROUP BY 1")
def delayed_events(t, ev, spark, sf):
    return ev.where(F.coalesce("delay_days", F.lit(0)) > 0).groupBy("style_id").agg(F.count(F.lit(1)).alias("n"), F.max("delay_days").alias("worst"))


@query(f"{CTE}{_SLOTS} SELECT 'person' AS kind, person AS name, count(DISTINCT style_id) AS styles FROM slots GROUP BY ALL HAVING count(DISTINCT style_id) >= 3 UNION ALL SELECT 'factory', s_name, count(*) FROM sf JOIN supplier ON s_suppkey = factory_id GROUP BY ALL HAVING count(*) >= 2")
def entity_thresholds(t, ev, spark, sf):
    people = A.person_rollup(ev).where("style_count >= 3").select(F.lit("person").alias("kind"), F.col("person").alias("name"), F.col("style_count").alias("styles"))
    makers = owners(spark, sf).groupBy(F.col("person").alias("name")).agg(F.count(F.lit(1)).alias("styles")).where("styles >= 2")
    return people.unionByName(makers.select(F.lit("factory").alias("kind"), "name", "styles"))


# joins


@query(f"{CTE}, l AS (SELECT style_id, arg_max(factory_id, (order_id, line, factory_id)) AS factory_id FROM ev GROUP BY 1) SELECT l.style_id, l.factory_id, s_name AS name FROM l JOIN supplier ON s_suppkey = l.factory_id")
def factory_last_row_wins(t, ev, spark, sf):
    last = ev.groupBy("style_id").agg(F.max_by("factory_id", F.struct(*EV_SEQ)).alias("factory_id"))
    return last.join(factories(spark, sf), "factory_id").select("style_id", "factory_id", "name")


@query(f"{CTE}, k AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), p AS (SELECT DISTINCT customer_id, style_id FROM ev WHERE customer_id IN (SELECT c_custkey FROM k)) SELECT 'HAS_STYLE' AS rel_type, customer_id AS src, style_id AS dst FROM p UNION ALL SELECT 'ORDERED_BY', style_id, customer_id FROM p")
def customer_style_edges(t, ev, spark, sf):
    known = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("customer_id"))
    pairs = ev.join(known, "customer_id", "left_semi").select("customer_id", "style_id").distinct()
    edge = lambda rel, a, b: F.struct(F.lit(rel).alias("rel_type"), F.col(a).alias("src"), F.col(b).alias("dst"))
    return pairs.select(F.inline(F.array(edge("HAS_STYLE", "customer_id", "style_id"), edge("ORDERED_BY", "style_id", "customer_id"))))


@query(f"{CTE}{_SLOTS}, p AS (SELECT style_id, count(*) AS people FROM ps GROUP BY 1), c AS (SELECT style_id, count(DISTINCT customer_id) AS customers FROM ev GROUP BY 1) SELECT style_id, people, customers, event_count, last_update, latest_category FROM styles JOIN p USING (style_id) JOIN c USING (style_id)")
def style_overview(t, ev, spark, sf):
    people = A.person_style(ev).groupBy("style_id").agg(F.count(F.lit(1)).alias("people"))
    customers = ev.groupBy("style_id").agg(F.countDistinct("customer_id").alias("customers"))
    return styles_of(ev).join(people, "style_id").join(customers, "style_id").select("style_id", "people", "customers", "event_count", "last_update", "latest_category")


@query(f"{CTE}, h AS (SELECT e.vec_id, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, e.vec_id LIMIT 10) SELECT style_id, score, event_count, latest_category FROM h JOIN styles ON style_id = vec_id")
def hybrid_overview_and_hits(t, ev, spark, sf):
    one = t("embeddings").where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    hits = V.top_k(t("embeddings"), one, 10).select(F.col("vec_id").cast("long").alias("style_id"), "score")
    return styles_of(ev).join(F.broadcast(hits), "style_id").select("style_id", "score", "event_count", "latest_category")


@query("SELECT conv_id, role, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY ALL")
def upsert_newest(t, ev, spark, sf):
    rows = t("conversations").select("conv_id", "role", "turn", "text")
    return O.upsert(rows.where("turn % 2 = 0"), rows.where("turn % 2 = 1"), ["conv_id", "role"], "turn").select("conv_id", "role", "turn", "text")


@query(f"{CTE}, a AS (SELECT DISTINCT style_id, category FROM ev WHERE confidence >= 60), b AS (SELECT DISTINCT style_id, category FROM ev WHERE confidence <= 80) SELECT 'missing' AS problem, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'invented', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def input_output_diff(t, ev, spark, sf):
    return B.completeness(ev.where("confidence >= 60"), ev.where("confidence <= 80"), ["style_id", "category"]).select("problem", "style_id", "category")


@query(f"{CTE}{_SLOTS}{_OWNERS}{_PEOPLE}, a AS (SELECT style_id, 0 AS source_rank, last_update FROM people JOIN styles USING (style_id) WHERE person = '{PERSON}'), b AS (SELECT sf.style_id, 1, last_update FROM sf JOIN styles USING (style_id) WHERE sf.factory_id = 7 AND sf.style_id NOT IN (SELECT style_id FROM a)), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT style_id, last_update FROM u ORDER BY source_rank, last_update DESC, style_id LIMIT 5")
def resolved_styles(t, ev, spark, sf):
    styles = styles_of(ev)
    person = G.styles_by_person(A.person_style(ev), owners(spark, sf), styles).where(F.col("person") == PERSON).select("style_id", "last_update")
    factory = style_factory(spark, sf).where("factory_id = 7").join(styles, "style_id").select("style_id", "last_update")
    return R.resolve_styles(None, person, factory, [F.col("last_update").desc(), "style_id"]).select("style_id", "last_update")


@query(f"{CTE}{_SLOTS}{_OWNERS}{_PEOPLE} SELECT style_id, role, total_delay_days FROM people JOIN styles USING (style_id) WHERE person = '{PERSON}' AND total_delay_days > 0 ORDER BY total_delay_days DESC, style_id LIMIT 10")
def person_delays(t, ev, spark, sf):
    mine = G.styles_by_person(A.person_style(ev), owners(spark, sf), styles_of(ev)).where((F.col("person") == PERSON) & (F.col("total_delay_days") > 0))
    return O.by_delay(mine, 10, ["style_id"]).select("style_id", "role", "total_delay_days")


# aggregates


@query("SELECT p_type AS category, count(*) AS n FROM part GROUP BY 1")
def term_category_distribution(t, ev, spark, sf):
    return t("part").groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{CTE} SELECT style_id, latest_category, event_count AS total_events, total_delay_days, last_update, CAST(5 AS BIGINT) AS asked FROM styles WHERE style_id IN (1, 2, 3, {STYLE}, -1)")
def style_summaries_of_list(t, ev, spark, sf):
    asked = [1, 2, 3, STYLE, -1]
    return styles_of(ev.where(F.col("style_id").isin(asked))).select("style_id", "latest_category", F.col("event_count").alias("total_events"), "total_delay_days", "last_update", F.lit(len(asked)).cast("long").alias("asked"))


@query(f"WITH c AS (SELECT conv_id, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS rounds, CAST('0x' || substr({_key('conv_id')}, 1, 6) AS BIGINT) % 100 AS p FROM conversations GROUP BY conv_id) SELECT CASE WHEN p < 80 THEN 'train' WHEN p < 90 THEN 'val' ELSE 'test' END AS split, rounds, count(*) AS n FROM c GROUP BY ALL")
def dataset_rounds_by_split(t, ev, spark, sf):
    rounds = t("conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("rounds"))
    return rounds.groupBy(B.split(F.col("conv_id")).alias("split"), "rounds").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS good_rate, round(coalesce(avg(CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0 END) FILTER (quality = 1), 0), 6) AS toxic_when_good FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def evaluation_metrics(t, ev, spark, sf):
    flag = lambda c: (F.col(c) == 1).cast("double")
    rows = t("labels").join(t("documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(flag("quality"), F.lit(0.0))), 6).alias("good_rate"), F.round(F.coalesce(F.avg(F.when(F.col("quality") == 1, F.coalesce(flag("toxic"), F.lit(0.0)))), F.lit(0.0)), 6).alias("toxic_when_good"))


@query(f"{CTE}{_SLOTS} SELECT person, count(DISTINCT style_id) AS style_count FROM slots WHERE person IN ('Supplier#000000004', 'Supplier#000000002', 'Supplier#000000003', '{PERSON}') GROUP BY 1 ORDER BY style_count DESC, person LIMIT 1")
def default_person(t, ev, spark, sf):
    names = ["Supplier#000000004", "Supplier#000000002", "Supplier#000000003", PERSON]
    own = A.person_rollup(ev.where(F.col("party_from").isin(names) | F.col("party_to").isin(names))).where(F.col("person").isin(names))
    return own.select("person", "style_count").orderBy(F.col("style_count").desc(), "person").limit(1)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, count(DISTINCT user_id) AS users, round(CAST(sum(CAST(value AS DECIMAL(38,6))) AS DOUBLE), 4) AS total_value FROM events GROUP BY 1")
def daily_report(t, ev, spark, sf):
    return t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("user_id").alias("users"), F.round(F.sum(F.col("value").cast("decimal(38,6)")).cast("double"), 4).alias("total_value"))


@query(f"{CTE} SELECT style_id, CAST(sum(delay_days) AS BIGINT) AS days FROM ev WHERE date >= strftime(DATE '{NOW}' - INTERVAL 730 DAY, '%Y-%m-%d') GROUP BY 1 ORDER BY days DESC, style_id LIMIT 10")
def most_delayed_lately(t, ev, spark, sf):
    lately = V.recent(ev, F.lit(NOW).cast("date"), 730)
    return lately.groupBy("style_id").agg(F.sum("delay_days").alias("days")).orderBy(F.col("days").desc(), "style_id").limit(10)


@query(f"{CTE} SELECT * FROM styles")
def graph_state_equals_rebuild(t, ev, spark, sf):
    """Three batches applied to the persisted state, whose tables then give the rollup."""
    state = S.GraphState(spark, shared_folder(spark))
    for k in range(3):
        state.apply(ev.where(F.col("order_id") % 3 == k), k)
    return S.styles(state.tables())


# windows and shapes


@query("SELECT arg_min(p_partkey, p_partkey) AS p_partkey, lower(p_name) AS term FROM part WHERE length(p_name) >= 2 GROUP BY 2")
def term_dedup(t, ev, spark, sf):
    rows = t("part").select("p_partkey", "p_name").where("length(p_name) >= 2")
    return T.distinct_terms(rows, ["p_name"], ["p_partkey"]).select("p_partkey", F.lower("p_name").alias("term"))


@query("SELECT vec_id, 'term_' || label || '_' || (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS id FROM embeddings")
def sequence_ids(t, ev, spark, sf):
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return t("embeddings").select("vec_id", "label").select("vec_id", F.concat_ws("_", F.lit("term"), "label", n).alias("id"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked_at FROM conversations")
def carried_forward(t, ev, spark, sf):
    rows = t("conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("asked_at"))
    return O.carried_forward(rows, ["conv_id"], ["turn"], "asked_at")


@query("WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS entry FROM conversations) SELECT conv_id, CAST(entry AS BIGINT) AS entry, md5(string_agg(text, ' ' ORDER BY turn)) AS text_md5 FROM s WHERE entry > 0 GROUP BY ALL")
def assembled_entries(t, ev, spark, sf):
    made = O.assembled(t("conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], "turn", F.col("role") == "user", "text")
    return made.select("conv_id", F.col("entry").cast("long").alias("entry"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("WITH r AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations) SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM r WHERE used <= 400")
def budgeted_turns(t, ev, spark, sf):
    return O.within_budget(t("conversations").select("conv_id", "turn", F.length("text").cast("long").alias("cost")), ["conv_id"], [F.col("turn").desc()], "cost", 400).select("conv_id", "turn", "used")


@query(f"{CTE} SELECT latest_category, count(*) AS total FROM styles GROUP BY 1")
def counts_only(t, ev, spark, sf):
    return styles_of(ev).groupBy("latest_category").agg(F.count(F.lit(1)).alias("total"))


@query(f"{CTE} SELECT {_SEQ}, date FROM ev ORDER BY CASE WHEN try_cast(date AS DATE) IS NULL THEN '9999-99-99' ELSE date END, {_SEQ} LIMIT 20")
def missing_dates_last(t, ev, spark, sf):
    return ev.select(*SEQ, "date").orderBy(F.try_to_date("date").asc_nulls_last(), *SEQ).limit(20)


@query("WITH r AS (SELECT user_id AS src, event_type AS dst, count(*) AS writes, arg_max(value, event_id) AS value FROM events GROUP BY ALL) SELECT CAST(src AS VARCHAR) AS src, dst, value FROM r")
def merged_edges(t, ev, spark, sf):
    rows = t("events").select(F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst"), F.lit("DID").alias("rel_type"), "value", "event_id")
    return G.merge_edges(rows, ["value"], "event_id").select("src", "dst", "value")


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def first_writers(t, ev, spark, sf):
    return G.first_writer(t("events").select("user_id", "event_type", "event_id"), "user_id", "event_id").select("user_id", "event_type", "event_id")


# text


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}')) AS BIGINT) AS dates FROM documents")
def dates_in_text(t, ev, spark, sf):
    return t("documents").select("doc_id", F.size(X.dates_in(F.col("text"))).cast("long").alias("dates"))


_STOP = ", ".join(f"'{w}'" for w in L.TERM_STOPWORDS)


_TERMS = f"""WITH m AS (SELECT doc_id, list_distinct(list_concat(regexp_extract_all(text, '([一-龥]{{2,10}})', 1),
  list_transform(regexp_extract_all({bounded('text')}, '{BOUND}([a-zA-Z](?:{BOUND}?[a-zA-Z\\-]){{2,20}}){BOUND}', 1), lambda w: replace(w, '{BOUND}', '')))) AS found FROM documents
), x AS (SELECT doc_id, list_filter(found, lambda w: w NOT IN ({_STOP})) AS terms FROM m)"""


ORACLE_SQL["term_frequency_all"] = f"{_TERMS} SELECT term, count(*) AS docs FROM (SELECT unnest(terms) AS term FROM x) GROUP BY 1 ORDER BY docs DESC, term LIMIT 20"


@query(f"{_TERMS} SELECT doc_id, CAST(len(terms) AS BIGINT) AS terms FROM x")
def candidate_terms_all(t, ev, spark, sf):
    """How many candidate terms each document has, Han ones too."""
    return t("documents").select("doc_id", F.size(X.potential_terms(F.col("text"))).cast("long").alias("terms"))


@query("SELECT conv_id, CASE WHEN length(arg_min(text, turn)) > 20 THEN left(arg_min(text, turn), 20) || '...' ELSE arg_min(text, turn) END AS title FROM conversations GROUP BY 1")
def conversation_titles(t, ev, spark, sf):
    return t("conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first")).select("conv_id", X.title_of(F.col("first")).alias("title"))


@query("SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]', '', 'g') = text AS clean FROM documents")
def control_characters_all(t, ev, spark, sf):
    return t("documents").select("doc_id", (X.strip_controls(F.col("text")) == F.col("text")).alias("clean"))


@query(f"SELECT conv_id, turn, {_any('lower(text)', L.CONTINUATION)} OR lower(text) IN ('续', '继', '查', '看') AS continues FROM conversations")
def continuation_turns(t, ev, spark, sf):
    return t("conversations").select("conv_id", "turn", X.is_continuation(F.col("text")).alias("continues"))


@query(f"{CTE} SELECT DISTINCT party_from AS raw, 'Supplier#' || right(party_from, 9) AS name FROM ev")
def person_names(t, ev, spark, sf):
    raw = ev.select(F.col("party_from").alias("raw")).distinct()
    return raw.select("raw", X.person_name(F.upper("raw")).alias("name"))


@query(f"{CTE} SELECT {_SEQ}, concat_ws(' | ', '款号: ' || style_id, '阶段: ' || category, '日期: ' || date, '延期: ' || delay_days) AS document FROM ev")
def event_documents(t, ev, spark, sf):
    fields = {"款号": F.col("style_id"), "阶段": F.col("category"), "日期": F.col("date"), "延期": F.col("delay_days")}
    return ev.select(*SEQ, X.event_document(fields).alias("document"))


# retrieval


@query(f"WITH q AS (SELECT vec_id, embedding, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) SELECT q.label AS query_label, e.vec_id, e.label, {_COS} AS score FROM embeddings e JOIN q ON e.vec_id <> q.vec_id QUALIFY row_number() OVER (PARTITION BY q.label ORDER BY score DESC, e.vec_id) = 1")
def batch_nearest_label(t, ev, spark, sf):
    e = t("embeddings")
    firsts = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("q")).select(F.col("q.vec_id").alias("query_id"), F.col("q.embedding").alias("query"), F.col("label").alias("query_label"))
    return V.top_k(e, firsts, 1, but_self=True).select("query_label", "vec_id", "label", "score")


@query(f"WITH k AS (SELECT e.vec_id, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0) SELECT vec_id, round(score * pow(0.5, (vec_id % 30) / 30.0), 6) AS decayed FROM k WHERE score >= 0.25")
def time_decayed_hits(t, ev, spark, sf):
    one = t("embeddings").where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = V.scored(t("embeddings"), one).where("score >= 0.25")
    return V.time_decayed(near, F.col("vec_id") % 30).select("vec_id", F.round("decayed", 6).alias("decayed"))


# datasets and answers


@query(f"{CTE}, g AS (SELECT style_id, count(DISTINCT category) AS stages, event_count, late_event_count FROM ev JOIN styles USING (style_id) GROUP BY ALL) SELECT style_id, event_count, late_event_count > 0 AS delayed FROM g WHERE event_count BETWEEN 4 AND 20 AND stages >= 2")
def seed_styles(t, ev, spark, sf):
    stages = ev.groupBy("style_id").agg(F.countDistinct("category").alias("stages"))
    return B.seed_styles(styles_of(ev).join(stages, "style_id")).select("style_id", "event_count", (F.col("late_event_count") > 0).alias("delayed"))


@query(f"WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_key('doc_id')}, doc_id) AS rank, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, source FROM r WHERE rank <= floor(n * 0.1)")
def proportional_sample(t, ev, spark, sf):
    return B.proportional(t("documents").select("doc_id", "source"), "source", "doc_id", 0.1)


@query(f"{CTE} SELECT style_id, count(*) AS n, md5(string_agg(date || '|' || category || '|' || coalesce(delay_days, 0), chr(10) ORDER BY date, {_EV_SEQ})) AS input_md5 FROM ev GROUP BY 1")
def report_inputs(t, ev, spark, sf):
    line = F.concat_ws("|", "date", "category", F.coalesce("delay_days", F.lit(0)).cast("string"))
    rows = ev.groupBy("style_id").agg(F.array_sort(F.collect_list(F.struct("date", *EV_SEQ, line.alias("text")))).alias("l"))
    return rows.select("style_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join(F.transform("l", lambda x: x["text"]), "\n").cast("binary")).alias("input_md5"))


@query("SELECT doc_id, contains(text, '时间线') OR contains(text, '###') AS has_timeline, contains(text, '根因') OR contains(text, '结论') OR contains(text, '分析') AS has_conclusion FROM documents")
def report_sections(t, ev, spark, sf):
    errors = Q.format_errors(F.col("text"))
    return t("documents").select("doc_id", (~F.array_contains(errors, "缺少时间线")).alias("has_timeline"), (~F.array_contains(errors, "缺少根因分析")).alias("has_conclusion"))


@query(f"{CTE} SELECT style_id, CASE WHEN late_event_count = 0 THEN '款号 **' || style_id || '** 当前无延期记录。' ELSE style_id || ' 累计延期 ' || late_days || ' 天，涉及 ' || late_event_count || ' 个阶段。' END AS answer FROM styles")
def delay_answers(t, ev, spark, sf):
    return M.delays(styles_of(ev))


_LATE = "CASE WHEN delay_days > 0 THEN ' ⚠️延期' || delay_days || '天' WHEN delay_days < 0 THEN ' ✅提前' || -delay_days || '天' ELSE '' END"


@query(f"""{CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY style_id ORDER BY date DESC, {_EV_SEQ}) AS rn, count(*) OVER (PARTITION BY style_id) AS total FROM ev)
SELECT style_id, md5('### 款号 ' || style_id || ' 时间线' || chr(10) || chr(10) || string_agg('- **' || date || '** | ' || category || ' · ' || event_type || {_LATE}, chr(10) ORDER BY rn) || CASE WHEN any_value(total) > 10 THEN chr(10) || chr(10) || '*共 ' || any_value(total) || ' 条事件，以上为最近10条*' ELSE '' END) AS answer_md5 FROM r WHERE rn <= 10 GROUP BY style_id""")
def timeline_answers(t, ev, spark, sf):
    newest = O.first_n(ev, ["style_id"], [F.col("date").desc(), *EV_SEQ], M.MOST_LINES)
    return M.timelines(ev, newest).select("style_id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"))


@query(f"""{CTE}, d AS (SELECT * FROM ev WHERE delay_days > 0 QUALIFY row_number() OVER (PARTITION BY factory_id, style_id ORDER BY date DESC, order_id, line) = 1), r AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY factory_id ORDER BY delay_days DESC, style_id) <= 5)
SELECT factory_id, '### 今日关注' || chr(10) || chr(10) || string_agg('- ' || style_id || '：延期' || delay_days || '天', chr(10) ORDER BY delay_days DESC, style_id) AS content, count(*) AS risk_count FROM r GROUP BY 1""")
def morning_pushes(t, ev, spark, sf):
    late = O.first_n(ev.where("delay_days > 0"), ["factory_id", "style_id"], [F.col("date").desc(), "order_id", "line"]).drop("rn")
    worst = O.first_n(late, ["factory_id"], [F.col("delay_days").desc(), "style_id"], 5)
    return M.push(worst, ["factory_id"])


def _manifest_status(text: Column, source: Column) -> Column:
    """The first line is the subject; a null text is an empty one."""
    kept = X.gate_status(F.length(text), X.has_business_keyword(text), source == "src0")
    return F.when(X.blacklisted(F.substring_index(text, "\n", 1), F.lit("a@b")).isNotNull(), "blacklisted").otherwise(kept)


@query("WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents) SELECT doc_id, CASE WHEN " + " OR ".join(f"regexp_matches(split_part(text, chr(10), 1), '(?i){p}')" for p in L.SUBJECT_BLACKLIST) + " THEN 'blacklisted' WHEN " + _any("lower(substr(text, 1, 300))", [w.lower() for w in L.BUSINESS_KEYWORDS]) + " THEN CASE WHEN length(text) < 50 THEN 'too_short' ELSE 'passed' END WHEN length(text) < CASE WHEN source = 'src0' THEN 300 ELSE 200 END THEN 'too_short' ELSE 'passed' END AS status FROM d")
def mail_manifest(t, ev, spark, sf):
    return t("documents").select("doc_id", _manifest_status(F.coalesce("text", F.lit("")), F.col("source")).alias("status"))


@query(f"{CTE} SELECT style_id, delay_days, CASE WHEN delay_days > 0 THEN '延期' || delay_days || '天' WHEN delay_days < 0 THEN '提前' || -delay_days || '天' ELSE '正常' END AS said FROM ev")
def delay_texts(t, ev, spark, sf):
    return ev.select("style_id", "delay_days", delay_text(F.col("delay_days")).alias("said"))
