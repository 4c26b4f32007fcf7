"""The property graph: edges, nodes, and the lookups over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rollups

SEQ = ("order_id", "line", "style_id", "factory_id")


def event_id() -> Column:
    return F.concat_ws("-", F.lit("evt"), *[F.col(c) for c in SEQ])


def follows(events: DataFrame) -> DataFrame:
    """Each event's successor by date within its style and category, and the days between."""
    w = Window.partitionBy("style_id", "category").orderBy("date", *SEQ)
    nxt = events.select("style_id", "category", event_id().alias("src"), "date", *[c for c in SEQ if c != "style_id"], F.lead(event_id()).over(w).alias("dst"), F.lead("date").over(w).alias("next_date"))
    return nxt.where(F.col("dst").isNotNull()).select("style_id", "category", "src", "dst", F.datediff(F.try_to_date("next_date"), F.try_to_date("date")).cast("long").alias("time_gap_days"))


def previous_event(rows: DataFrame, keys: list[str], at: str, value: str, tie: str) -> DataFrame:
    """As-of predecessor, strictly earlier: the latest earlier row of the same keys (of equal times the last by tie).

    Times are first made unique a key, so the frame is one row back however many rows share a time.
    """
    last = rows.groupBy(*keys, at).agg(F.max_by(value, tie).alias("prev_value"))
    w = Window.partitionBy(*keys).orderBy(at)
    prev = last.select(*keys, at, F.lag("prev_value").over(w).alias("prev_value"), F.lag(at).over(w).alias("prev_at"))
    return rows.join(prev, [*keys, at])


def participations(events: DataFrame) -> DataFrame:
    """(person, *SEQ, role), a row for each person and event: events are dealt out by their order and told by their keys
    before there is a row a slot; with the same person in both slots the last role stays."""
    return rollups.parties(events.select(*SEQ, "party_from", "party_to").repartition("order_id")).groupBy("person", *SEQ).agg(F.max("role").alias("role"))


def edges(events: DataFrame, style_factory: DataFrame, factories: DataFrame) -> dict[str, DataFrame]:
    """Edges by relation, unique in (src, dst): with the same person in both slots the last role stays."""
    e = events.withColumn("event", event_id())
    manager = factories.groupBy("dept_id").agg(F.min("factory_id").alias("manager"))
    return {
        "BELONGS_TO": e.select(F.col("event").alias("src"), F.col("style_id").cast("string").alias("dst")),
        "HAS_CATEGORY": e.select(F.col("event").alias("src"), F.col("category").alias("dst")),
        "FROM_EMAIL": e.select(F.col("event").alias("src"), F.col("order_id").cast("string").alias("dst")),
        "PARTICIPATED_IN": participations(events).select(F.col("person").alias("src"), event_id().alias("dst"), "role"),
        "INVOLVED_IN": rollups.person_style(events).select(F.col("person").alias("src"), F.col("style_id").cast("string").alias("dst"), "event_count"),
        "COLLABORATED_WITH": rollups.collaborations(events).select(F.col("person").alias("src"), F.col("other").alias("dst"), "event_count", "style_count"),
        "FOLLOWS": follows(events).select("src", "dst", "time_gap_days"),
        "PRODUCED_BY": style_factory.select(F.col("style_id").cast("string").alias("src"), F.col("factory_id").cast("string").alias("dst")),
        "BELONGS_TO_DEPT": factories.select(F.col("name").alias("src"), F.col("dept_id").cast("string").alias("dst")),
        "REPORTS_TO": factories.join(manager, "dept_id").where("factory_id <> manager").select(F.col("factory_id").cast("string").alias("src"), F.col("manager").cast("string").alias("dst")),
        "MANAGES": manager.select(F.col("manager").cast("string").alias("src"), F.col("dept_id").cast("string").alias("dst")),
        "HAS_STYLE": events.select(F.col("customer_id").cast("string").alias("src"), F.col("style_id").cast("string").alias("dst")).distinct(),
        "ORDERED_BY": events.select(F.col("style_id").cast("string").alias("src"), F.col("customer_id").cast("string").alias("dst")).distinct(),
    }


def graph_stats(events: DataFrame, style_factory: DataFrame, factories: DataFrame, departments: DataFrame) -> DataFrame:
    """(kind, label, n): nodes by label, edges by relation, and the totals of both.

    What is one for one with events is counted once; what only needs to be told apart is so by keys: events by style give
    the edges between styles and their categories, customers and people, events by party the pairs of people. Numbers of
    collaborations are those of pairs, whatever styles these have in common.
    """
    e = events.select(*SEQ, "category", "customer_id", "party_from", "party_to")
    one = lambda kind, label, n: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.coalesce(n, F.lit(0)).cast("long").alias("n"))
    tell = lambda rows, *ns: rows.select(F.explode(F.array(*ns)).alias("r")).select("r.*")
    event = e.agg(F.count(F.lit(1)).alias("n"))
    who = rollups.parties(e.select("style_id", "party_from", "party_to").repartition("style_id")).groupBy("style_id", "person").agg(F.lit(1).alias("x"))
    kinds = e.groupBy("style_id", "category").agg(F.count(F.lit(1)).alias("k"))
    by_kind = kinds.groupBy("style_id").agg(F.sum(F.col("k") - 1).alias("follows"), F.lit(1).alias("x"))
    bought = e.select("style_id", "customer_id").repartition("style_id").distinct()
    met = rollups.pairs(e.select("party_from", "party_to"))
    counted = [
        tell(event, *[one("node" if n == "Event" else "edge", n, F.col("n")) for n in ("Event", "BELONGS_TO", "HAS_CATEGORY", "FROM_EMAIL")]),
        tell(by_kind.agg(F.count("x").alias("styles"), F.sum("follows").alias("f")), one("node", "Style", F.col("styles")), one("edge", "FOLLOWS", F.col("f"))),
        tell(who.agg(F.count("x").alias("n")), one("edge", "INVOLVED_IN", F.col("n"))),
        tell(bought.agg(F.count(F.lit(1)).alias("n")), one("edge", "HAS_STYLE", F.col("n")), one("edge", "ORDERED_BY", F.col("n"))),
        tell(met.agg(F.count(F.lit(1)).alias("n")), one("edge", "COLLABORATED_WITH", 2 * F.col("n"))),
    ]
    nodes = {
        "Person": rollups.parties(e.select("party_from", "party_to")).select("person").distinct(), "Category": events.select("category").distinct(),
        "Email": events.select("order_id").distinct(), "Factory": factories, "Department": departments, "Customer": events.select("customer_id").distinct(),
    }
    rest = {k: v for k, v in edges(events, style_factory, factories).items() if k in ("PARTICIPATED_IN", "PRODUCED_BY", "BELONGS_TO_DEPT", "REPORTS_TO", "MANAGES")}
    counted += [d.agg(F.lit(k).alias("kind"), F.lit(n).alias("label"), F.count(F.lit(1)).alias("n")) for k, ds in (("node", nodes), ("edge", rest)) for n, d in ds.items()]
    out = counted[0]
    for d in counted[1:]:
        out = out.unionByName(d)
    return out.rollup("kind", "label").agg(F.sum("n").alias("n")).where("kind IS NOT NULL").select("kind", F.coalesce("label", F.lit("total")).alias("label"), "n")


def neighbours(edge: DataFrame, node: Column, direction: str = "out") -> DataFrame:
    """(node, neighbour) of the edges at nodes that equal `node`; out, in or both."""
    out = edge.where(F.col("src") == node).select(F.col("src").alias("node"), F.col("dst").alias("neighbour"))
    into = edge.where(F.col("dst") == node).select(F.col("dst").alias("node"), F.col("src").alias("neighbour"))
    return {"out": out, "in": into}.get(direction, out.unionByName(into))


# node and edge merges


def overwrite_non_null(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert, or overwrite with what the new row knows."""
    return _merged(old, new, key, lambda a, b: F.coalesce(b, a))


def fill_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert, or fill only what the old row lacks."""
    return _merged(old, new, key, lambda a, b: F.coalesce(a, b))


def _merged(old: DataFrame, new: DataFrame, key: str, pick) -> DataFrame:
    a, b = old.alias("a"), new.alias("b")
    cols = [c for c in old.columns if c != key]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[pick(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in cols])


def first_writer(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """One row a key: that which was written first."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*cols), seq).alias("r")).select(key, "r.*")


def merge_edges(rows: DataFrame, props: list[str], seq: str) -> DataFrame:
    """One row for each (src, dst, rel_type): each property's last value that is not null."""
    return rows.groupBy("src", "dst", "rel_type").agg(*[F.max_by(p, F.when(F.col(p).isNotNull(), F.col(seq))).alias(p) for p in props])


# lookups


def people_by_style(person_style: DataFrame, owners: DataFrame) -> DataFrame:
    """Participants and owners of each style: an owner's role wins, one without events is there with 0."""
    joined = person_style.join(owners.withColumn("owner", F.lit(True)), ["style_id", "person"], "full")
    return joined.select("style_id", "person", F.when(F.col("owner"), "owner").otherwise("participant").alias("role"), F.coalesce("event_count", F.lit(0)).alias("event_count"))


def styles_by_person(person_style: DataFrame, owners: DataFrame, styles: DataFrame) -> DataFrame:
    return people_by_style(person_style, owners).join(styles.select("style_id", "last_update", "latest_category", "total_delay_days"), "style_id")


def find_styles(events: DataFrame, styles: DataFrame, categories: list[str], min_delay_days: int | None = None, factory: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """Styles that meet every condition given: all categories occur, delay at least so much, made by, involving.

    An empty set of candidates stays empty, it does not lift its condition.
    """
    found = styles
    if categories:
        having = events.where(F.col("category").isin(categories)).groupBy("style_id").agg(F.countDistinct("category").alias("k")).where(F.col("k") == len(set(categories)))
        found = found.join(having, "style_id", "left_semi")
    if min_delay_days is not None:
        found = found.where(F.col("total_delay_days") >= min_delay_days)
    for other in (factory, people):
        if other is not None:
            found = found.join(other, "style_id", "left_semi")
    return found


def department_styles(involved: DataFrame, members: DataFrame) -> DataFrame:
    """(dept_id, style_id, first member): styles that members take part in."""
    return members.join(involved, "person").groupBy("dept_id", "style_id").agg(F.min("person").alias("first_member"))


#: Parties that one row of a customer's sets gathers, about, and customers of a block.
GATHERED, BLOCK = 20_000, 4_096


def customer_details(events: DataFrame, style_factory: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """Three hops: a customer's styles, the people in them, their factories.

    People are told by their keys, two to a number. A style's people travel as a set, and once to each block of customers
    with neighbouring keys that has some of its customers, however many these are. There a customer's sets are united in
    parts of about `gathered` people, by a running sum; those of customers with several parts are counted by rows.
    """
    rows = events.where("style_id IS NOT NULL").select("style_id", "customer_id", "factory_id").repartition("style_id")
    sets = rows.groupBy("style_id").agg(F.collect_set("factory_id").alias("f"), F.collect_set("customer_id").alias("c"))
    parties = F.array_sort(F.concat(F.transform("f", lambda x: 2 * x), F.transform("c", lambda x: 2 * x + 1))).alias("parties")
    made = style_factory.select("style_id", F.col("factory_id").alias("maker"), F.lit(1).alias("made"))
    buyers = sets.select("style_id", "c", parties).join(made, "style_id", "left")
    by_block = lambda c: F.floor(c / BLOCK)
    split = buyers.select("style_id", "c", "parties", "maker", "made", F.explode(F.array_distinct(F.transform("c", by_block))).alias("block"))
    sent = split.select("style_id", "block", "maker", "made", "parties", F.filter("c", lambda x: by_block(x) == F.col("block")).alias("c")).repartition("block")
    own = sent.select("block", F.explode("c").alias("customer_id"), "style_id", "maker", "made", "parties")
    w = Window.partitionBy("block", "customer_id").orderBy("style_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("part", F.floor(F.coalesce(F.sum(F.size("parties")).over(w), F.lit(0)) / max(gathered, 1)))
    parts = placed.groupBy("block", "customer_id", "part").agg(F.array_distinct(F.flatten(F.collect_list("parties"))).alias("people"), F.count("made").alias("styles"), F.collect_set("maker").alias("makers"))
    alone = F.count(F.lit(1)).over(Window.partitionBy("block", "customer_id")) == 1
    told = parts.withColumn("alone", alone).withColumn("few", F.when(F.col("alone"), F.size("people")))
    person = told.select("block", "customer_id", "styles", "makers", "few", F.posexplode(F.when(F.col("alone"), F.array(F.lit(None).cast("long"))).otherwise(F.col("people"))).alias("at", "person"))
    first = lambda c: F.when(F.col("at") == 0, F.col(c))
    listed = F.array_sort(F.array_distinct(F.flatten(F.collect_list(first("makers")))))
    found = person.groupBy("block", "customer_id").agg(F.sum(first("styles")).alias("styles"), F.array_join(F.transform(listed, lambda x: x.cast("string")), ",").alias("factory_ids"), (F.coalesce(F.sum(first("few")), F.lit(0)) + F.countDistinct("person")).alias("people"))
    return found.where("styles > 0").select("customer_id", "styles", "factory_ids", "people")
