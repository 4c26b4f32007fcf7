"""Exact retrieval: filters on events, cosine top-k over stored vectors, term lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The most query vectors that go to every task.
MOST_QUERIES = 1000


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str) -> Column:
    return F.sqrt(F.aggregate(F.col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def scored(store: DataFrame, queries: DataFrame, vec: str = "embedding") -> DataFrame:
    """Every stored row against each query of a bounded table (query_id, query), which is broadcast: more than
    MOST_QUERIES are an error; tables of queries need an index. A vector without a direction has a score of 0."""
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries at once")
    q = F.broadcast(queries.withColumn("qn", norm("query")))
    pairs = store.withColumn("sn", norm(vec)).join(q, F.lit(True))
    return pairs.withColumn("score", F.round(F.coalesce(F.try_divide(dot(vec, "query"), F.col("sn") * F.col("qn")), F.lit(0.0)), 6)).drop("query", "qn", "sn")


def top_k(store: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", least: float | None = None, where: Column | None = None, but_self: bool = False) -> DataFrame:
    """k nearest by cosine for each query; filters on the store come before any score."""
    return best(scored(store if where is None else store.where(where), queries, vec), k, id_col, least, but_self)


def best(rows: DataFrame, k: int, id_col: str, least: float | None = None, but_self: bool = False) -> DataFrame:
    """The k rows of the highest score for each query, ties to the smaller id."""
    rows = rows.where(F.col(id_col) != F.col("query_id")) if but_self else rows
    rows = rows if least is None else rows.where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), id_col))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def two_stage(store: DataFrame, queries: DataFrame, key: str, k: int, floor: float = 0.75) -> DataFrame:
    """Nearest rows, kept if they have the query's key or a score above the floor."""
    return top_k(store, queries, k).where((F.col(key) == F.col(f"query_{key}")) | (F.col("score") > floor))


def time_decayed(rows: DataFrame, age_days: Column, half_life: float = 30.0) -> DataFrame:
    return rows.withColumn("decayed", F.col("score") * F.exp(-F.log(F.lit(2.0)) * age_days / half_life))


def recent(events: DataFrame, now: Column, days: int, date: str = "date") -> DataFrame:
    """Rows whose date parses and is at most so many days before now; none is too late."""
    return events.where(F.try_to_date(date) >= F.date_sub(now, days))


def by_conditions(events: DataFrame, styles=None, categories=None, event_types=None, min_delay_days=None, start=None, end=None) -> DataFrame:
    """All conditions at once. A missing delay is 0; a missing date fails a start and passes an end."""
    out = events
    for column, values in (("style_id", styles), ("category", categories), ("event_type", event_types)):
        if values:
            out = out.where(F.col(column).isin(values))
    if min_delay_days is not None:
        out = out.where(F.coalesce("delay_days", F.lit(0)) >= min_delay_days)
    raw = "shipped" in events.columns  # the stored date, by which files and row groups can be left out
    if start:
        out = out.where(F.coalesce("date", F.lit("")) >= start)
        out = out.where(F.col("shipped") >= F.lit(start).cast("date")) if raw else out
    if end:
        out = out.where(F.coalesce("date", F.lit("")) <= end)
        out = out.where(F.col("shipped").isNull() | (F.col("shipped") < F.date_add(F.lit(end).cast("date"), 1))) if raw else out
    return out


def hashing_encoder(dim: int = 64):
    """A deterministic offline text encoder: hashed character trigrams, normalised; as a column expression."""

    def encode(text: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substring(F.lower(text), i, F.lit(3))), F.lit(dim)))
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(grams, lambda g: g == d)).cast("float"))

    return encode


def batch_translate(terms: DataFrame, wanted: DataFrame, missing: str = "未找到") -> DataFrame:
    """One translation for each wanted term: exact by lower case, else the default with confidence 0."""
    t = terms.groupBy(F.lower("term").alias("k")).agg(F.min("translation").alias("translation"))
    return wanted.join(t, F.lower("wanted") == F.col("k"), "left").select("wanted", F.coalesce("translation", F.lit(missing)).alias("translation"), F.when(F.col("k").isNull(), 0.0).otherwise(1.0).alias("confidence"))


def person_by_email(users: DataFrame, email: str) -> DataFrame:
    """The user with this address, whatever its case; the first by user_id if several have it."""
    return users.where(F.lower("email") == email.lower()).orderBy("user_id").limit(1)


def attached(records: DataFrame, events: str, source: list[str]) -> DataFrame:
    """Each event of a record's array, with the columns that tell where it comes from."""
    return records.select(*source, F.inline(events))


def owned(rows: DataFrame, **owner) -> DataFrame:
    """Rows of one user, session or role; an owner that is not known owns nothing."""
    for column, value in owner.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows
