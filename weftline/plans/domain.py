"""The domain model over the driver's star schema: events, people, departments, factories and customers.

An event is a line of an order. Its input order (`seq`) is (order, line, item, supplier), unique and stable; nothing here
numbers all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEQ = ("order_id", "line", "style_id", "factory_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(col):
    return F.date_format(col, "yyyy-MM-dd")


def events(spark: SparkSession, sf_dir: str, names: bool = True) -> DataFrame:
    """The fact table. Date columns are 'YYYY-MM-DD' text, `shipped` the date that is filtered where it is read; delay_days
    is signed; confidence is in hundredths. Without names party_from and party_to are left out, and with them two joins
    that a plan would have to make whatever it asks for."""
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    parties = []
    if names:  # names come to an order before its lines do, so that lines are dealt out twice, not three times
        supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
        line, order = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")), order.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        parties = [F.col("s_name").alias("party_from"), F.col("c_name").alias("party_to")]
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").cast("long").alias("style_id"),
        F.col("l_orderkey").cast("long").alias("order_id"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_suppkey").cast("long").alias("factory_id"),
        F.col("o_custkey").cast("long").alias("customer_id"),
        F.concat("l_returnflag", "l_linestatus").alias("category"),
        F.col("o_orderpriority").alias("event_type"),
        day("l_shipdate").alias("date"),
        F.col("l_shipdate").alias("shipped"),
        day("o_orderdate").alias("related_date"),
        F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("long").alias("delay_days"),
        *parties,
        F.round(100 - 600 * F.col("l_discount")).cast("long").alias("confidence"),
    )


def style_factory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(style_id, factory_id): one factory an item, that with the smallest key."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("long").alias("style_id")).agg(F.min("l_suppkey").cast("long").alias("factory_id"))


def factories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("factory_id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("dept_id"))


def departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("dept_id"), F.col("n_name").alias("dept"))


#: The same model as DuckDB SQL, to begin every oracle with.
CTE = """
WITH ev AS (
  SELECT l_partkey AS style_id, l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line, l_suppkey AS factory_id, o_custkey AS customer_id,
    l_returnflag || l_linestatus AS category, o_orderpriority AS event_type, strftime(l_shipdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%Y-%m-%d') AS related_date,
    CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS BIGINT) AS delay_days, s_name AS party_from, c_name AS party_to,
    CAST(round(100 - 600 * l_discount) AS BIGINT) AS confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
), sf AS (SELECT l_partkey AS style_id, min(l_suppkey) AS factory_id FROM lineitem GROUP BY 1
), styles AS (
  SELECT style_id, min(date) AS first_event_date, max(date) AS last_update, count(*) AS event_count, CAST(count(*) FILTER (delay_days <> 0) AS BIGINT) AS delay_event_count,
    CAST(count(*) FILTER (delay_days > 0) AS BIGINT) AS late_event_count, CAST(sum(delay_days) AS BIGINT) AS total_delay_days, CAST(coalesce(sum(delay_days) FILTER (delay_days > 0), 0) AS BIGINT) AS late_days,
    first(category ORDER BY date DESC, order_id, line, factory_id) AS latest_category, CAST(count(DISTINCT order_id) AS BIGINT) AS order_count
  FROM ev GROUP BY style_id
)"""


#: A mark that texts do not hold, put where a word begins or ends: DuckDB's own word boundaries are ASCII.
BOUND = "\ue000"
_WORD, _OTHER = r"[\p{L}\p{M}\p{Nd}\p{Pc}]", r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"


def bounded(text: str) -> str:
    """SQL for a text with a mark at each word boundary."""
    ended = f"regexp_replace(' ' || {text} || ' ', '({_WORD})({_OTHER})', '\\1{BOUND}\\2', 'g')"
    return f"regexp_replace({ended}, '({_OTHER})({_WORD})', '\\1{BOUND}\\2', 'g')"
