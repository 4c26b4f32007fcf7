"""Shards by a two-pass external shuffle, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, partitions, text_bytes

#: Bytes of text that one bucket, held in memory by one task, takes on average.
BUCKET_BYTES = 8 << 20


def _scatter(buckets: int, text_col: str, id_col: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), col(id_col), _crc(text_col), col(text_col).isNull()), F.lit(buckets))


def _crc(text_col: str) -> Column:
    return F.crc32(F.coalesce(col(text_col), F.lit("")).cast("binary"))


def _ordered(rows: str, orderable: bool) -> Column:
    """Rows by id, text and then all columns; by a hash of all columns where maps, which have no order, are among them."""
    if orderable:
        return F.array_sort(rows)
    key = lambda r: F.struct(r["k0"], r["k1"], F.xxhash64(F.to_json(r["row"])))
    return F.array_sort(rows, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))


def shuffle_into_shards(df: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """All columns and rows of df with shard and slot (or other names): a seeded random order dealt into shards whose sizes differ by a row at most.

    First pass: a seeded hash of the id and the text scatters rows uniformly into buckets that fit in memory. Second
    pass: each bucket is put into a canonical order and shuffled (Fisher-Yates, seeded). A row's place in the whole order
    is its bucket's offset, a running sum over the buckets' counts, plus its place in the bucket; shard = place mod
    shards, slot = place div shards, so slots are gapless from 0. Groups of equal texts scatter by their ids. Only rows
    that repeat both id and text share a bucket for certain. A column of df that has one of the two names is replaced;
    give other names to keep it. Null texts and ids are values like any other; an empty table gives an empty result. The
    same rows with the same settings and number of partitions give the same shards.
    """
    df = df.select(*[col(c) for c in df.columns if c not in names])
    parts = partitions(df.sparkSession)
    total = df.agg(F.sum(text_bytes(text_col) + 1)).first()[0] or 0
    buckets = max(4 * parts, -(-total // bucket_bytes))
    bucket = _scatter(buckets, text_col, id_col, seed)

    counts = df.select(bucket.alias("bucket")).groupBy("bucket").count()
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))

    scattered = df.select(bucket.alias("bucket"), F.struct(col(id_col).alias("k0"), _crc(text_col).alias("k1"), F.struct(*[col(c) for c in df.columns]).alias("row")).alias("r"))
    held = scattered.repartition(parts, "bucket").groupBy("bucket").agg(F.collect_list("r").alias("rows")).sortWithinPartitions("bucket")
    mixed = held.select("bucket", F.shuffle(_ordered("rows", "map<" not in df.schema.simpleString()), seed).alias("rows"))
    placed = mixed.join(offsets, "bucket").select("start", F.posexplode("rows").alias("at", "r")).withColumn("place", F.col("start") + F.col("at"))
    return placed.select("r.row.*", (F.col("place") % shards).cast("int").alias(names[0]), F.floor(F.col("place") / shards).cast("long").alias(names[1]))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet a shard, rows in the order of their slots within each file."""
    sharded.repartition(partitions(sharded.sparkSession), "shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
