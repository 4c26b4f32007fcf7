"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col

#: Words as the mix counts them.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Parts that documents of one source and size are dealt into: no task orders all copies of a text.
DEAL = 256


def words(text_col: str = "text"):
    return F.coalesce(F.regexp_count(col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _key(id_col: str):
    """A fixed pseudo-random order of documents."""
    return F.md5(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary"))


def _offset():
    """One pseudo-random offset in [0, 1) a source, in steps of 2^-20."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("offset:"), F.coalesce(F.col("source"), F.lit(""))).cast("binary")), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes(source, source_size) with target: share of all sizes, dealt by weight, at most `most` times a source's size.

    Weights repeat in the order of the sources' code points, null last. What a source cannot take is dealt again by
    weight until none is above its limit: with sources ordered by limit over weight, a prefix gets its limit and the
    rest divide what is left. The table has a row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("limit", F.lit(most) * F.col("source_size"))
    fill = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    leveled = ranked.withColumn("level", level).withColumn("full", F.col("limit") <= F.col("w") * F.col("level"))
    open_level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.withColumn("open", open_level).select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(F.col("w") * F.col("open")).alias("target"))


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """row, a struct of all columns of df, with size, source_size, target and copies, the times that the mix emits the row.

    Every document of a source is expected target / source_size times. Within a source documents are ordered by size,
    then pseudo-randomly by their id; the running sum of what is expected, plus the source's one offset, passes an
    integer `copies` times at a document. Ordered by size, whole copies stray from what is expected by about the largest
    document of the source at most. The running sum needs no task that holds a source: documents are dealt by source,
    size and the first digits of their pseudo-random key; offsets of sizes, then of deals, come from counts alone.
    Null and empty texts have size 0. A null source is a source, the last. Rows that repeat source, size and id are
    ordered arbitrarily among themselves, which changes no figure. Reruns agree. Columns of any name pass inside `row`.
    An empty table gives an empty result.
    """
    base = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), col(source_col).cast("string").alias("source"), words(text_col).alias("size"), _key(id_col).alias("key"))
    base = base.withColumn("deal", F.conv(F.substring("key", 1, 2), 16, 10).cast("int"))
    name = F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()
    base = base.withColumn("s0", name[0]).withColumn("s1", name[1])

    cells = base.groupBy("s0", "s1", "source", "size", "deal").agg(F.count(F.lit(1)).alias("n"))
    by_size = cells.groupBy("s0", "s1", "source", "size").agg(F.sum("n").alias("n"))
    totals = by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    aims = targets(totals, share, most, weights).withColumn("offset", _offset())
    aims = aims.select(F.coalesce("source", F.lit("")).alias("s0"), F.col("source").isNull().alias("s1"), "source_size", "target", "offset")
    ahead = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sized = by_size.select("s0", "s1", "size", F.coalesce(F.sum("n").over(ahead("s0", "s1", "size")), F.lit(0)).alias("smaller")).join(aims, ["s0", "s1"])
    dealt = cells.select("s0", "s1", "size", "deal", F.coalesce(F.sum("n").over(ahead("s0", "s1", "size", "deal")), F.lit(0)).alias("earlier")).join(sized, ["s0", "s1", "size"])

    own = base.withColumn("at", F.row_number().over(Window.partitionBy("s0", "s1", "size", "deal").orderBy("key")))
    joined = own.join(dealt, ["s0", "s1", "size", "deal"])
    place = F.col("smaller") + F.col("earlier") + F.col("at")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    times = F.floor(F.col("offset") + place * rate) - F.floor(F.col("offset") + (place - 1) * rate)
    return joined.select("row", "size", "source_size", "target", F.least(times, F.ceil(rate)).cast("long").alias("copies"))


def mix(df: DataFrame, **how) -> DataFrame:
    """The rows of df, each as often as copies() says, with df's columns and no others."""
    found = copies(df, **how).where("copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
