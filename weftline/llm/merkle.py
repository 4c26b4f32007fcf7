"""A Merkle manifest of a table: a tree for each group, a tree over the groups, and for every row a proof of inclusion.

Leaves of a group ascend by id; at each level every two consecutive nodes become the digest of their digests, a last one
alone the digest of its own, until one remains. Leaves are parted into aligned blocks of 2^HEIGHT, whose inner nodes
depend on no other block: a task walks a block recursively in postorder, returns its digest and appends siblings to the
leaves below while unwinding. The blocks' digests are the leaves of another such traversal, until a block is the group.

A proof is a byte string of steps from the leaf up: a byte NONE, LEFT or RIGHT (where the sibling stands), then the
sibling's 32 bytes unless there is none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import col, fresh_path, partitions, renamed_columns, ship

#: Levels of a block: 4,096 leaves.
HEIGHT = 12
NONE, LEFT, RIGHT = b"\0", b"\1", b"\2"


def leaf(fields: tuple[str, ...], changed: dict[str, Column] | None = None) -> Column:
    """The digest of a row: of each field its UTF-8 byte count, a colon and its value, or a dash for null. Integers are
    decimal; other values are as a cast to text gives them, one after another. `changed` replaces values; a null one stays null."""
    parts = []
    for name in fields:
        text = (changed or {}).get(name, col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def digest(*nodes: bytes) -> bytes:
    """The digest of digests, which are taken as lowercase hex text."""
    return hashlib.sha256(b"".join(n.hex().encode() for n in nodes)).digest()


def walk(leaves: list[bytes], height: int) -> tuple[bytes, list[bytearray]]:
    """The digest of a block of at most 2^height leaves after `height` levels, and each leaf's siblings on the way."""
    proofs = [bytearray() for _ in leaves]

    def subtree(lo: int, levels: int) -> bytes:
        if not levels:
            return leaves[lo]
        half = 1 << (levels - 1)
        left = subtree(lo, levels - 1)
        if lo + half >= len(leaves):
            for i in range(lo, len(leaves)):
                proofs[i] += NONE
            return digest(left)
        right = subtree(lo + half, levels - 1)
        for i in range(lo, lo + half):
            proofs[i] += RIGHT + right
        for i in range(lo + half, min(lo + 2 * half, len(leaves))):
            proofs[i] += LEFT + left
        return digest(left, right)

    return subtree(0, height), proofs


def levels_of(n: int) -> int:
    """Levels until one of n nodes remains."""
    return max(0, n - 1).bit_length()


def _walk_group(height: int):
    """Rows (g, block, blocks, place, node) of one block with their siblings and the block's digest. The only block of its
    group is walked until one node remains, any other to the block's height."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        levels = levels_of(len(rows)) if rows["blocks"][0].as_py() == 1 else height
        top, proofs = walk(rows["node"].to_pylist(), levels)
        return rows.append_column("top", pa.array([top] * len(rows), pa.binary())).append_column("path", pa.array([bytes(p) for p in proofs], pa.binary()))

    return run


def _numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with place, the row's number from 0 within its group by these columns. Rows are dealt by range over group and
    order, and numbered in each part on top of the parts before: no task holds a group. The result is stored."""
    spark = df.sparkSession
    key = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    dealt = df.repartitionByRange(partitions(spark), *key).sortWithinPartitions(*key)
    schema = StructType([*df.schema.fields, *renamed_columns(df, {}, "part int, at long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, n = TaskContext.get().partitionId(), (), 0
        for batch in batches:
            at = []
            for g in batch.column(batch.schema.get_field_index(group)).to_pylist():
                now, n = ((g,), 0) if now != (g,) else (now, n + 1)
                at.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(batch), pa.int32()), pa.array(at, pa.int64())], schema.names)

    path = fresh_path(spark, "numbered")
    dealt.mapInArrow(run, schema).write.parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    cells = stored.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(group).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = cells.select(F.col(group).alias("__g"), F.col("part").alias("__part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"), F.sum("n").over(everything).alias("size"))
    joined = stored.join(starts, stored[group].eqNullSafe(F.col("__g")) & (stored["part"] == F.col("__part")))
    return joined.withColumn("place", F.col("__start") + F.col("at")).drop("__g", "__part", "__start", "part", "at")


def _traverse(nodes: DataFrame, height: int) -> DataFrame:
    """nodes (g, place, size, node, ...) with root, their group's, and path, the siblings up to it.

    One traversal a level of blocks; each one's blocks are stored, and the next has 2^height times fewer nodes. A block
    then joins the path of its digest, so a row's path grows from below.
    """
    spark = nodes.sparkSession
    width = 1 << height
    blocks = F.ceil(F.col("size") / F.lit(width)).cast("long")
    placed = nodes.withColumn("block", F.floor(F.col("place") / F.lit(width)).cast("long")).withColumn("blocks", blocks)
    schema = StructType([*placed.schema.fields, *renamed_columns(placed, {}, "top binary, path binary").fields])
    path = fresh_path(spark, "blocks")
    placed.groupBy("g", "block").applyInArrow(_walk_group(height), schema).write.parquet(path)
    walked = spark.read.schema(schema).parquet(path)
    done = walked.where("blocks = 1")
    more = walked.where("blocks > 1")
    tops = more.where(F.col("place") % width == 0).select("g", F.col("block").alias("place"), F.col("blocks").alias("size"), F.col("top").alias("node"))
    own = [c for c in nodes.columns]
    finished = done.select(*own, F.col("top").alias("root"), "path")
    if tops.isEmpty():
        return finished
    above = _traverse(tops, height).select(F.col("g").alias("__g"), F.col("place").alias("__block"), "root", F.col("path").alias("__above"))
    joined = more.join(above, more["g"].eqNullSafe(F.col("__g")) & (more["block"] == F.col("__block")))
    return finished.unionByName(joined.select(*own, "root", F.concat("path", "__above").alias("path")))


def proofs(leaves: DataFrame, keep: tuple[str, ...] = (), id_col: str = "doc_id", group_col: str = "lang", leaf_col: str = "leaf", height: int = HEIGHT) -> DataFrame:
    """id_col, group_col, leaf_col and `keep` of every row with subroot, root (lowercase hex) and proof, the steps from leaf to root.

    Leaves (lowercase hex) of a group ascend by id, null first, rows that repeat an id by their leaves; groups ascend
    bytewise, null first. Neither a group nor all groups, however large, meet in a task: rows are numbered by range, equal
    ones apart too, and a task holds a block of 2^height digests. Every step is stored in the shared folder before the
    next reads it. An empty table has no tree and gives an empty result.
    """
    spark = leaves.sparkSession
    ship(spark)
    taken = leaves.select(col(id_col).alias("id"), col(group_col).alias("g"), F.unhex(col(leaf_col)).alias("node"), *[col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    path = fresh_path(spark, "leaves")
    taken.withColumn("tie", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.schema(StructType([*taken.schema.fields, *renamed_columns(taken, {}, "tie long").fields])).parquet(path)
    inside = _traverse(_numbered(stored, "g", ["id", "node", "tie"]), height)
    tops = inside.where("place = 0").select(F.lit(0).alias("g"), F.col("g").alias("lang"), F.col("root").alias("node"))
    over = _traverse(_numbered(tops, "g", ["lang"]), height).select(F.col("lang").alias("__lang"), F.col("node").alias("subroot"), F.col("root").alias("whole"), F.col("path").alias("__above"))
    joined = inside.join(over, inside["g"].eqNullSafe(F.col("__lang")))
    hexed = lambda c: F.lower(F.hex(c))
    return joined.select(
        F.col("id").alias(id_col), F.col("g").alias(group_col), hexed("node").alias(leaf_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        hexed("subroot").alias("subroot"), hexed("whole").alias("root"), F.concat("path", "__above").alias("proof"),
    )


def steps(proof: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(side, sibling) of each level; a level without a sibling has side NONE."""
    at = 0
    while at < len(proof):
        side = proof[at : at + 1]
        yield side, proof[at + 1 : at + 33] if side != NONE else b""
        at += 1 if side == NONE else 33


def folded(node: bytes, proof: bytes) -> bytes:
    """What a leaf comes to with the siblings of its proof."""
    for side, sibling in steps(proof):
        node = digest(node) if side == NONE else digest(sibling, node) if side == LEFT else digest(node, sibling)
    return node


def fold(proven: DataFrame, leaf_now: Column | None = None) -> DataFrame:
    """proven (of proofs()) with proof_sha256, the digest of the proof's siblings, and folded_root, what leaf_now (the
    proven leaf, if none) comes to with them: it equals root only if the row is what it was."""
    ship(proven.sparkSession)
    df = proven.withColumn("__now", F.unhex(F.col("leaf") if leaf_now is None else leaf_now))
    schema = StructType([*df.drop("__now").schema.fields, *renamed_columns(df, {}, "proof_sha256 string, folded_root string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, now = batch.column("proof").to_pylist(), batch.column("__now").to_pylist()
            siblings = [digest(*(s for side, s in steps(p) if side != NONE)).hex() for p in paths]
            roots = [folded(n, p).hex() for n, p in zip(now, paths, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(siblings, pa.string()), pa.array(roots, pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def verify(rows: DataFrame, proven: DataFrame, fields: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """Rows of a table as they are now against the manifest's: id_col and verified, false also for rows that it has not.
    An id that repeats in either is held against each of the other's."""
    now = rows.select(col(id_col).alias("__id"), leaf(fields).alias("now"))
    told = proven.select(col(id_col).alias("__known"), "leaf", "proof", "root")
    joined = now.join(told, F.col("__id").eqNullSafe(F.col("__known")), "left")
    checked = fold(joined.where("proof IS NOT NULL"), F.col("now")).select(F.col("__id").alias(id_col), (F.col("folded_root") == F.col("root")).alias("verified"))
    return checked.unionByName(joined.where("proof IS NULL").select(F.col("__id").alias(id_col), F.lit(False).alias("verified")))
