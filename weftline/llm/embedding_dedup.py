"""Near-duplicate vectors: randomised-rotation binary codes bound every inner product, few pairs are computed exactly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship
from .components import components
from .hnsw import pack, unpack
from .unionfind import forest
from .vectors import dimension, matrix, usable

#: Vectors that a block holds on average and at most on average, the pivots of a level that vectors gather around (a
#: bounded sample), the least number of code bits, and the standard errors that a confidence bound allows.
BLOCK_ROWS, MOST_ROWS, MOST_PIVOTS, LEAST_BITS, ERRORS = 4096, 8192, 1024, 128, 5.0
#: Vectors that one task places around the pivots of a cell.
PLACE_ROWS = 32768


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = 42) -> np.ndarray:
    """dim orthonormal rows in as many dimensions as a code has bits: a random rotation of the padded vector."""
    bits = max(LEAST_BITS, -(-dim // 64) * 64)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return np.ascontiguousarray(q[:dim]).astype(np.float32)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.sqrt((v * v).sum(1))[:, None]


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the rotated unit vectors, packed, and the correction factor of each: its inner product with its code."""
    turned = unit.astype(np.float32) @ rotation(unit.shape[1])
    factor = np.abs(turned).sum(1) / np.sqrt(turned.shape[1])
    return np.packbits(turned >= 0, axis=1), factor.astype(np.float32)


def estimates(codes: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of inner products of coded vectors with rotated ones, and each code's bound on its error."""
    bits = turned.shape[1]
    signs = np.unpackbits(codes, axis=1)[:, :bits].astype(np.float32) * 2 - 1
    estimate = (signs @ turned.T) / (np.sqrt(bits) * factors)[:, None]
    bound = ERRORS * np.sqrt(np.maximum(1 - factors**2, 0) / factors**2 / (bits - 1))
    return estimate, bound


def _cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs of unit vectors, each added up in one way whatever the other pairs."""
    return np.concatenate([np.empty(0), *((x[i[k : k + 65536]] * y[j[k : k + 65536]]).sum(1) for k in range(0, len(i), 65536))])


def tile(left: dict[str, np.ndarray], right: dict[str, np.ndarray], least: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links with cosine >= least between two blocks: for each vector the weight it is linked to, and a spanning forest."""
    x, y = _unit(left["vec"]), _unit(right["vec"])
    turned = y.astype(np.float32) @ rotation(y.shape[1])
    near_x, near_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    trees = [(np.empty(0, np.int64),) * 2]
    for at in range(0, len(x), 256):
        rows = slice(at, at + 256)
        estimate, bound = estimates(left["codes"][rows], left["factors"][rows], turned)
        unsure = estimate + bound[:, None] >= least
        if same:
            np.fill_diagonal(unsure[:, at:], False)
        i, j = np.nonzero(unsure)
        if not len(i):
            continue
        if len(i) > unsure.size // 8:
            cos = (x[rows] @ y.T)[i, j]  # right to about 1e-15: pairs any nearer to `least` than 1e-9 are added up one by one
            maybe = cos >= least - 1e-9
            i, j, cos = i[maybe], j[maybe], cos[maybe]
            close = cos <= least + 1e-9
            cos[close] = _cosines(x, y, i[close] + at, j[close])
        else:
            cos = _cosines(x, y, i + at, j)
        i, j = i[cos >= least] + at, j[cos >= least]
        near_x += np.bincount(i, weights=right["weight"][j], minlength=len(x)).astype(np.int64)
        if not same:
            near_y += np.bincount(j, weights=left["weight"][i], minlength=len(y)).astype(np.int64)
        trees.append(forest(left["ids"][i], right["ids"][j]))
    a, b = forest(*(np.concatenate(t) for t in zip(*trees, strict=True)))
    return near_x, near_y, a, b


def _pack_block(table: pa.Table) -> pa.Table:
    unit = _unit(matrix(table["vec"], np.float64))
    codes, factors = encode(unit)
    centre = unit.mean(0)
    centre /= np.sqrt((centre * centre).sum()) or 1.0
    reach = float(np.arccos(np.clip(unit @ centre, -1, 1)).max())
    stored = matrix(table["vec"], np.float32 if table.schema.field("vec").type.value_type == pa.float32() else np.float64)
    data = pack(vec=stored, codes=codes, factors=factors, ids=table["rep"].to_numpy(), weight=table["weight"].to_numpy())
    place = {c: table[c].slice(0, 1) for c in _PLACE}
    return pa.table({**place, "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "reach": [reach], "data": pa.array([data], pa.binary())})


def _tiles(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(i)[r].as_py() for i, n in enumerate(batch.schema.names)}
                x, y = unpack(row["left"]), unpack(row["right"])
                near_x, near_y, a, b = tile(x, y, least, row["same"])
                ids = np.concatenate([x["ids"][near_x > 0], y["ids"][near_y > 0], a])
                other = np.concatenate([np.zeros(int((near_x > 0).sum() + (near_y > 0).sum()), np.int64), b])
                n = np.concatenate([near_x[near_x > 0], near_y[near_y > 0], np.zeros(len(a), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(other), pa.array(n)], ["a", "b", "n"])

    return run


#: Where a block is: its cell, the cell within that, and its number there.
_PLACE = ["cell", "inner", "sub"]


def _by_pivot(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(0), np.float64)
            cell = (v @ pivots.T).argmax(1).astype(np.int32) if len(v) else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec", "rep", "weight", "cell"])

    return run


def _by_inner_pivot(left: pa.Table, right: pa.Table) -> pa.Table:
    """Vectors of a large cell, some at a time, and the cell's own pivots."""
    inner = np.zeros(len(left), np.int32)
    if len(left) and len(right):
        pivots = _unit(np.array(right["pivots"][0].as_py(), np.float64))
        inner = (_unit(matrix(left["vec"], np.float64)) @ pivots.T).argmax(1).astype(np.int32)
    return left.select(["vec", "rep", "weight", "cell"]).append_column("inner", pa.array(inner))


def _placed(distinct: DataFrame, n: int, vec_type: str) -> tuple[DataFrame, np.ndarray]:
    """(vec, rep, weight, cell, inner) of every vector, and the unit pivots of the cells: each vector is with the pivot
    that it is nearest to. Cells that hold more than blocks should have pivots of their own, so that blocks stay compact
    up to MOST_PIVOTS squared of them."""
    first = distinct.orderBy(F.xxhash64(F.lit(11), "rep"), "rep").limit(min(MOST_PIVOTS, -(-n // BLOCK_ROWS)))
    pivots = _unit(np.array([r[0] for r in first.select("vec").collect()], np.float64))
    rows = cut(distinct.select("vec", "rep", "weight").mapInArrow(_by_pivot(pivots), f"vec {vec_type}, rep long, weight long, cell int"))
    large = cut(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_ROWS))  # a row a pivot at most
    if large.isEmpty():
        return rows.withColumn("inner", F.lit(0)), pivots
    inside = rows.join(F.broadcast(large), "cell")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(12), "rep"), "rep"))
    sample = inside.select("cell", "vec", "n", "rep").withColumn("r", rank).where((F.col("r") <= MOST_PIVOTS) & (F.col("r") <= F.ceil(F.col("n") / BLOCK_ROWS)))
    own = sample.groupBy("cell", "n").agg(F.collect_list("vec").alias("pivots"))
    tasks = F.ceil(F.col("n") / PLACE_ROWS).cast("int")
    left = inside.withColumn("task", F.pmod(F.xxhash64(F.lit(13), "rep"), tasks).cast("int")).drop("n")
    right = own.select(F.col("cell").alias("cell"), F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"), "pivots")
    again = left.groupBy("cell", "task").cogroup(right.groupBy("cell", "task")).applyInArrow(_by_inner_pivot, f"vec {vec_type}, rep long, weight long, cell int, inner int")
    small = rows.join(F.broadcast(large), "cell", "left_anti").withColumn("inner", F.lit(0))
    return cut(again.unionByName(small)), pivots


def _angles(pivots: np.ndarray):
    """Each block's cell, and the angle that its furthest vector may have to the cell's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, reach = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            dot = (matrix(batch.column(1), np.float64) * pivots[cell]).sum(1) if len(cell) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arccos(np.clip(dot, -1, 1)) + reach)], ["cell", "reach"])

    return run


def _near_blocks(blocks: DataFrame, pivots: np.ndarray, apart: float) -> DataFrame:
    """Pairs of blocks (places a and b) that may hold a link. Cells are ruled out in pairs first, a row a pivot on the
    driver; then the blocks of the cells that are left."""
    reach = {r[0]: r[1] for r in blocks.select("cell", "centre", "reach").mapInArrow(_angles(pivots), "cell int, reach double").groupBy("cell").agg(F.max("reach")).collect()}
    far = np.array([reach.get(c, -np.inf) for c in range(len(pivots))])
    angle = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    one, two = np.nonzero(np.triu((angle <= far[:, None] + far[None, :] + apart) | np.eye(len(pivots), dtype=bool)))
    cells = blocks.sparkSession.createDataFrame(pa.table({"a_cell": pa.array(one, pa.int32()), "b_cell": pa.array(two, pa.int32())}))
    side = lambda s: blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in (*_PLACE, "centre", "reach")])
    met = side("a").join(cells, "a_cell").join(side("b"), "b_cell")
    dot = F.aggregate(F.zip_with("a_centre", "b_centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    same = F.struct("a_inner", "a_sub") == F.struct("b_inner", "b_sub")
    once = (F.col("a_cell") < F.col("b_cell")) | (F.struct("a_inner", "a_sub") <= F.struct("b_inner", "b_sub"))
    near = ((F.col("a_cell") == F.col("b_cell")) & same) | (F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0))) <= F.col("a_reach") + F.col("b_reach") + apart)
    return met.where(once & near).select(*[f"{s}_{c}" for s in "ab" for c in _PLACE], ((F.col("a_cell") == F.col("b_cell")) & same).alias("same"))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row: rows are linked if their cosine, in double, is at least `least`.

    Identical vectors are one, with a weight. Vectors gather around pivots (a bounded sample of the vectors), those of a
    large cell around pivots of its own; every vector is in a block, packed with its code. Cells, then blocks, whose
    centres lie further apart than their reaches and the angle of `least` allow are skipped in pairs, which loses
    nothing. In the others every
    pair is estimated from one side's code; a pair whose upper confidence bound of five standard errors is below `least`
    is dropped, the rest are computed exactly, so no link is below `least`. A tile returns sums and a spanning forest, at
    most a row a vector however dense it is. component_id is the smallest id that links reach, kept its own id being it.
    Vectors that are null, empty, zero or hold null or non-finite components, or have another number of components
    than the commonest, link with nothing; rows without an id neither, and get no component. Rows that repeat an id and
    a vector count as copies.
    """
    spark = df.sparkSession
    ship(spark)
    dim = dimension(df, vec_col)
    fits = usable(vec_col) & (F.size(vec_col) == dim) & F.col(id_col).isNotNull()
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fits, F.col(vec_col)).alias("vec"))
    distinct = cut(rows.where("vec IS NOT NULL").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")))
    n = distinct.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    placed, pivots = _placed(distinct, n, df.schema[vec_col].dataType.simpleString())
    cells = placed.groupBy("cell", "inner").agg(F.ceil(F.count(F.lit(1)) / MOST_ROWS).cast("int").alias("subs"))
    placed = placed.join(cells, ["cell", "inner"]).withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int"))
    packed = cut(placed.groupBy(*_PLACE).applyInArrow(_pack_block, "cell int, inner int, sub int, centre array<double>, reach double, data binary"))
    pairs = _near_blocks(packed.drop("data"), pivots, float(np.arccos(np.clip(least, -1, 1))) + 1e-6)
    for side, name in (("a", "left"), ("b", "right")):
        pairs = pairs.join(packed.select(*[F.col(c).alias(f"{side}_{c}") for c in _PLACE], F.col("data").alias(name)), [f"{side}_{c}" for c in _PLACE])
    found = cut(pairs.select("same", "left", "right").mapInArrow(_tiles(least), "a long, b long, n long"))

    linked = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("near"))
    groups = components(found.where("n = 0").select("a", "b")).withColumnRenamed("node", "rep")
    told = distinct.join(linked, "rep", "left").join(groups, "rep", "left").select("vec", (F.coalesce("near", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    matched = rows.where("vec IS NOT NULL").join(told, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where("vec IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return matched.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
