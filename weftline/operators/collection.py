"""A stored collection of vectors with metadata: an inverted file over cells, filters before any score, and an exact mode.

Vectors are dealt to the nearest of some centroids; a cell is a partition of the stored table, the metadata columns lie
beside the vectors. A search reads the cells nearest to a query, of those that hold rows which pass its filter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import MOST_QUERIES, best, dot, norm, top_k

#: Vectors that centroids are fitted on, the most centroids, and files that a cell's rows are dealt to.
SAMPLE_ROWS, MOST_CELLS, SPLITS = 50_000, 4_096, 4
#: Cells with matching rows that a query looks into, and how many matching rows they hold at least, times k.
PROBE, EXPAND = 8, 20


#: Which rows a search is about: a condition, or what leaves of a table the rows that count.
Filter = Column | Callable[[DataFrame], DataFrame] | None


def _filtered(rows: DataFrame, where: Filter) -> DataFrame:
    return rows if where is None else where(rows) if callable(where) and not isinstance(where, Column) else rows.where(where)


def usable(vec: str) -> Column:
    """Whether a vector has a direction: it is there, is not all zero and holds finite numbers only."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(vec).isNotNull() & finite & (norm(vec) > 0)


def create(rows: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None, seed: int = 42) -> VectorCollection:
    """Stores rows, all their columns, under path (rows without a direction are left out, no search finds them).

    Centroids come from k-means by cosine over at most SAMPLE_ROWS rows, drawn by a hash of the id; about the square root
    of the number of rows, if `cells` does not say how many, and never more than MOST_CELLS. Every row is in a cell. A cell
    with very many rows is dealt to SPLITS files by its ids, so no task writes a whole one. A single cell, for collections
    that are only searched exactly, needs no centroids: each task writes the rows that it has.
    """
    spark = rows.sparkSession
    kept = rows.where(usable(vec_col))
    if cells == 1:
        kept.withColumn("cell", F.lit(0)).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        some = kept.select(F.transform(vec_col, lambda x: x.cast("double")).alias("centre")).limit(1).collect()
        spark.createDataFrame([(0, some[0].centre if some else [])], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        return VectorCollection(spark, path, id_col, vec_col)
    n = kept.count()
    wanted = max(1, min(cells or round(math.sqrt(n)), MOST_CELLS, max(n, 1)))
    vector = array_to_vector(F.transform(vec_col, lambda x: x.cast("double")))
    drawn = kept.where(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(max(1, -(-n // SAMPLE_ROWS)))) == 0)
    if n:
        model = KMeans(k=wanted, seed=seed, distanceMeasure="cosine", maxIter=10, featuresCol="__v", predictionCol="cell").fit(drawn.limit(2 * SAMPLE_ROWS).select(vector.alias("__v")))
        centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        dealt = model.transform(kept.withColumn("__v", vector)).drop("__v")
    else:
        centres, dealt = [(0, [])], kept.withColumn("cell", F.lit(0))
    spark.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = dealt.repartition(parts, "cell", F.pmod(F.xxhash64(id_col), F.lit(SPLITS)))
    spread.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    return VectorCollection(spark, path, id_col, vec_col)


class VectorCollection:
    """What create() has stored, opened: only the centroids, a bounded table, are read before a search."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", vec_col: str = "embedding"):
        self.spark, self.id_col, self.vec_col = spark, id_col, vec_col
        self.rows = spark.read.parquet(f"{path}/rows") if self._has_rows(path) else None
        found = sorted(spark.read.parquet(f"{path}/centroids").collect())
        self.cells, self.centres = [r.cell for r in found], np.array([r.centre for r in found], float).reshape(len(found), -1)

    def _has_rows(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return any(f.getPath().getName().startswith("cell=") for f in fs.listStatus(at))

    def _nearest_cells(self, queries: list, k: int, where: Filter, probe: int) -> list[tuple]:
        """(query_id, cell): for each query its nearest cells among those with matching rows, until there are enough."""
        matching = _filtered(self.rows, where)
        held = {r.cell: r["count"] for r in matching.groupBy("cell").count().collect()}
        length = np.linalg.norm(self.centres, axis=1)
        out = []
        for query_id, q in queries:
            score = self.centres @ np.array(q, float) / np.where(length > 0, length, 1)
            taken = rows = 0
            for i in np.argsort(-score, kind="stable"):
                if taken >= probe and rows >= EXPAND * k:
                    break
                if n := held.get(self.cells[i]):
                    out.append((query_id, self.cells[i]))
                    taken, rows = taken + 1, rows + n
        return out

    def search(self, queries: DataFrame, k: int = 10, where: Filter = None, probe: int = PROBE, exact: bool = False, but_self: bool = False, least: float | None = None) -> DataFrame:
        """The stored columns with query_id, score (cosine) and rank of the k nearest rows that pass `where`, for each of
        at most MOST_QUERIES queries (query_id, query); ties to the smaller id.

        Matching rows are first counted by cell, from the columns that the filter names; a filter that few rows pass
        makes a query look into more cells, so it gets k rows wherever they lie. `exact` looks into all cells. Queries
        without a direction, or of another length, find nothing.
        """
        dim = self.centres.shape[1]
        asked = queries.where(usable("query") & (F.size("query") == dim))
        if self.rows is None or not dim:
            asked = asked.limit(0)
        columns = self.rows.drop("cell") if self.rows is not None else self.spark.createDataFrame([], f"{self.id_col} long, {self.vec_col} array<float>")
        matching = _filtered(columns, where)
        if exact or self.rows is None:
            return top_k(matching, asked, k, self.id_col, self.vec_col, least, but_self=but_self)
        some = [(r.query_id, r["query"]) for r in asked.limit(MOST_QUERIES + 1).collect()]
        if len(some) > MOST_QUERIES:
            raise ValueError(f"more than {MOST_QUERIES} queries at once")
        pairs = self._nearest_cells(some, k, where, probe)
        visits = self.spark.createDataFrame(pairs, f"query_id {queries.schema['query_id'].dataType.simpleString()}, cell int").join(asked.select("query_id", "query"), "query_id")
        read = self.rows.where(F.col("cell").isin(sorted({c for _, c in pairs})))
        met = _filtered(read, where).join(F.broadcast(visits), "cell").drop("cell")
        score = F.round(dot(self.vec_col, "query") / (norm(self.vec_col) * norm("query")), 6)
        return best(met.withColumn("score", score).drop("query"), k, self.id_col, least, but_self)

    def recall(self, queries: DataFrame, k: int = 10, where: Filter = None, probe: int = PROBE) -> float:
        """The share of the exact results that a search finds."""
        ids = lambda exact: self.search(queries, k, where, probe, exact).select("query_id", self.id_col)
        right = ids(True)
        n = right.count()
        return right.join(ids(False), ["query_id", self.id_col], "left_semi").count() / n if n else 1.0

