"""Approximate nearest neighbours: one graph a shard, shard results merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship
from .hnsw import Graph, build, graph_arrays, pack, search, unpack
from .vectors import dimension, matrix, usable

#: Distinct vectors that one graph holds on average, queries that walk a graph together, and such blocks a graph's trip.
SHARD_ROWS, QUERY_ROWS, TRIP_BLOCKS = 8192, 512, 16


def _index(table: pa.Table) -> pa.Table:
    v = matrix(table["vec"])
    g, order = build(v)
    copies = table["copies"].to_pylist()
    copies = [copies[i] for i in order.tolist()]
    exact = matrix(table["vec"], np.float64)[order]
    data = pack(**graph_arrays(g), exact=exact, copies=np.array([x for c in copies for x in c], np.int64), ends=np.cumsum([len(c) for c in copies]))
    return pa.table({"shard": table["shard"].slice(0, 1), "graph": pa.array([data], pa.binary())})


def build_index(df: DataFrame, id_col: str, vec_col: str, copies: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, graph): a graph of the distinct usable vectors of each shard, with the smallest ids of each vector's copies.

    A vector with any number of copies is one node; of its ids the smallest `copies` are kept, more than a result holds.
    They are found by a ranking that is limited before and after its shuffle. Shards are dealt by the vectors' hashes.
    """
    ship(df.sparkSession)
    dim = dimension(df, vec_col)
    rows = df.where(usable(vec_col) & (F.size(vec_col) == dim) & F.col(id_col).isNotNull()).select(F.col(vec_col).alias("vec"), F.col(id_col).cast("long").alias("id"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= copies)
    distinct = cut(ranked.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("copies")))
    shards = max(1, -(-distinct.count() // shard_rows))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"))
    return cut(dealt.groupBy("shard").applyInArrow(_index, "shard int, graph binary"))


def _pack_queries(table: pa.Table) -> pa.Table:
    data = pack(ids=table["id"].to_numpy(), vec=matrix(table["vec"], np.float64))
    return pa.table({"block": table["block"].slice(0, 1), "data": pa.array([data], pa.binary())})


def _walk(k: int, beam: int):
    """A shard's graph and some blocks of queries that walk it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            z = unpack(left["graph"][0].as_py())
            graph, starts = Graph(z["vectors"], z["size"], z["near"]), np.concatenate([[0], z["ends"][:-1]])
            for data in right["data"]:
                q = unpack(data.as_py())
                nodes, _ = search(graph, q["vec"], k + 1, beam)
                for i, own in enumerate(q["ids"].tolist()):
                    got = nodes[i][nodes[i] >= 0]
                    far = np.sqrt(((z["exact"][got] - q["vec"][i]) ** 2).sum(1))
                    found = [(d, x) for d, node in zip(far.tolist(), got.tolist(), strict=True) for x in z["copies"][starts[node] : z["ends"][node]].tolist() if x != own]
                    out += [(own, x, d) for d, x in sorted(found)[:k]]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, beam: int = 96, shard_rows: int = SHARD_ROWS, index: DataFrame | None = None) -> DataFrame:
    """query_id, rank (from 1), id and score (Euclidean distance, in double) of each query's k nearest rows of df.

    Queries are rows with the same columns; a row with a query's own id is none of its neighbours. Blocks of queries,
    packed, go to every shard, a graph travelling once for many of them; each answers with its k nearest; the k nearest
    of all shards remain,
    ties to the smaller id. Vectors that are null, empty, zero or hold null or non-finite components take no part on
    either side, nor do rows without an id or with another number of components than the commonest. Of rows that repeat
    a query's id the smallest vector asks. With fewer rows than k all are returned; empty tables give empty results.
    """
    index = build_index(df, id_col, vec_col, k + 1, shard_rows) if index is None else index
    dim = dimension(df, vec_col)
    asked = queries.where(usable(vec_col) & (F.size(vec_col) == dim) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vec_col).alias("vec"))
    asked = cut(asked)
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    packed = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(_pack_queries, "block int, data binary")
    shards = index.agg(F.max("shard")).first()[0]
    if shards is None:
        return packed.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    to_all = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards))).alias("shard"), F.floor(F.col("block") / TRIP_BLOCKS).cast("int").alias("trip"), "data")
    trips = index.withColumn("trip", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // TRIP_BLOCKS))))
    found = trips.groupBy("shard", "trip").cogroup(to_all.groupBy("shard", "trip")).applyInArrow(_walk(k, beam), "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
