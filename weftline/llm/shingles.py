"""Near-deduplication of texts at a Jaccard similarity of their word-shingle sets.

SimHash fingerprints linked through Golay keys (simhash.py) give the candidates within three bits. Pairs down to 0.8
differ in about ten bits of 64, which no bounded number of Golay keys reaches; keys of bands of least hashes find those.
The sets themselves decide on every candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut, partitions, ship
from .components import components
from .simhash import fingerprint_links, majority, one_of_each, shingle_hashes

#: Sets at least this similar are linked.
LEAST_SIMILAR = 0.8
#: A pair is a candidate if all hashes of a band agree, and so many of all: five standard deviations under 0.8.
BANDS, BAND = 20, 5
LEAST_AGREEING = 60
#: Members of a sketch's key, and bytes of sets, that one task compares at once; larger groups are dealt out in tiles.
TILE, TILE_BYTES = 16384, 1 << 25

_DRAWN = np.random.default_rng(42).integers(1, 1 << 63, (3, BANDS * BAND), np.uint64)
_TIMES, _PLUS, _MIX = _DRAWN[0] | np.uint64(1), _DRAWN[1], _DRAWN[2] | np.uint64(1)


# sets and sketches


def shingle_set(text: bytes | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted 64-bit hashes of a UTF-8 text's word shingles, each once."""
    return np.unique(shingle_hashes(text, shingle, seed))


def identity(found: np.ndarray) -> int:
    """A set's own hash, as a signed long."""
    from xxhash import xxh64_intdigest

    return int(np.array([xxh64_intdigest(found.tobytes(), 42)], np.uint64).view(np.int64)[0])


def sketch(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(a key a band, a byte a hash) of a set; of an empty set all hashes are the greatest."""
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1 << 11):
        np.minimum(least, (found[at : at + (1 << 11), None] * _TIMES + _PLUS).min(axis=0), out=least)
    mixed = least * _MIX
    mixed ^= mixed >> np.uint64(29)
    keys = (mixed * _PLUS).reshape(BANDS, BAND).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64), (mixed >> np.uint64(24)).astype(np.uint8).tobytes()


# comparison inside one group


def _spread(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of all near pairs: each member reached is compared with those not yet reached."""
    left, a, b = np.arange(n), [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near(at, left)
            reached, left = left[hit], left[~hit]
            queue += reached.tolist()
            a.append(np.full(len(reached), at))
            b.append(reached)
    return (np.concatenate(a), np.concatenate(b)) if a else (left, left)


def agreeing(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Links among sketches that agree in enough hashes."""
    m = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    return _spread(len(m), lambda at, left: (m[left] == m[at]).sum(axis=1) >= LEAST_AGREEING)


def similar(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Links among sets (as bytes of their hashes) whose Jaccard similarity is at least LEAST_SIMILAR; two empty ones are alike."""
    parts = [np.frombuffer(s, np.uint64) for s in sets]
    size = np.array([len(p) for p in parts])
    end = np.cumsum(size)
    names, flat = np.unique(np.concatenate(parts), return_inverse=True)

    def near(at: int, left: np.ndarray) -> np.ndarray:
        mark = np.zeros(len(names), bool)
        mark[flat[end[at] - size[at] : end[at]]] = True
        upto = np.concatenate([[0], np.cumsum(mark[flat])])
        common = upto[end[left]] - upto[end[left] - size[left]]
        return 10 * common >= round(10 * LEAST_SIMILAR) * (size[left] + size[at] - common)

    return _spread(len(parts), near)


def _compare(links_of: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
    """Links of rows (key, lo, hi, node, what) that come sorted by the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, whats = None, [], []
        out_a, out_b = [], []

        def close() -> None:
            if len(nodes) > 1:
                i, j = links_of(whats)
                own = np.array(nodes, np.int64)
                out_a.append(own[i])
                out_b.append(own[j])

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (out_a, out_b)], ["a", "b"])
            out_a.clear()
            out_b.clear()
            return made

        for batch in batches:
            for key, lo, hi, node, what in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, lo, hi) != now:
                    close()
                    now, nodes, whats = (key, lo, hi), [], []
                nodes.append(node)
                whats.append(what)
            yield rows()
        close()
        yield rows()

    return run


def _linked(members: DataFrame, sizes: DataFrame, what: DataFrame, links_of) -> DataFrame:
    """(a, b): links that links_of finds in each group of members(key, node); sizes(key, n) tells each group's tiles,
    what(node, what) has what is compared. A group of one tile is one task's; all tiles of a larger one meet in pairs."""
    spark = members.sparkSession
    tile = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    dealt = members.join(sizes, "key").withColumn("t", tile).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("key", F.least("t", "o").alias("lo"), F.greatest("t", "o").alias("hi"), "node")
    full = dealt.join(what, "node").select("key", "lo", "hi", "node", "what")
    sorted_ = full.repartition(partitions(spark), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return sorted_.mapInArrow(_compare(links_of), "a long, b long")


# the operator


def _sketched(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, bits, keys, sketches, size = [], [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                hashes = shingle_hashes(text.as_py(), shingle, seed)
                bits.append(majority(hashes))
                found = np.unique(hashes)
                k, s = sketch(found)
                fp.append(identity(found))
                keys.append(k)
                sketches.append(s)
                size.append(found.nbytes)
            simhash = pa.array(np.array(bits, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64()), simhash, pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(size, pa.int64())], ["th", "fp", "simhash", "keys", "sketch", "size"])

    return docs.mapInArrow(run, "th long, fp long, simhash long, keys array<long>, sketch binary, size long")


def _sets(texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle, seed).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "what"])

    return texts.mapInArrow(run, "node long, what binary")


def shingle_groups(docs: DataFrame, text_col: str = "text", shingle: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(th, fp) for every distinct text hash, and (node, component) for each fp that links reach.

    Texts of equal shingle sets share a fp. Others are linked if their sets' Jaccard similarity is at least 0.8, which is
    checked on the sets; a pair is seen if its SimHash fingerprints differ in at most three bits, if all hashes of one of
    20 bands of 5 agree (0.9996 of pairs at 0.8, more above) or if others link it to the same group. Sketches are compared
    inside each band's key, sets inside each group that fingerprints and sketches join, so a set travels once (once a
    tile where a group is large). Null, empty and blank texts have the empty set and are alike.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.xxhash64(col(text_col)).alias("th"), col(text_col).alias("text"))
    rows = cut(_sketched(texts, shingle, seed))
    named = rows.select("th", "fp").distinct()
    nodes = cut(rows.groupBy("fp").agg(F.min(F.struct("th", "simhash", "keys", "sketch", "size")).alias("r")).select("fp", "r.*"))

    # candidates: groups that close fingerprints and agreeing sketches join
    first = cut(nodes.groupBy("simhash").agg(F.min("fp").alias("first"), F.count(F.lit(1)).alias("sets")))
    close = fingerprint_links(first.select(F.col("simhash").alias("fp")))
    for side in "ab":
        close = close.join(first.select(F.col("simhash").alias(side), F.col("first").alias(f"{side}_first")), side)
    alike = nodes.join(first.where("sets > 1"), "simhash").where("fp <> first").select("fp", "first")
    copies = close.select("a_first", "b_first").unionAll(alike)
    members = nodes.select(F.explode("keys").alias("key"), F.col("fp").alias("node"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.ceil(F.col("c") / TILE).cast("int").alias("n"))
    banded = _linked(members, sizes, nodes.select(F.col("fp").alias("node"), F.col("sketch").alias("what")), agreeing)
    near = components(banded.unionAll(copies.toDF("a", "b")))

    # decided on the sets
    group = cut(near.join(nodes.select(F.col("fp").alias("node"), "th", "size"), "node").select(F.col("component").alias("key"), "node", "th", "size"))
    tiles = group.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("size") / TILE_BYTES), F.lit(1)).cast("int").alias("n"))
    wanted = texts.groupBy("th").agg(F.min("text").alias("text")).join(group.select("th", "node"), "th").select("node", "text")
    return named, components(_linked(group.select("key", "node"), tiles, cut(_sets(wanted, shingle, seed)), similar))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42) -> DataFrame:
    """One row of each group of texts whose shingle sets are linked: that with the least (id, nulls last; text hash)."""
    named, found = shingle_groups(docs, text_col, shingle, seed)
    return one_of_each(docs, named, found, id_col, text_col)
