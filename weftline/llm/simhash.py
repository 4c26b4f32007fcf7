"""SimHash near-deduplication: fingerprints of word shingles, linked through Golay-code keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut, partitions, ship
from .components import components
from .unionfind import forest

#: The generator polynomial of the binary Golay code (23, 12, 7), and its lengths.
GENERATOR, LENGTH, CHECKS = 0xAE3, 23, 11
#: Bit ranges of a 64-bit fingerprint; three segments, each at most as long as a codeword.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MOST_DIFFERENT = 3
#: Members of one key that one task compares at once; keys of more than HOT_KEY are dealt out in tiles of this many.
TILE = 4096
HOT_KEY = 32 * TILE
#: Low bits of a key (the kind of the key and one codeword index) that counts of groups of keys leave out.
COARSE = 13


# fingerprints


def shingle_hashes(text: bytes | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of a UTF-8 text, repeats included: A-Z lower-cased, words between ASCII white space.

    A text with fewer words than a shingle has its whole sequence as its one shingle; without words (or null) it has none.
    """
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.fromiter((xxh64_intdigest(b" ".join(words[i : i + shingle]), seed) for i in range(n)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; 0 of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return df.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


# Golay keys


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 12 high bits, and the error of weight at most 3 that each of the 2,048 syndromes stands for."""

    def remainder(v: int) -> int:
        for bit in range(LENGTH - 1, CHECKS - 1, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - CHECKS)
        return v

    unit = [remainder(1 << i) for i in range(LENGTH)]
    high = np.zeros(1 << (LENGTH - CHECKS), np.int64)
    for i in range(LENGTH - CHECKS):
        high[1 << i : 2 << i] = high[: 1 << i] ^ unit[CHECKS + i]
    error = np.zeros(1 << CHECKS, np.int64)
    for weight in range(1, 4):
        for bits in combinations(range(LENGTH), weight):
            s = 0
            for i in bits:
                s ^= unit[i]
            error[s] = sum(1 << i for i in bits)
    return high, error


def codeword_index(v: np.ndarray) -> np.ndarray:
    """The 12-bit index of the one codeword within three bits of each 23-bit word."""
    high, error = _tables()
    syndrome = (v & ((1 << CHECKS) - 1)) ^ high[v >> CHECKS]
    return (v ^ error[syndrome]) >> CHECKS


def ball_indices(v: np.ndarray, width: int) -> np.ndarray:
    """Codeword indices of each word and of its neighbours one bit off; -1 where an index repeats in its row."""
    around = v[:, None] ^ np.concatenate([[0], 1 << np.arange(width)])[None, :]
    found = np.sort(codeword_index(around), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): every fingerprint's keys. The lowest bit of a key is 0 for the one that its own codewords give.

    Two fingerprints that differ in at most three bits differ in at most one bit in each of some two of three segments.
    Then the codeword indices of the one fingerprint in these two segments are among those that the other reaches from
    within one bit: a key of the first kind of the one equals, but for the lowest bit, a key of the other.
    """
    u = fp.view(np.uint64)
    parts = [((u >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    own = [codeword_index(p) for p in parts]
    balls = [ball_indices(p, width) for p, (_, width) in zip(parts, SEGMENTS, strict=True)]
    keys, rows = [], []
    for n, (i, j) in enumerate(combinations(range(3), 2)):
        home = (n << 24) | (own[i] << 12) | own[j]
        wide = np.where((balls[i][:, :, None] >= 0) & (balls[j][:, None, :] >= 0), (n << 24) | (balls[i][:, :, None] << 12) | balls[j][:, None, :], -1).reshape(len(fp), -1)
        row, col = np.nonzero((wide >= 0) & (wide != home[:, None]))
        keys += [home << 1, wide[row, col] << 1 | 1]
        rows += [np.arange(len(fp)), row]
    return np.concatenate(keys), np.concatenate(rows)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 512):
            part = fps[at : at + 512]
            key, row = keys_of(part)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", "fp"])


# links


def close_pairs(left: np.ndarray, right: np.ndarray, most: int = MOST_DIFFERENT) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints that differ in at most so many bits, equal ones aside."""
    a, b = [], []
    r = right.view(np.uint64)
    for at in range(0, len(left), 256):
        off = np.bitwise_count(left[at : at + 256].view(np.uint64)[:, None] ^ r[None, :])
        i, j = np.nonzero((off <= most) & (off > 0))
        a.append(i + at)
        b.append(j)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _small_keys(key: np.ndarray, fp: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of all keys of 2 to 32 members at once: every member against the one s places on."""
    found_a, found_b = [], []
    group = np.repeat(np.arange(len(size)), size)
    small = (size <= 32)[group]
    key, fp, group = key[small], fp[small], group[small]
    u = fp.view(np.uint64)
    for s in range(1, min(32, len(key))):
        same = group[s:] == group[:-s]
        if not same.any():
            break
        off = np.bitwise_count(u[s:] ^ u[:-s])
        hit = np.flatnonzero(same & (off <= MOST_DIFFERENT) & (off > 0))
        found_a.append(fp[s:][hit])
        found_b.append(fp[:-s][hit])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (fp[:0], fp[:0])


def _links_of_sorted(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    """Whole keys, sorted: links of a spanning forest."""
    group_key = key >> 1
    first = np.flatnonzero(np.concatenate([[True], group_key[1:] != group_key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    links = [_small_keys(key, fp, size)]
    for g in np.flatnonzero(size > 32):
        part, home = fp[first[g] : first[g] + size[g]], (key[first[g] : first[g] + size[g]] & 1) == 0
        if home.any():
            i, j = close_pairs(part[home], part)
            links.append(forest(part[home][i], part[j]))
    a, b = forest(*(np.concatenate(x) for x in zip(*links, strict=True)))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(key):
            continue
        held.append((key, fp))
        rows += len(key)
        if rows < 1 << 18:
            continue
        key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        whole = int(np.searchsorted(key >> 1, key[-1] >> 1))  # the last key may go on in the next batch
        if whole:
            yield _links_of_sorted(key[:whole], fp[:whole])
        held, rows = [(key[whole:], fp[whole:])], len(key) - whole
    if rows:
        key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        yield _links_of_sorted(key, fp)


def _tile_links(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    x, y = (t["fp"].to_numpy() for t in (left, right))
    i, j = close_pairs(x, y)
    a, b = forest(x[i], y[j])
    return pa.table({"a": a, "b": b})


def _hot_links(hot: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links inside the keys of sizes(key, members), which have more than one task should compare: hot(key, fp) is dealt
    into tiles as it is shuffled, and all tiles of a key meet all others. No task holds more than two tiles."""
    tiles = sizes.select("key", F.ceil(F.col("members") / TILE).cast("int").alias("n"))
    dealt = hot.select(F.shiftright("key", 1).alias("key"), "fp").join(tiles, "key").withColumn("t", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    left = dealt.select("key", "t", F.explode(F.sequence(F.col("t"), F.col("n") - 1)).alias("u"), "fp")
    new = dealt.toDF(*dealt.columns)  # columns of its own, to be told from left's
    right = new.select("key", F.explode(F.sequence(F.lit(0), F.col("t"))).alias("t"), F.col("t").alias("u"), "fp")
    return left.groupBy("key", "t", "u").cogroup(right.groupBy("key", "t", "u")).applyInArrow(_tile_links, "a long, b long")


def _count_coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows fall to each group of 4,096 keys: some ten thousand counts a task."""
    counts = np.zeros(3 << 12, np.int64)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 512):
            counts += np.bincount(keys_of(fps[at : at + 512])[0] >> COARSE, minlength=len(counts))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["coarse", "members"])


def _hot_keys(distinct: DataFrame, keyed: DataFrame) -> DataFrame:
    """(hot, members): the keys with more than HOT_KEY members. Counts of groups of keys, which a group of so few
    members cannot exceed, tell which keys have to be counted one by one."""
    coarse = distinct.mapInArrow(_count_coarse, "coarse long, members long").groupBy("coarse").agg(F.sum("members").alias("members"))
    large = cut(coarse.where(F.col("members") > HOT_KEY).select("coarse"))  # three times 4,096 rows at most
    counted = keyed.withColumn("coarse", F.shiftright("key", COARSE)).join(F.broadcast(large), "coarse", "left_semi")
    return cut(counted.groupBy(F.shiftright("key", 1).alias("hot")).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > HOT_KEY))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that join fingerprints of distinct(fp) differing in at most three bits.

    They leave every pair that differs so little in one component; of a dense group only a spanning forest is returned.
    Keys with more members than one task should compare are known from counts before any task holds one.
    """
    spark = distinct.sparkSession
    ship(spark)
    distinct = distinct.select("fp")
    keyed = distinct.mapInArrow(_emit_keys, "key long, fp long")
    hot = _hot_keys(distinct, keyed)
    some = not hot.isEmpty()
    is_hot = F.shiftright("key", 1) == F.col("hot")
    cold = keyed.join(hot, is_hot, "left_anti") if some else keyed
    dealt = cold.repartition(partitions(spark), F.shiftright("key", 1)).sortWithinPartitions("key")
    links = dealt.mapInArrow(_link, "a long, b long")
    return cut(links.unionAll(_hot_links(keyed.join(hot, is_hot, "left_semi"), hot.withColumnRenamed("hot", "key"))) if some else links)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row: documents whose fingerprints differ in at most three bits are linked.

    component_id is the smallest doc_id that links reach, itself included. Exact copies share a fingerprint and meet in
    a partial aggregation before any key is made, so a group of copies costs one fingerprint. Null and empty texts have
    fingerprint 0 and are linked like any other. A null doc_id takes part in linking but is never the smallest unless a
    component has no other. Repeated rows come back as often as they came. An empty table gives an empty result.
    """
    rows = cut(fingerprints(df, id_col, text_col, shingle, seed))
    least = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(fingerprint_links(least))
    grouped = least.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = grouped.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, named: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each component, all columns of docs kept: that with the least (id, nulls last; text hash).

    named(th, fp) gives each distinct text hash its fingerprint, found(node, component) each linked fingerprint its
    component. Of rows that repeat both id and text that with the least hash of all its columns stays.
    """
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("th"))
    again = rows.groupBy("id", "th").agg(F.count(F.lit(1)).alias("n"))
    least = again.groupBy("th").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "n")).alias("r")).select("th", "r.*")
    component = named.join(found, F.col("fp") == F.col("node"), "left").select("th", F.coalesce("component", "fp").alias("component"))
    best = least.join(component, "th").groupBy("component").agg(F.min(F.struct("nameless", "id", "th", "n")).alias("r"))
    keep = cut(best.select(F.col("r.id").alias("kept_id"), F.col("r.th").alias("kept_th"), "r.n"))
    kept = rows.join(keep, (F.col("th") == F.col("kept_th")) & F.col("id").eqNullSafe(F.col("kept_id")))
    once = kept.where("n = 1").select("row.*")
    if keep.where("n > 1").isEmpty():
        return once
    often = kept.where("n > 1").groupBy("kept_th").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return once.unionAll(often.select("row.*"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row of each near-duplicate group: that with the least doc_id (nulls last, then by text), all columns of docs kept."""
    texts = docs.select(F.xxhash64(col(text_col)).alias("th"), col(text_col).alias("text"))
    named = cut(fingerprints(texts, "th", "text", shingle, seed).toDF("th", "fp").distinct())
    return one_of_each(docs, named, components(fingerprint_links(named.select("fp").distinct())), id_col, text_col)
