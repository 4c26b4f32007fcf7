"""A content-addressed store of token ids: unique chunks, document recipes and Merkle manifests.

Files, all Parquet, under one folder:
  chunks/    hash (BLAKE2b, 16 bytes), n (ids), data (ids as little-endian unsigned integers of `width` bytes); one row a chunk
  recipes/   segment, doc_id, start, n_tokens, recipe (for each chunk its hash and, as <u4, its ids); ascending in doc_id
  manifest/  segment, width, docs, ids, root: the Merkle root over the segment's recipes
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, fresh_path, partitions, ship
from .vocabulary import id_type, slices, stream_encoder

#: Chunk lengths in ids: least, mean beyond the least (a power of two), most; and the ids that a rolling hash spans (a power of two).
LEAST, MEAN, MOST, SPAN = 64, 256, 2048, 16
HASH = 16
_ENTRY = np.dtype([("hash", f"V{HASH}"), ("n", "<u4")])
#: Bytes of text that a task encodes and cuts at once; arrays over their ids take some twelve times as much.
TEXT_BYTES = 3 << 20
#: Chunks that a task remembers, to send each on once: a passage that a third of all documents share is a row a task.
SEEN = 500_000
#: Documents of a segment, where there are more than the session's partitions.
SEGMENT_DOCS = 50_000


# chunks


def _mix(ids: np.ndarray) -> np.ndarray:
    """A pseudo-random 64-bit number for each id, by rule (SplitMix64)."""
    z = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def boundaries(ids: np.ndarray) -> np.ndarray:
    """Places after which a rolling hash over the last SPAN ids asks for a cut, so equal passages are cut alike."""
    rolled, m = _mix(ids), 1
    while m < SPAN:  # from sums over m ids those over twice as many
        wider = rolled.copy()
        wider[m:] += rolled[: max(0, len(ids) - m)] << np.uint64(m)
        rolled, m = wider, 2 * m
    return np.flatnonzero((rolled >> np.uint64(20)) % np.uint64(MEAN) == 0) + 1


def cuts(start: int, end: int, wanted: list[int]) -> list[int]:
    """Ends of the chunks of the document from start to end, given boundaries. Those of its first LEAST ids never count,
    so what stands before the document in the same array makes no difference."""
    ends = []
    while end - start > LEAST:
        at = bisect_left(wanted, start + LEAST)
        start = min(wanted[at] if at < len(wanted) else end, start + MOST, end)
        ends.append(start)
    if start < end:
        ends.append(end)
    return ends


def chunk_hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=HASH).digest()


def _stage(vocabulary: str, end_id: int | None):
    """Rows of kind 0, a document and its recipe, and of kind 1, a chunk that its document is the first of this task to have
    (the first since the task began to remember anew, where it has met very many)."""
    names = ["kind", "doc_id", "n", "hash", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = stream_encoder(vocabulary)
        width, seen = int(encoder.dtype[2]), set()
        for batch in batches:
            texts, ids_of = batch.column(1), batch.column(0).to_pylist()
            sizes = pc.binary_length(texts).fill_null(0).to_pylist()
            for a, b in slices(sizes, TEXT_BYTES):
                ids, ends = encoder.encode(texts.slice(a, b - a))
                if end_id is not None:
                    ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
                raw = ids.tobytes()
                wanted = boundaries(ids).tolist()
                kind, doc, size, key, data, start = [], [], [], [], [], 0
                if len(seen) > SEEN:
                    seen.clear()
                for doc_id, end in zip(ids_of[a:b], ends.tolist(), strict=True):
                    recipe, first = [], start
                    for e in cuts(start, end, wanted):
                        part = raw[start * width : e * width]
                        h = chunk_hash(part)
                        recipe.append(h + (e - start).to_bytes(4, "little"))
                        if h not in seen:
                            seen.add(h)
                            kind.append(1), doc.append(None), size.append(e - start), key.append(h), data.append(part)
                        start = e
                    kind.append(0), doc.append(doc_id), size.append(end - first), key.append(None), data.append(b"".join(recipe))
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(doc, pa.int64()), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(data, pa.binary())], names)

    return run


# recipes


def _merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; a node without a partner moves up as it is."""
    level = [hashlib.sha256(b"\x00" + x).digest() for x in leaves]
    if not level:
        return hashlib.sha256(b"").digest()
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _leaf(doc_id: int | None, start: int, n: int, recipe: bytes) -> bytes:
    return repr((doc_id, start, n)).encode() + recipe


def _segment_root(table: pa.Table) -> tuple[bytes, int, int]:
    rows = table.select(["doc_id", "start", "n_tokens", "recipe"]).sort_by([("start", "ascending"), ("n_tokens", "ascending"), ("doc_id", "ascending")])
    columns = [c.to_pylist() for c in rows.columns]
    return _merkle([_leaf(*x) for x in zip(*columns, strict=True)]), len(rows), sum(columns[2])


def _manifest(width: int):
    def run(table: pa.Table) -> pa.Table:
        root, docs, ids = _segment_root(table)
        return pa.table({"segment": table["segment"].slice(0, 1), "width": pa.array([width], pa.int32()), "docs": pa.array([docs], pa.int64()), "ids": pa.array([ids], pa.int64()), "root": pa.array([root], pa.binary())})

    return run


def _segments(bounds: np.ndarray):
    @F.pandas_udf("int")
    def segment(doc_id):
        import pandas as pd

        known = doc_id.notna().to_numpy()
        out = np.zeros(len(doc_id), np.int32)
        out[known] = np.searchsorted(bounds, doc_id[known].astype("int64").to_numpy(), side="right")
        return pd.Series(out)

    return segment


def write_store(df: DataFrame, path: str, vocabulary: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text of df, appends end_id to each document and writes the store to path.

    Documents are in ascending order of id_col (null first; rows that repeat an id by their recipes). Texts are encoded
    once, into a staging table beside the store, where each task sends a chunk on once; chunks are then deduplicated by
    hash, so a passage that a third of all documents share is one row a task. Starts are running sums within segments of the id
    range, on top of the segments' own. Null and empty texts have no ids but the end id; without an end id such a
    document has an empty recipe. An empty table gives a store without rows.
    """
    spark = df.sparkSession
    ship(spark)
    staging = f"{path}/staging"
    df.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(_stage(vocabulary, end_id), "kind int, doc_id long, n long, hash binary, data binary").write.option("compression", "zstd").parquet(staging)
    staged = spark.read.schema("kind int, doc_id long, n long, hash binary, data binary").parquet(staging)
    unique = staged.where("kind = 1").repartition(partitions(spark), "hash").groupBy("hash").agg(F.first("n").alias("n"), F.first("data").alias("data"))
    unique.write.option("compression", "zstd").parquet(f"{path}/chunks")

    docs = staged.where("kind = 0")
    n = docs.count()
    parts = max(4 * partitions(spark), -(-n // SEGMENT_DOCS))
    found = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], F.lit(20 * parts)).alias("b")).first()[0] if parts > 1 else None
    bounds = np.unique(np.array(found or [], np.int64))
    placed = docs.select(_segments(bounds)("doc_id").alias("segment"), "doc_id", F.col("n").alias("n_tokens"), F.col("data").alias("recipe"))
    sums = placed.groupBy("segment").agg(F.sum("n_tokens").alias("ids"))
    earlier = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("segment", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("first"))
    before = Window.partitionBy("segment").orderBy(F.col("doc_id").asc_nulls_first(), "recipe").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    recipes = running.join(first, "segment").select("segment", "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "recipe")
    recipes.repartitionByRange(partitions(spark), "segment").sortWithinPartitions("segment", F.col("doc_id").asc_nulls_first(), "start").write.parquet(f"{path}/recipes")
    width = int(id_type(vocabulary)[2])
    _recipes(spark, path).groupBy("segment").applyInArrow(_manifest(width), _MANIFEST).write.parquet(f"{path}/manifest")
    _delete(spark, staging)


_MANIFEST = "segment int, width int, docs long, ids long, root binary"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("segment int, doc_id long, start long, n_tokens long, recipe binary").parquet(f"{path}/recipes")


# reading


def _verified_refs(left: pa.Table, right: pa.Table) -> pa.Table:
    """A segment's documents as chunk references, if its recipes have the root that the manifest says. A document without
    ids has one reference, to no chunk, so that it is read back like any other."""
    if not len(right) and not len(left):
        raise ValueError("a store without rows")
    root, docs, ids = _segment_root(left)
    told = right.to_pylist()
    if len(told) != 1 or (told[0]["root"], told[0]["docs"], told[0]["ids"]) != (root, docs, ids):
        raise ValueError(f"recipes of segment {left['segment'][0].as_py() if len(left) else told[0]['segment']} do not match their manifest")
    cols: dict[str, list] = {k: [] for k in _REF_NAMES}
    segment = left["segment"][0].as_py()
    for row, (doc_id, start, n, recipe) in enumerate(zip(*(left[c].to_pylist() for c in ("doc_id", "start", "n_tokens", "recipe")), strict=True)):
        entries = np.frombuffer(recipe, _ENTRY)
        sizes = entries["n"].astype(np.int64)
        if sizes.sum() != n:
            raise ValueError(f"the recipe of document {doc_id} does not add up")
        m = max(1, len(entries))
        cols["segment"] += [segment] * m
        cols["row"] += [row] * m
        cols["doc_id"] += [doc_id] * m
        cols["start"] += [start] * m
        cols["n_tokens"] += [n] * m
        cols["at"] += range(m)
        cols["hash"] += [e.tobytes() for e in entries["hash"]] or [None]
        cols["n"] += sizes.tolist() or [0]
        cols["after"] += (sizes.sum() - np.cumsum(sizes)).tolist() or [0]
    return pa.table({k: pa.array(v, pa.binary() if k == "hash" else pa.int64()) for k, v in cols.items()})


#: A document's place (its segment, its row there), what the recipes say of it, and one of its chunks.
_DOC = "segment long, row long, doc_id long, start long, n_tokens long"
_REFS = f"{_DOC}, at long, hash binary, n long, after long"
_REF_NAMES = [x.split()[0] for x in _REFS.split(", ")]
_DOC_NAMES = _REF_NAMES[:5]


def _references(spark: SparkSession, path: str) -> DataFrame:
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    return _recipes(spark, path).groupBy("segment").cogroup(manifest.groupBy("segment")).applyInArrow(_verified_refs, _REFS)


def _checked_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's length and CRC-32 as <u4, if its bytes have the hash that it is stored under."""
    for batch in batches:
        keys, sizes, data, widths = (c.to_pylist() for c in batch.columns)
        crc = []
        for h, n, d, w in zip(keys, sizes, data, widths, strict=True):
            if chunk_hash(d) != h or len(d) != n * w:
                raise ValueError(f"chunk {h.hex()} does not hold what its hash says")
            crc.append(zlib.crc32(np.frombuffer(d, f"<u{w}").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc, pa.int64())], ["hash", "m", "crc"])


#: Fixed value: the CRC-32 polynomial, lowest power first.
_POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo that of CRC-32, bits reflected."""
    a, b, out = a.astype(np.uint64), b.astype(np.uint64), np.zeros(np.broadcast(a, b).shape, np.uint64)
    one = np.uint64(1)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(bit) & one, b, np.uint64(0))
        b = (b >> one) ^ np.where(b & one, _POLY, np.uint64(0))
    return out


def crc_followed_by(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The share that bytes of this CRC-32 have in that of a text where so many bytes follow them; shares are XORed."""
    out, power, left = crc.astype(np.uint64), np.array([1 << 23], np.uint64), n_bytes.astype(np.int64)  # x to the 8
    while left.any():
        out = np.where(left & 1, _times(out, power), out)
        power, left = _times(power, power), left >> 1
    return out.astype(np.int64)


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, (keys, n, after, m, crc) = batch.columns[:5], batch.columns[5:]
        n, after = n.to_numpy(zero_copy_only=False), after.to_numpy(zero_copy_only=False)
        m, crc = (c.fill_null(-1).to_numpy(zero_copy_only=False) for c in (m, crc))
        named = keys.is_valid().to_numpy(zero_copy_only=False)
        if (named & (n != m)).any():
            raise ValueError("a recipe names a chunk that the store does not hold, or not of this length")
        share = np.zeros(len(n), np.int64)
        if named.any():
            share[named] = crc_followed_by(crc[named], 4 * after[named])
        yield pa.RecordBatch.from_arrays([*doc, pa.array(share)], [*_DOC_NAMES, "share"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as <u4) of every document, from the store's files alone.

    Recipes are checked against the Merkle manifest and chunks against their hashes. CRCs of chunks combine to those of
    documents, so chunk bytes are read once, where they lie, and never shuffled. A document without ids has the CRC of no
    bytes, 0; rows that repeat an id come back as often as they were written. Damage raises an error.
    """
    ship(spark)
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    row = manifest.agg(F.max("width")).first()
    width = row[0] or 2
    chunks = spark.read.schema("hash binary, n long, data binary").parquet(f"{path}/chunks").withColumn("w", F.lit(width)).mapInArrow(_checked_chunks, "hash binary, m long, crc long")
    refs = _references(spark, path)
    shares = refs.join(chunks, "hash", "left").select(*_DOC_NAMES, "hash", "n", "after", "m", "crc").mapInArrow(_shares, f"{_DOC}, share long")
    return shares.groupBy(*_DOC_NAMES).agg(F.bit_xor("share").alias("ids_crc32")).select("doc_id", "start", "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (array<int>) of every document, put together again from its chunks; without ids the array is empty."""
    ship(spark)
    width = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").agg(F.max("width")).first()[0] or 2
    chunks = spark.read.schema("hash binary, n long, data binary").parquet(f"{path}/chunks").select("hash", "data")
    parts = _references(spark, path).join(chunks, "hash", "left").groupBy(*_DOC_NAMES).agg(F.array_sort(F.collect_list(F.struct("at", "hash", "data"))).alias("parts")).select("doc_id", "start", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(2).to_pylist():
                parts = [p for p in parts if p["hash"] is not None]
                if any(p["data"] is None or chunk_hash(p["data"]) != p["hash"] for p in parts):
                    raise ValueError("a chunk is missing or damaged")
                out.append(np.frombuffer(b"".join(p["data"] for p in parts), f"<u{width}").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return parts.mapInArrow(run, "doc_id long, start long, ids array<int>")


def store_and_read(df: DataFrame, vocabulary: str, end_id: int | None = None, path: str | None = None, **columns: str) -> DataFrame:
    """Writes the store (to a new folder of the shared one, unless a path is given) and returns read_digests of its files."""
    spark = df.sparkSession
    path = path or fresh_path(spark, "tokens")
    write_store(df, path, vocabulary, end_id, **columns)
    return read_digests(spark, path)
