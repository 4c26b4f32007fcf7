"""Encoding and decoding through a distinct-word table."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cut, partitions, renamed_columns, ship
from .vocabulary import CACHE_WORDS, WordEncoder, id_type, pieces, slices, words

#: Characters of text whose words share one dictionary; a longer text has one to itself.
BLOCK_CHARS = 8 << 20


def _pack(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _unpack(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _part_of(names: list[str], parts: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) % parts for w in names), np.int64, len(names))


def _grouped(names: list[str], parts: int) -> list[tuple[int, bytes, int]]:
    """(part, its words joined, their number): a dictionary by the words' hashes, in the order of first occurrence."""
    part_of = _part_of(names, parts)
    order = np.argsort(part_of, kind="stable")
    bounds = np.searchsorted(part_of[order], np.arange(parts + 1)).tolist()
    ordered = [names[i] for i in order.tolist()]
    return [(p, "\n".join(ordered[bounds[p] : bounds[p + 1]]).encode(), bounds[p + 1] - bounds[p]) for p in range(parts) if bounds[p] < bounds[p + 1]]


def _blocks(batches: Iterator[pa.RecordBatch], texts_at: int, block_chars: int) -> Iterator[tuple[int, pa.RecordBatch, list]]:
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        texts = batch.column(texts_at).to_pylist()
        for start, end in slices([len(t or "") for t in texts], block_chars):
            yield block, batch.slice(start, end - start).select(list(range(texts_at))), texts[start:end]
            block += 1


_WORDS = "block long, part int, n long, raw long, data binary"


def _dictionaries(texts_at: int, parts: int, block_chars: int):
    """A row for each block and part of its dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in _blocks(batches, texts_at, block_chars):
            seen: dict[str, None] = {}
            for t in texts:
                seen.update(dict.fromkeys(words(t or "")))
            rows = [(block, p, n, len(raw), _pack(raw)) for p, raw, n in _grouped(list(seen), parts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["block", "part", "n", "raw", "data"])

    return run


_POSITIONS = "block long, n long, check long, data binary, keys binary"


def _positions(texts_at: int, parts: int, block_chars: int):
    """A row for each block: its keys, and the number of the word at each position.

    A word is numbered by its place in its part of the dictionary, then by part, so early and thus frequent words have
    small numbers; bytes of equal weight stand together, which packs them well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, keys, texts in _blocks(batches, texts_at, block_chars):
            at: dict[str, int] = {}
            lengths, index = [], []
            for t in texts:
                ws = words(t or "")
                lengths.append(len(ws))
                index.append(np.fromiter((at.setdefault(w, len(at)) for w in ws), np.uint32, len(ws)))
            names = list(at)
            part_of = _part_of(names, parts)
            order = np.argsort(part_of, kind="stable")
            number = np.empty(len(names), np.uint32)
            number[order] = (np.arange(len(names)) - np.searchsorted(part_of[order], part_of[order])) * parts + part_of[order]
            flat = number[np.concatenate(index)].astype("<u4") if names else np.empty(0, "<u4")
            check = sum(zlib.crc32(raw) for _, raw, _ in _grouped(names, parts))
            raw = np.array(lengths, "<u4").tobytes() + flat.view(np.uint8).reshape(-1, 4).T.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((block, pa.int64()), (len(raw), pa.int64()), (check, pa.int64()), (_pack(raw), pa.binary()), (_ipc(keys), pa.binary()))], ["block", "n", "check", "data", "keys"])

    return run


_ANSWERS = "block long, part int, n long, raw long, check long, data binary"


def _encode(path: str, most: int = CACHE_WORDS):
    """Each part of the dictionary is one task's: every distinct word of the corpus meets the library once, here. Words
    are remembered from block to block while there are at most so many of them, so more parts are needed beyond that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordEncoder(path, id_type(path))
        wide = int(table.dtype[2])
        for batch in batches:
            for row in batch.to_pylist():
                text = _unpack(row["data"], row["raw"])
                ws = text.decode().split("\n")
                if len(table.known) > most:
                    table.forget()
                table.add({w for w in ws if w not in table.known})
                ids = [table.known[w] for w in ws]
                raw = np.array([len(x) // wide for x in ids], "<u4").tobytes() + b"".join(ids)
                cells = ((row["block"], pa.int64()), (row["part"], pa.int32()), (len(ws), pa.int64()), (len(raw), pa.int64()), (zlib.crc32(text), pa.int64()), (_pack(raw), pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in cells], ["block", "part", "n", "raw", "check", "data"])

    return run


def _join(path: str, key_names: list[str], parts: int, emit):
    """Puts ids, and where emit asks for them the pieces that the ids join to, back where a block's words stood; emit
    makes the result columns of one document from its ids and the decoded text of its words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        id_to_piece = pieces(path)
        block, kind = left.to_pylist()[0], id_type(path)
        wide = int(kind[2])
        known: list[bytes] = []
        first = np.zeros(parts, np.int64)
        check = 0
        for row in right.sort_by("part").select(["part", "n", "raw", "check", "data"]).to_pylist():
            first[row["part"]] = len(known)
            check += row["check"]
            raw, n = _unpack(row["data"], row["raw"]), row["n"]
            ends = np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64) * wide + 4 * n
            known += [raw[a:b] for a, b in zip(np.concatenate([[4 * n], ends[:-1]]).tolist(), ends.tolist(), strict=True)]
        if check != block["check"]:
            raise ValueError("the input gave other rows when it was read again; leave reread out")
        decoded = [" ".join(map(id_to_piece.__getitem__, np.frombuffer(x, kind).tolist())) for x in known] if emit.decodes else []
        with pa.ipc.open_stream(block["keys"]) as r:
            keys = r.read_all()
        positions = _unpack(block["data"], block["n"])
        lengths = np.frombuffer(positions, "<u4", len(keys))
        planes = np.frombuffer(positions, np.uint8, offset=4 * len(keys)).reshape(4, -1)
        number = np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)
        flat = first[number % parts] + number // parts
        out, at = [], 0
        for n in lengths.tolist():
            places = flat[at : at + n].tolist()
            at += n
            ids = np.frombuffer(b"".join(map(known.__getitem__, places)), kind)
            out.append(emit(ids, " ".join(filter(None, map(decoded.__getitem__, places)))) if emit.decodes else emit(ids))
        columns = list(zip(*out, strict=True))
        return pa.table([*keys.columns, *map(pa.array, columns)], names=[*key_names, *emit.names])

    return run


def _encoded(df: DataFrame, path: str, keys: list[str], text_col: str, emit, schema: str, block_chars: int, reread: bool) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    parts = partitions(spark)
    inner = [f"__k{i}" for i in range(len(keys))]
    source = df.select(*[col(c).alias(k) for c, k in zip(keys, inner, strict=True)], col(text_col).alias("__text"))
    source = source if reread else cut(source)
    asked = source.mapInArrow(_dictionaries(len(keys), parts, block_chars), _WORDS).repartition(parts, "part")
    answers = asked.mapInArrow(_encode(path), _ANSWERS)
    documents = source.mapInArrow(_positions(len(keys), parts, block_chars), _POSITIONS)
    joined = documents.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_join(path, inner, parts, emit), renamed_columns(df, dict(zip(inner, keys, strict=True)), schema))
    return joined.select(*[F.col(k).alias(c) for c, k in zip(keys, inner, strict=True)], *emit.names)


def _ids(ids: np.ndarray) -> tuple:
    return (ids.astype(np.int32),)


_ids.names, _ids.decodes = ["ids"], False


def encode(df: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", block_chars: int = BLOCK_CHARS, reread: bool = False) -> DataFrame:
    """keys and ids (array<int>) of every text, as the tokenizers library encodes it without added special tokens.

    Words are split in Spark. A block of documents sends each of its distinct words once, packed with those of the same
    hash; the task that holds a hash encodes each distinct word of the corpus once; ids go back to the blocks and are
    joined to the words' positions. Frequent words thus cost a row a block, never a row an occurrence, and no task holds
    more than a block or a hash's share of the distinct words. Null and empty texts have no ids. Rows repeat as they
    come; columns that are not named as keys are not read. df is read twice: it is checkpointed first unless reread says
    that a second reading gives the same rows in the same order, as Parquet files do.
    """
    return _encoded(df, path, list(keys), text_col, _ids, "ids array<int>", block_chars, reread)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): the vocabulary file as a table, of tens of thousands of rows whatever the corpus."""
    table = pa.table({"id": pa.array(range(len(pieces(path))), pa.int32()), "piece": pa.array(pieces(path), pa.string())})
    return spark.createDataFrame(table)


def decode(df: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """keys and text: every id joined to the id-to-piece table by a broadcast join, pieces put back in order.

    The result is the library's decode(ids, skip_special_tokens=False): for a vocabulary file without a decoder the
    pieces, a space between two. Null arrays decode to null, empty ones to the empty string; an id outside the
    vocabulary is an error. Rows repeat as they come. The broadcast table's size is the vocabulary's, whatever df holds;
    a row of ids goes through one task, as its text does.
    """
    spark = df.sparkSession
    rows = cut(df.select(F.struct(*[col(c) for c in keys]).alias("row"), col(ids_col).alias("ids")).withColumn("n", F.monotonically_increasing_id()))
    each = rows.where(F.size("ids") > 0).select("n", F.posexplode("ids").alias("at", "id"))
    named = each.join(F.broadcast(piece_table(spark, path)), "id", "left")
    piece = F.when(F.col("piece").isNull(), F.raise_error(F.concat(F.lit("no such id in the vocabulary: "), "id"))).otherwise(F.col("piece"))
    texts = named.groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", piece.alias("piece")))), lambda x: x["piece"]), " ").alias("text"))
    whole = F.when(F.col("ids").isNull(), None).otherwise(F.coalesce("text", F.lit("")))
    return rows.join(texts, "n", "left").select("row.*", whole.alias("text"))


def _digests(ids: np.ndarray, text: str) -> tuple:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


_digests.names, _digests.decodes = ["n_tokens", "ids_sha256", "decoded_sha256"], True


def round_trip_digests(df: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", block_chars: int = BLOCK_CHARS, reread: bool = False) -> DataFrame:
    """keys, n_tokens, ids_sha256 and decoded_sha256 of every text, as encode() and decode() give them, nothing stored.

    The id-to-piece join is made in the distinct-word table, where each word's ids meet their pieces once a block, and
    not for every occurrence: tokens would be a row each in a shuffle. Nulls, empties and repeated rows as in encode().
    """
    return _encoded(df, path, list(keys), text_col, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", block_chars, reread)
