"""Importance resampling towards a target corpus: array-scored weights, sorted runs, tournament merging.

A feature is a word (lower-cased A-Z; digits, letters a-z and all that is not ASCII), its bucket the CRC-32 of its UTF-8
bytes modulo BUCKETS. A bucket's gain says how much likelier it is in the target than in the corpus, a document's weight
is the floored mean of its features' gains, and Gumbel noise from a hash of the id makes the highest scores a draw
without replacement in proportion to the weights.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh_path, partitions, ship
from .vocabulary import slices

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: Bytes of text whose words are found at once, rows of a run that a task sorts in memory, rows of a block of a run, and
#: the most rows that a merging task is meant to hold of the draw.
BYTES, RUN_ROWS, BLOCK_ROWS, RANGE_ROWS = 4 << 20, 1_000_000, 4_096, 1_000_000
#: Fixed value: the CRC-32 polynomial, lowest power first.
_POLY = 0xEDB88320
_ROW = np.dtype([("score", "<i8"), ("id", "<i8"), ("known", "<i8"), ("n", "<i8"), ("weight", "<i8")])


# words and their buckets


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLY), c >> 1)
    return c


def _lower() -> np.ndarray:
    """Each byte in lower case; 0 for those that part words."""
    b = np.arange(256)
    b = np.where((b >= ord("A")) & (b <= ord("Z")), b + 32, b)
    return np.where((b >= 128) | ((b >= ord("a")) & (b <= ord("z"))) | ((b >= ord("0")) & (b <= ord("9"))), b, 0).astype(np.uint8)


_TABLE, _LOWER = _crc_table(), _lower()
#: Bytes of a word that are hashed column by column; longer words one by one.
_SHORT = 32


def word_crcs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of every word of the texts in order, and the number of words of each text. A null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = np.concatenate([[False], data > 0, [False]])
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
    sizes = ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(sizes, _SHORT + 1), kind="stable")
    crc, first, length = crc[order], starts[order], sizes[order]
    long = int(np.count_nonzero(sizes > _SHORT))
    for i in range(long):
        crc[i] = zlib.crc32(data[first[i] : first[i] + length[i]].tobytes()) ^ 0xFFFFFFFF
    short = np.minimum(length, _SHORT)
    for k in range(int(short.max(initial=0))):
        m = int(np.searchsorted(-short, -k, side="left"))  # words of more than k bytes stand first
        if m > long:
            c = crc[long:m]
            crc[long:m] = _TABLE[(c ^ data[first[long:m] + k]) & 0xFF] ^ (c >> 8)
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out, np.diff(np.searchsorted(starts, offsets))


def _batches(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, CRCs, words of each row) of slices of a batch whose column `at` is the text."""
    texts = batch.column(at)
    for a, b in slices(pc.binary_length(texts).fill_null(0).to_pylist(), BYTES):
        yield a, b, *word_crcs(texts.slice(a, b - a))


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all texts of df by bucket. A task counts its texts in one array and sends at most a row a bucket."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, crcs, _ in _batches(batch, 0):
                counts += np.bincount(crcs % buckets, minlength=buckets)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found])], ["bucket", "n"])

    return df.select(col(text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of every bucket, in doubles."""
    S, T = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * S / ((source.get(b, 0) + 1) * T))) for b in range(buckets)], np.int64)


def noise(key: str, seed: int) -> int:
    """Gumbel noise in thousandths from the first eight hex digits of the key's hash."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


# runs


def _runs(gain: np.ndarray, least: int, seed: int):
    """Rows with weight and score. Those that may be drawn come as sorted runs of at most RUN_ROWS, numbered by task."""
    names = ["id", "n_features", "weight", "score", "run"]

    def batch_of(rows: np.ndarray, run: int | None) -> pa.RecordBatch:
        ids = pa.array(rows["id"], mask=rows["known"] == 0)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(np.ascontiguousarray(rows[c])) for c in ("n", "weight", "score")), pa.array([run] * len(rows), pa.int64())], names)

    def sorted_run(held: list[np.ndarray], run: int) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows["id"], -rows["known"], -rows["score"]))]
        for a in range(0, len(rows), 10_000):
            yield batch_of(rows[a : a + 10_000], run)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            ids = batch.column(0)
            for a, b, crcs, sizes in _batches(batch, 1):
                rows = np.zeros(b - a, _ROW)
                part = ids.slice(a, b - a)
                rows["id"], rows["known"], rows["n"] = part.fill_null(0).to_numpy(zero_copy_only=False), part.is_valid().to_numpy(zero_copy_only=False), sizes
                sums = np.concatenate([[0], np.cumsum(gain[crcs % len(gain)])])
                last = np.cumsum(sizes)
                rows["weight"] = np.where(sizes > 0, (sums[last] - sums[last - sizes]) // np.maximum(sizes, 1), 0)
                rows["score"] = rows["weight"] + [noise("" if i is None else str(i), seed) for i in part.to_pylist()]
                may = sizes >= least
                if not may.all():
                    yield batch_of(rows[~may], None)
                held.append(rows[may])
                n += len(held[-1])
                if n >= RUN_ROWS:
                    yield from sorted_run(held, number)
                    number, held, n = number + 1, [], 0
        if n:
            yield from sorted_run(held, number)

    return run


# merging


class Tournament:
    """A winner tree over sorted streams: each inner node names the stream of the better head below it, so that the best
    of all is at the root and taking it replays one path. Streams may be fed while the tree stands."""

    def __init__(self) -> None:
        self.heads: list[tuple | None] = []
        self.tree: list[int] = []
        self.width = 0

    def _better(self, i: int, j: int) -> int:
        if j >= len(self.heads) or self.heads[j] is None:
            return i
        return j if i >= len(self.heads) or self.heads[i] is None or self.heads[j] < self.heads[i] else i

    def put(self, stream: int, head: tuple | None) -> None:
        """Sets a stream's head (None: nothing left for now); a stream beyond the tree's width doubles it."""
        while stream >= len(self.heads):
            self.heads.append(None)
        self.heads[stream] = head
        if stream >= self.width:
            self.width = 1 << stream.bit_length()
            self.tree = [0] * self.width + list(range(self.width))
            for node in range(self.width - 1, 0, -1):
                self.tree[node] = self._better(self.tree[2 * node], self.tree[2 * node + 1])
            return
        node = (self.width + stream) >> 1
        while node:
            self.tree[node] = self._better(self.tree[2 * node], self.tree[2 * node + 1])
            node >>= 1

    def best(self) -> int | None:
        """The stream whose head comes first."""
        if not self.width:
            return None
        stream = self.tree[1]
        return stream if stream < len(self.heads) and self.heads[stream] is not None else None


def merged(blocks: Iterator[tuple[int, list]], most: int) -> Iterator[tuple[tuple, bool]]:
    """The rows of sorted blocks (stream, rows), each with whether it is among the first `most`: these come in order, and
    once they are complete the merge ends and the rest follows as it lies. Blocks come in the order of their first rows
    and each stream's follow each other, so only those are in memory whose rows stand between the last one given and the
    next block's first."""
    tree, queues, streams = Tournament(), [], {}
    waiting = next(blocks, None)
    for _ in range(most):
        at = tree.best()
        while waiting is not None and (at is None or waiting[1][0] <= tree.heads[at]):
            i = streams.setdefault(waiting[0], len(streams))
            if i == len(queues):
                queues.append([])
            queues[i].insert(0, waiting[1][::-1])
            if len(queues[i]) == 1:
                tree.put(i, queues[i][-1][-1])
            waiting, at = next(blocks, None), tree.best()
        if at is None:
            return
        rows = queues[at][-1]
        yield rows.pop(), True
        if not rows:
            queues[at].pop()
        tree.put(at, queues[at][-1][-1] if queues[at] else None)
    for rows in (r for q in queues for r in q):
        yield from ((r, False) for r in rows)
    while waiting is not None:
        yield from ((r, False) for r in waiting[1])
        waiting = next(blocks, None)


#: A block: its range and run, its first and last row's place in the order, its rows.
_ORDER = ["score", "known", "id"]
_BLOCK_NAMES = ["range", "run", *[f"{c}{end}" for end in (0, 1) for c in _ORDER], "rows"]
_BLOCK = "range int, run long, score0 long, known0 long, id0 long, score1 long, known1 long, id1 long, rows binary"


def _blocks(firsts: list[int]):
    """Rows of runs, as they lie in their files, as blocks of one run and one range of scores; range r ends with score firsts[r]."""
    lows = -np.array(firsts, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, runs = batch.column(0), batch.column(4).to_numpy(zero_copy_only=False)
            rows = np.zeros(len(batch), _ROW)
            rows["id"], rows["known"] = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
            rows["n"], rows["weight"], rows["score"] = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            place = np.searchsorted(lows, -rows["score"], side="left")
            new = np.flatnonzero((np.diff(runs) != 0) | (np.diff(place) != 0)) + 1
            cuts = sorted({0, len(rows), *new.tolist(), *range(0, len(rows), BLOCK_ROWS)})
            parts = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
            ends = [a for a, _ in parts], [b - 1 for _, b in parts]
            keys = [pa.array(rows[c][e]) for e in ends for c in _ORDER]
            yield pa.RecordBatch.from_arrays([pa.array(place[ends[0]], pa.int32()), pa.array(runs[ends[0]], pa.int64()), *keys, pa.array([rows[a:b].tobytes() for a, b in parts], pa.binary())], _BLOCK_NAMES)

    return run


_RANKED = "id long, n_features long, weight long, score long, rank long"


def _merge(before: list[int], want: int):
    """Blocks sorted by range and first row -> their rows with ranks: range r's begin after before[r]; rows after rank `want` have none."""
    names = [x.split()[0] for x in _RANKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for batch in batches:
                place, runs, data = (c.to_pylist() for c in batch.columns)
                for p, r, d in zip(place, runs, data, strict=True):
                    rows = np.frombuffer(d, _ROW)
                    yield p, r, list(zip((-rows["score"]).tolist(), (1 - rows["known"]).tolist(), rows["id"].tolist(), rows["n"].tolist(), rows["weight"].tolist(), strict=True))

        waiting = blocks()
        ahead = next(waiting, None)
        while ahead is not None:
            at = ahead[0]

            def of_range():
                nonlocal ahead
                while ahead is not None and ahead[0] == at:  # noqa: B023
                    block, ahead = ahead, next(waiting, None)
                    yield block[1], block[2]

            out: list[tuple] = []
            for i, ((s, unknown, key, n, w), drawn) in enumerate(merged(of_range(), max(0, want - before[at]))):
                out.append((None if unknown else key, n, w, -s, before[at] + i + 1 if drawn else None))
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return run


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """id_col (as long), n_features, weight, score and rank of every row of df; rank is null where a row is not drawn.

    Of the N rows with at least `least` words floor(percent * N / 100) are drawn, by descending score, then ascending id
    (null last). Every task sorts its rows that may be drawn into runs, written to the shared folder. Counts by score
    (integers within some 50,000 of 0 whatever the corpus, since gains are logarithms of its size) tell the score that
    the draw ends at and part what lies above into ranges of equal size; the runs' blocks of each range meet in one task,
    which merges them by a tournament tree and numbers them on from the range's start until the draw is complete. What
    lies below is never shuffled. Rows of one score share a range: with noise of a thousand steps that is at most some
    0.04 % of all rows, unless an id repeats. Rows that repeat score and id are ranked arbitrarily among themselves.

    Null, empty and blank texts have no features, weight 0 and no rank. Ids are numbers, or null, which hash as the empty
    text. Other columns, whatever their names, are not read. An empty target has no features; an empty df gives an
    empty result. Reruns agree.
    """
    spark = df.sparkSession
    ship(spark)
    counts = [{r.bucket: r.n for r in bucket_counts(x, c, buckets).collect()} for x, c in ((df, text_col), (target, target_col))]
    path = fresh_path(spark, "runs")
    schema = "id long, n_features long, weight long, score long, run long"
    df.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")).mapInArrow(_runs(gains(*counts, buckets), least, seed), schema).write.parquet(path)
    scored = spark.read.schema(schema).parquet(path)

    tally = sorted(((r.score, r.n) for r in scored.where("run IS NOT NULL").groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    want = sum(n for _, n in tally) * percent // 100
    most = max(1, min(RANGE_ROWS, -(-want // (4 * partitions(spark)))))
    firsts, before, ahead, inside = [], [], 0, 0
    for score, n in tally:
        if ahead >= want:
            break
        if not inside:
            firsts.append(score), before.append(ahead)
        firsts[-1], inside, ahead = score, inside + n, ahead + n
        inside = 0 if inside >= most else inside
    renamed = lambda x: x.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
    if not firsts:
        return renamed(scored.withColumn("rank", F.lit(None).cast("long")))
    drawn = (F.col("run").isNotNull()) & (F.col("score") >= firsts[-1])
    blocks = scored.where(drawn).mapInArrow(_blocks(firsts), _BLOCK)
    parts = min(partitions(spark), len(firsts))
    order = [c for end in (0, 1) for c in (F.col(f"score{end}").desc(), F.col(f"known{end}").desc(), f"id{end}")]
    ranked = blocks.repartition(parts, "range").sortWithinPartitions("range", *order).select("range", "run", "rows").mapInArrow(_merge(before, want), _RANKED)
    return renamed(scored.where(~drawn).drop("run").withColumn("rank", F.lit(None).cast("long")).unionByName(ranked))


def drawn_rows(df: DataFrame, ranks: DataFrame, id_col: str = "doc_id", rank: str = "rank") -> DataFrame:
    """The rows of df that were drawn, all their columns and their rank; an id that repeats in df is to be drawn once."""
    chosen = ranks.where(col(rank).isNotNull()).select(col(id_col).alias("__id"), col(rank).alias("__rank"))
    return df.join(chosen, col(id_col).cast("long").eqNullSafe(F.col("__id"))).withColumn(rank, F.col("__rank")).drop("__id", "__rank")
