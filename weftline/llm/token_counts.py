"""Token counts by heap-and-linked-list byte-pair merging, without identifiers."""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts, ship
from .vocabulary import CACHE_WORDS, SPACE, merge_ranks, tokenizer

#: A run without white space and the white space before it; or the white space at the end of a text.
_PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def merged_count(symbols: str, ranks: dict) -> int:
    """How many tokens byte-pair merging leaves of a word: its symbols less the merges.

    The heap holds (rank, position) of adjacent pairs, the leftmost of equal ranks first; two arrays link each symbol to
    its neighbours. A popped pair counts if both its symbols still are what they were.
    """
    n = len(symbols)
    if n < 2:
        return n
    part = list(symbols)
    heap = [(r[0], i, r[1]) for i in range(n - 1) if (r := ranks.get((part[i], part[i + 1])))]
    if not heap:
        return n
    heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    left = n
    while heap:
        rank, i, merged = heappop(heap)
        j = after[i]
        if j >= n or (r := ranks.get((part[i], part[j]))) is None or r[0] != rank:
            continue
        part[i], part[j] = merged, None
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if r := ranks.get((merged, part[k])):
                heappush(heap, (r[0], i, r[1]))
        h = before[i]
        if h >= 0 and (r := ranks.get((part[h], merged))):
            heappush(heap, (r[0], h, r[1]))
    return left


class Counter:
    """Counts of whole texts; counts of pieces are kept while they fit the cache."""

    def __init__(self, path: str, most: int = 2 * CACHE_WORDS):
        self.path, self.most = path, most
        self.ranks, special = merge_ranks(path)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}

    def _plain(self, segment: str) -> int:
        return sum(merged_count(word, self.ranks) for word, _ in tokenizer(self.path).pre_tokenizer.pre_tokenize_str(segment)) if segment else 0

    def piece(self, piece: str) -> int:
        """Special strings count as one token each; the rest is parted as the vocabulary's library does it."""
        parts = self.special.split(piece) if self.special else [piece]
        n = len(parts) - 1 + sum(map(self._plain, parts))
        if len(piece) <= 64:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[piece] = n
        return n

    def text(self, text: str | None) -> int:
        known, n = self.known, 0
        for piece in _PIECE.findall(text or ""):
            c = known.get(piece)
            n += self.piece(piece) if c is None else c
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, path: str, text_col: str = "text", limit: int | None = 1024, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """id_cols, n_bytes (UTF-8), n_tokens and, with a limit, over_limit = n_tokens > limit, one row for each row of df.

    Counts are those of the tokenizers library for the vocabulary file at path, which must be a byte-level one, without
    begin or end tokens; its special strings inside a text count as the one token that the library makes of them.
    Nothing is shuffled: each text is read whole where it lies. Null and empty texts count 0. A word of any length
    takes time in proportion to n log n. Rows repeat as they come; other columns, whatever their names, are not read.
    """
    ship(df.sparkSession)

    def counts():
        count = counter(path).text
        return lambda texts: [pc.binary_length(texts).fill_null(0).cast(pa.int64()), pa.array([count(t.as_py()) for t in texts], pa.int64())]

    out = over_texts(df, list(id_cols), text_col, counts, "n_bytes long, n_tokens long")
    return out if limit is None else out.withColumn("over_limit", F.col("n_tokens") > limit)
