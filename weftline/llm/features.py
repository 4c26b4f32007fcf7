"""Features of whole texts for the linear models."""

from __future__ import annotations

import zlib
from collections import Counter
from math import log1p

import numpy as np

# quality

_CLASS = np.full(256, 6, np.int64)
for _chars, _n in ((range(ord("a"), ord("z") + 1), 0), (range(ord("A"), ord("Z") + 1), 1), (range(ord("0"), ord("9") + 1), 2), (b" \t\n\r\x0b\x0c", 3), (b".,;:'\"?-()", 4), (range(128, 256), 5)):
    for _c in _chars:
        _CLASS[_c] = _n

QUALITY_FEATURES = ("lower", "upper", "digit", "space", "plain_punctuation", "non_ascii", "symbol", "length", "words", "word_length", "repeats", "distinct_curve", "commonest", "symbol_words", "upper_words", "long_words", "entropy", "lines", "repeated_lines", "sentence_ends", "pipes", "bangs", "short", "pair_repeats", "adjacent_repeats")
#: Shares are of this many more bytes or words than a text has, so that those of a very short one say little.
MORE_BYTES, MORE_WORDS = 20, 5


def quality_features(text: str | None) -> list[float]:
    """Shares and rates that say how a text is written, in the order of QUALITY_FEATURES; all finite, for any text."""
    raw = (text or "").encode()
    n = len(raw) + MORE_BYTES
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.bincount(_CLASS, weights=counts, minlength=7) / n
    ws = raw.split()
    m = len(ws) + MORE_WORDS
    often = Counter(ws)
    p = counts[counts > 0] / max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = Counter(w[-1] for w in ws)
    pairs = list(zip(ws, ws[1:], strict=False))
    return [
        *share.tolist(), log1p(len(raw)), log1p(len(ws)), sum(map(len, ws)) / m, (len(ws) - len(often)) / m, log1p(len(often)) / max(1.0, log1p(len(ws))), (max(often.values(), default=1) - 1) / m, sum(ends[c] for c in b"*#$%&!|@~^+=_<>") / m, sum(1 for w in ws if len(w) > 2 and w.isupper()) / m,
        sum(1 for w in ws if len(w) > 25) / m, float(-(p * np.log2(p)).sum()), len(lines) / m, (len(lines) - len(set(lines))) / (len(lines) + 1), sum(ends[c] for c in b".?!") / m, counts[ord("|")] / m, counts[ord("!")] / m, 1 / m,
        (len(pairs) - len(set(pairs))) / m, sum(1 for a, b in pairs if a == b) / m,
    ]


# toxicity

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)
_STRIP = ".,;:!?|*#$%&\"'()[]{}<>-_…«»“”„¿¡"


def _slots_of(word: str) -> tuple[int, ...]:
    bare = word.strip(_STRIP)
    if not bare:
        return ()
    forms = [f"={bare}", *(f"^{bare[:k]}" for k in PREFIXES if len(bare) >= k)]
    return tuple(zlib.crc32(f.encode()) & (BUCKETS - 1) for f in forms)


class TermSlots:
    """The slots of the whole words and of the words' beginnings that a text has, each once however often it comes.

    With `only`, just those slots. Slots of words are kept while they fit the cache.
    """

    def __init__(self, only: frozenset[int] | None = None, most: int = 400_000):
        self.only, self.most = only, most
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> set[int]:
        found: set[int] = set()
        known = self.known
        for word in set((text or "").lower().split()):
            slots = known.get(word)
            if slots is None:
                slots = _slots_of(word)
                if self.only is not None:
                    slots = tuple(x for x in slots if x in self.only)
                if len(word) <= 40:
                    if len(known) >= self.most:
                        known.clear()
                    known[word] = slots
            if slots:
                found.update(slots)
        return found
