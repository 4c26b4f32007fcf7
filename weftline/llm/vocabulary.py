"""Public tokenizers inside Python workers: loaded once a process, words encoded once while a bounded cache holds them."""

from __future__ import annotations

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of the vocabularies' patterns, as their library has it (a subset of str.split's).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: str.split also parts at these; texts that hold one are split by the pattern.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
_RUN = re.compile(f"[^{SPACE}]+")
#: Words that a worker's cache holds before it starts anew: about 80 MB.
CACHE_WORDS = 400_000
#: The same for the encoder of whole streams, whose entries are smaller: about 120 MB.
STREAM_WORDS = 700_000


def words(text: str) -> list[str]:
    """Maximal runs without white space. No token of a word vocabulary spans two of them."""
    if any(c in text for c in ODD_SPACE):
        return _RUN.findall(text)
    return text.split()


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def pieces(path: str) -> list[str]:
    """The piece of each id: the id-to-piece table of a vocabulary file, tens of thousands of rows whatever the corpus."""
    t = tokenizer(path)
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]


def id_type(path: str) -> str:
    return "<u2" if len(pieces(path)) <= 1 << 16 else "<u4"


#: A run of Latin letters whose lower case is a letter for a letter, and ASCII punctuation after it (no apostrophe, which
#: may begin a suffix of its own, and no "<", which may begin a special string): two words of the vocabularies' patterns.
_SIMPLE = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:;=-@\\[-`{-~]*)")


@lru_cache(maxsize=4)
def _last_pieces(path: str) -> np.ndarray:
    return np.array([p.endswith("</w>") for p in pieces(path)])


class WordEncoder:
    """ids of words as little-endian bytes. Each word goes to the library once.

    Letters are parted from punctuation after them, and such stems meet the library joined by spaces: the piece that ends
    a word tells them apart again. All other words go to it as they are.
    """

    def __init__(self, path: str, dtype: str = "<u4"):
        self.path, self.dtype = path, dtype
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def add(self, new) -> None:
        whole, stems, made = [], set(), []
        for word in new:
            m = _SIMPLE.fullmatch(word)
            if m is None:
                whole.append(word)
                continue
            stem, rest = m[1].lower(), m[2]
            made.append((word, stem, rest))
            if stem not in self.stems:
                stems.add(stem)
            if rest and rest not in self.stems:
                whole.append(rest)
                self.stems[rest] = b""
        self._add_stems(list(stems))
        t = tokenizer(self.path)
        for at in range(0, len(whole), 20_000):
            part = whole[at : at + 20_000]
            for word, e in zip(part, t.encode_batch_fast(part, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.dtype).tobytes()
                if word in self.stems:
                    self.stems[word] = ids
                self.known[word] = ids
        known, table = self.known, self.stems
        for word, stem, rest in made:
            known[word] = table[stem] + table[rest] if rest else table[stem]

    def _add_stems(self, stems: list[str]) -> None:
        t, wide = tokenizer(self.path), int(self.dtype[2])
        for at in range(0, len(stems), 2_000):
            part = stems[at : at + 2_000]
            ids = np.array(t.encode(" ".join(part), add_special_tokens=False).ids, self.dtype)
            ends = (np.flatnonzero(_last_pieces(self.path)[ids]) + 1) * wide
            if len(ends) != len(part):
                raise ValueError(f"{self.path} does not end words with </w>")
            raw, ends = ids.tobytes(), ends.tolist()
            for stem, a, b in zip(part, [0, *ends[:-1]], ends, strict=True):
                self.stems[stem] = raw[a:b]


class StreamEncoder:
    """ids of many whole texts at once, in Arrow and numpy: only what is new to the cache meets the library."""

    _PATTERN = "^(?P<stem>[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)(?P<rest>[!-&(-/:;=-@\\[-`{-~]*)$"

    def __init__(self, path: str, most: int = STREAM_WORDS):
        self.path, self.most, self.dtype = path, most, id_type(path)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.size, self.used = 1, 0
        self.start, self.length, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, self.dtype)

    def _append(self, names: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.size + len(names) > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        here = slice(self.size, self.size + len(names))
        self.start[here], self.length[here] = self.used + np.cumsum(lengths) - lengths, lengths
        self.index.update(zip(names, range(self.size, self.size + len(names)), strict=True))
        self.size, self.used = self.size + len(names), self.used + len(ids)

    def _places(self, names: pa.Array, stems: bool) -> np.ndarray:
        if not len(names):
            return np.empty(0, np.int64)
        coded = names.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        places = np.array(list(map(self.index.get, distinct)), np.float64)  # nan: new
        missing = np.flatnonzero(np.isnan(places))
        new = [distinct[i] for i in missing.tolist()]
        places[missing] = self.size + np.arange(len(new))
        t = tokenizer(self.path)
        for at in range(0, len(new), 4_000):
            part = new[at : at + 4_000]
            if stems:
                ids = np.array(t.encode(" ".join(part), add_special_tokens=False).ids, self.dtype)
                ends = np.flatnonzero(_last_pieces(self.path)[ids]) + 1
                if len(ends) != len(part):
                    raise ValueError(f"{self.path} does not end words with </w>")
                self._append(part, ids, np.diff(ends, prepend=0))
            else:
                found = [e.ids for e in t.encode_batch_fast(part, add_special_tokens=False)]
                self._append(part, np.array([x for ids in found for x in ids], self.dtype), np.array([len(x) for x in found]))
        return places.astype(np.int64)[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's end. A null has none. Words are runs without ASCII white
        space; other white space parts words inside a run, as the library sees to."""
        if len(self.index) > self.most:
            self._forget()
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        distinct, at = coded.dictionary, coded.indices.to_numpy()
        parted = pc.extract_regex(distinct, self._PATTERN)
        simple = pc.is_valid(parted)
        mask = simple.to_numpy(zero_copy_only=False)
        first, second = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        inside = parted.filter(simple)
        first[mask] = self._places(pc.utf8_lower(pc.struct_field(inside, "stem")), True)
        second[mask] = self._places(pc.struct_field(inside, "rest"), False)
        first[~mask] = self._places(distinct.filter(pc.invert(simple)), False)
        both = np.stack([first[at], second[at]], 1).reshape(-1)
        n = self.length[both]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[both] - (ends - n), n) + np.arange(total)]
        word_ends = np.concatenate([[0], ends[1::2]]).astype(np.int64)
        offsets = split.offsets.to_numpy()
        return ids, word_ends[offsets[1:] - offsets[0]]


@lru_cache(maxsize=2)
def stream_encoder(path: str) -> StreamEncoder:
    """One a process, so that its cache lasts as long as the worker."""
    return StreamEncoder(path)


@lru_cache(maxsize=4)
def merge_ranks(path: str) -> tuple[dict[tuple[str, str], tuple[int, str]], tuple[str, ...]]:
    """For each pair that a byte-pair vocabulary merges its rank and what it becomes; and the special strings."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in data["model"]["merges"]]
    return {p: (rank, p[0] + p[1]) for rank, p in enumerate(pairs)}, tuple(t["content"] for t in data["added_tokens"])


def slices(sizes: list[int], most: int):
    """Index ranges of consecutive texts of about so many characters together; a longer text stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)
