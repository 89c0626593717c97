"""Byte-level BPE of a whole corpus by batched numpy merge rounds (problem 7).

The symbols of many distinct words lie in one flat array. Each round looks up every adjacent pair by
binary search over the sorted pair keys of the vocabulary, takes each word's pair of lowest rank and
merges all its occurrences at once, until no word has a known pair. Words are cut from the texts by
the vocabulary's public pattern; a word is encoded once per worker and then remembered.

Defined results: a null text and an empty text give the ids passed as ``null_ids`` and ``empty_ids``
(both the empty list by default); blanks are ordinary text; strings that look like special tokens are
ordinary text; a text of any length is encoded whole; repeated rows are encoded each. Columns other
than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.session import ship

#: Where the public vocabularies lie; a parameter of every function that needs one.
TOKENIZERS = "/opt/tokenizers"

#: Fixed value: the public pattern that cuts text into words before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters of text whose words are held at once, and words a worker remembers.
CHUNK_CHARS, REMEMBERED = 1 << 18, 1 << 20

#: Classes of characters in PATTERN.
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file.

    Printable bytes stand for themselves; the others get the code points from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of every code point, by the definitions of the pattern's own library."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for match in regex.finditer(name, every):
            table[match.start() : match.end()] = kind
    return table


def word_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the words of PATTERN start in texts that lie one after the other.

    ``points`` are code points, ``text_starts`` the places of the first character of each text that
    has one. Words are runs of one class; a blank before a run that is no white space belongs to it;
    of other white space the last character stands alone when text follows; after a lone apostrophe
    the endings of PATTERN are cut off.
    """
    n = len(points)
    kind = character_classes()[points]
    text_start = np.zeros(n + 1, bool)
    text_start[text_starts] = True
    text_start[n] = True
    change = text_start[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = np.append(change, True)
    run = np.flatnonzero(start)  # the last entry is the end of the last text
    follows = run[1:-1][(kind[run[1:-1] - 1] == SPACE) & ~text_start[run[1:-1]]]  # runs after white space
    start[follows[points[follows - 1] == 32]] = False
    start[follows - 1] = True
    lone = run[:-1][(np.diff(run) == 1) & (points[run[:-1]] == 39)]
    lone = lone[text_start[lone] | (points[lone - 1] != 32)]
    lone = lone[(lone + 1 < n) & ~text_start[lone + 1]]
    one = lone[np.isin(points[lone + 1], [ord(c) for c in "stmd"])]
    pair = lone[lone + 2 < n]
    pair = pair[~text_start[pair + 2]]
    code = points[pair + 1].astype(np.int64) << 32 | points[pair + 2]
    two = pair[np.isin(code, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]
    start[one + 1] = start[two + 1] = False
    start[one + 2] = start[two + 3] = True
    return np.flatnonzero(start)


class Memory(dict):
    """Gives every new word the next code."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.fresh.append(word)
        return code


class MergeTable:
    """Pair keys of a vocabulary, sorted, with the rank and the merged id of each pair."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            model = json.load(source)["model"]
        vocabulary, letters = model["vocab"], byte_letters()
        self.size = np.int64(max(vocabulary.values()) + 1)
        self.byte_id = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.byte_id[byte] = vocabulary[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)[order]
        self.none = np.int64(len(pairs))

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``none`` where the pair is unknown) and place in the table of each pair."""
        keys = left * self.size + right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.rank[at], self.none), at

    def encode(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each word has."""
        lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_owner, done_symbols = [], []
        while len(symbols):
            inside = owner[1:] == owner[:-1]
            rank, at = self.look_up(symbols[:-1], symbols[1:])
            rank = np.append(np.where(inside, rank, self.none), self.none)
            first = np.flatnonzero(np.append(True, ~inside))
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbols)))
            alive = np.repeat(lowest < self.none, sizes)
            if not alive.all():  # words without a known pair are ready
                done_owner.append(owner[~alive])
                done_symbols.append(symbols[~alive])
            hit = alive & (rank == np.repeat(lowest, sizes))
            places = np.flatnonzero(hit)
            if len(places):
                # of overlapping occurrences (a run of one symbol) every second one is merged
                run_start = np.append(True, np.diff(places) != 1)
                run = np.cumsum(run_start) - 1
                offset = np.arange(len(places)) - np.flatnonzero(run_start)[run]
                places = places[offset % 2 == 0]
                symbols = symbols.copy()
                symbols[places] = self.merged[at[places]]
                alive[places + 1] = False
            symbols, owner = symbols[alive], owner[alive]
        if not done_owner:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(owner, minlength=len(words))


class Encoder:
    """Encodes batches of texts and remembers the words it has met."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.forget()

    def forget(self) -> None:
        self.known = Memory()
        self.ids, self.used, self.filled = np.zeros(1 << 16, np.int32), 0, 0
        self.start, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def learn(self) -> None:
        words, self.known.fresh = self.known.fresh, []
        ids, counts = self.table.encode([w.encode("utf-8") for w in words])
        n, m = self.filled, self.filled + len(words)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while m > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[n:m] = self.used + np.cumsum(counts) - counts
        self.count[n:m] = counts
        self.used, self.filled = self.used + len(ids), m

    def codes(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all words of the texts in the memory, and the number of words of each text."""
        if len(self.known) > REMEMBERED:
            self.forget()
        sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        joined = "".join(t for t in texts if t)
        if not joined:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = word_starts(points, (ends - sizes)[sizes > 0])
        places = bounds.tolist()
        words = [joined[a:b] for a, b in zip(places, places[1:])]
        codes = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.fresh:
            self.learn()
        return codes, np.diff(np.searchsorted(bounds, ends), prepend=0)

    def counts(self, texts: Sequence[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        codes, words = self.codes(texts)
        total = np.append(0, np.cumsum(self.count[codes]))
        ends = np.cumsum(words)
        return total[ends] - total[ends - words]

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        codes, words = self.codes(texts)
        count = self.count[codes]
        total = np.append(0, np.cumsum(count))
        ends = np.cumsum(words)
        shift = np.repeat(self.start[codes] - total[:-1], count)
        return self.ids[shift + np.arange(total[-1])], total[ends] - total[ends - words]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, one per worker process."""
    return Encoder(path)


def chunks(texts: Sequence[str | None]) -> Iterator[slice]:
    """Slices of the texts of about CHUNK_CHARS characters; a longer text is a slice of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= CHUNK_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode_documents(
    documents: DataFrame,
    vocabulary: str = "byte_bpe_50k",
    id_col: str = "doc_id",
    text_col: str = "text",
    null_ids: Sequence[int] = (),
    empty_ids: Sequence[int] = (),
    tokenizers: str = TOKENIZERS,
) -> DataFrame:
    """``(id, ids array<int>)`` of every row of ``documents``: a map over the scan, without a shuffle."""
    ship(documents.sparkSession)
    path, null_list, empty_list = f"{tokenizers}/{vocabulary}.json", list(null_ids), list(empty_ids)
    id_type = documents.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for part in chunks(texts):
                ids, counts = coder.encode(texts[part])
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                if null_list or empty_list:
                    fixed = [null_list if t is None else empty_list if t == "" else None for t in texts[part]]
                    given = pa.array(fixed, pa.list_(pa.int32()))
                    lists = pc.if_else(pc.is_valid(given), given, lists)
                yield pa.RecordBatch.from_arrays([keys[part.start : part.stop], lists], [id_col, "ids"])

    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(kernel, f"`{id_col}` {id_type}, ids array<int>")


def count_tokens(
    documents: DataFrame,
    vocabulary: str = "byte_bpe_50k",
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizers: str = TOKENIZERS,
) -> DataFrame:
    """``(id, n_tokens int)`` of every row; null and empty texts have 0 tokens."""
    ship(documents.sparkSession)
    path = f"{tokenizers}/{vocabulary}.json"
    id_type = documents.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            parts = [coder.counts(texts[part]) for part in chunks(texts)]
            n = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int32))], [id_col, "n_tokens"])

    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(kernel, f"`{id_col}` {id_type}, n_tokens int")
