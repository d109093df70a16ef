"""Token counts by heap-and-linked-list byte-pair merging.

Each pre-token's bytes form a doubly linked list; a heap holds the adjacent pairs that the vocabulary
can merge. The lowest rank, leftmost first, is popped and merged until the heap is empty, so the count is
the number of initial symbols minus the number of merges. No token identifiers are made.

Edge cases: null or empty texts count 0; a special token's string in a text counts as one token, as the
library does by default; a very long pre-token costs O(n log n) and is not remembered; repeated rows give
equal rows; an empty table gives an empty table; extra columns are ignored. Lone surrogates can't occur in
Spark strings. Executors open the vocabulary file at the path given, as they do the library's own files.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the published byte-level splitting pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBER, REMEMBER_CHARS = 200_000, 48
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

_counters: dict[str, BytePairCounter] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    shown = {b: chr(b) for b in plain}
    return [shown[b] if b in shown else chr(next(spare)) for b in range(256)]


class Memory:
    """Counts of recent strings in two generations: when the young one is full, it replaces the old one."""

    def __init__(self, make):
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.make = make

    def miss(self, key: str) -> int:
        count = self.old.get(key)
        if count is None:
            count = self.make(key)
        if len(key) <= REMEMBER_CHARS:
            if len(self.young) >= REMEMBER:
                self.old, self.young = self.young, {}
            self.young[key] = count
        return count

    def total(self, keys: list[str]) -> int:
        out = 0
        for key in keys:
            count = self.young.get(key)
            out += self.miss(key) if count is None else count
        return out


class BytePairCounter:
    """Counts the tokens of texts under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names: dict[str, int] = {s: i for i, s in enumerate(byte_symbols())}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank.setdefault(names.setdefault(a, len(names)) << 20 | names.setdefault(b, len(names)), rank)
            self.made.append(names.setdefault(a + b, len(names)))
        self.none = len(self.made)
        special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.markers = special
        self.split = regex.compile(PATTERN).findall
        self.pieces = Memory(self._piece)
        self.words = Memory(lambda word: self.pieces.total(self.split(" " + word)))
        self.uneven = re.compile(r"\s ").search

    def merges(self, symbols: bytes) -> int:
        """How many merges a pre-token's bytes undergo."""
        n, none, made, rank = len(symbols), self.none, self.made, self.rank.get
        if n < 2:
            return 0
        value = list(symbols)
        right = list(range(1, n + 1))
        left = list(range(-1, n - 1))
        pair = [rank(a << 20 | b, none) for a, b in zip(value, value[1:], strict=False)]
        pair.append(none)
        # An entry is rank * n + place, so ties fall to the leftmost; it holds while the pair there has that rank.
        heap = [r * n + i for i, r in enumerate(pair) if r < none]
        heapq.heapify(heap)
        done = 0
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if pair[i] != r:
                continue
            done += 1
            j = right[i]
            value[i] = made[r]
            pair[j] = none
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                pair[i] = r = rank(value[i] << 20 | value[k], none)
                if r < none:
                    heapq.heappush(heap, r * n + i)
            else:
                pair[i] = none
            h = left[i]
            if h >= 0:
                pair[h] = r = rank(value[h] << 20 | value[i], none)
                if r < none:
                    heapq.heappush(heap, r * n + h)
        return done

    def _piece(self, piece: str) -> int:
        raw = piece.encode()
        return len(raw) - self.merges(raw)

    def _plain(self, text: str) -> int:
        # A space after a character that isn't white always starts a pre-token, so words can be counted alone.
        # White space before a space is split by looking ahead; such texts go through the pattern whole.
        if self.uneven(text):
            return self.pieces.total(self.split(text))
        first, *rest = text.split(" ")
        return self.pieces.total(self.split(first)) + self.words.total(rest)

    def count(self, text: str) -> int:
        if self.special is None or not any(m in text for m in self.markers):
            return self._plain(text)
        marks = self.special.findall(text)
        return len(marks) + sum(map(self._plain, self.special.split(text)))


def counter(path: str) -> BytePairCounter:
    """One counter per worker process and vocabulary file."""
    if path not in _counters:
        _counters[path] = BytePairCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text; ``over_limit`` where it has more than ``limit`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in batches:
            ids, texts = batch.columns
            tokens = [count(t.as_py() or "") for t in texts]
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
