"""Benchmark decontamination by greedy string tiling.

Documents and items are sequences of words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A document and an item
are compared if they share seeds, that is five words in a row (all words of a shorter item), enough of them to
reach the threshold. Tiling then repeatedly marks the longest common stretches that don't overlap, down to
seed length; as each tile may lie anywhere, reordered passages count in full. A document is contaminated if the
tiles cover at least ``THRESHOLD`` of an item's words.

Running Karp-Rabin hashes of one length tell where item and text agree on so many words. The longest length is found by
bisection, as a common stretch has common stretches of every lesser length; then all tiles of that length are marked in
order of the item, each hash's places in the text being passed once. The lengths of tiles differ at most
sqrt(2 x item words) times, so the cost is that many times log(item words) passes over the text, whatever repeats in it.

Items are read in blocks of at most ``BLOCK_WORDS`` words; each block is sent to the executors and held against all
documents, so what is sent has a fixed bound and no item or document is left out.

Edge cases: a null or empty text, or item, has no words and matches nothing; rows that repeat give rows that
repeat; a null id is kept in the result; of equally long stretches the first in the item, then in the text, is
marked; extra columns are ignored; an empty table gives an empty table. A long text is one sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from batchloom.llm.common import pieces, shingle_hashes, utf8_column, word_hashes

SEED, THRESHOLD = 5, 0.5
BLOCK_WORDS = 1_000_000
SCHEMA = "doc_id long, item_id long, item_words long, covered long, coverage double, n_tiles long, longest long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("covered", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("longest", pa.int64())])
#: Two prime moduli below 2^31 and a base for each; a pair of hashes is one number of 62 bits.
_MODULI, _BASES = (2_147_483_647, 2_147_483_629), (1_236_547_811, 987_654_319)


class Rolling:
    """Running Karp-Rabin hashes of all stretches of a sequence, of any length."""

    _powers: list[np.ndarray] = [np.ones(1, np.int64) for _ in _MODULI]

    def __init__(self, words: np.ndarray):
        self.n = words.size
        self.sums = []
        for k, mod in enumerate(_MODULI):
            power = self._power(k, self.n)
            sums = np.zeros(self.n + 1, np.int64)
            # Terms are below 2^31, so sums over up to 2^32 words don't overflow.
            np.cumsum((words + 1) * power % mod, out=sums[1:])
            self.sums.append(sums)

    @classmethod
    def _power(cls, k: int, n: int) -> np.ndarray:
        have, mod = cls._powers[k], _MODULI[k]
        while have.size < n:
            have = np.concatenate([have, have * int(have[-1] * _BASES[k] % mod) % mod])
        cls._powers[k] = have
        return have[:n]

    def hashes(self, at: np.ndarray, size: int, top: int) -> np.ndarray:
        """Of the stretches of ``size`` words from each place on; ``top`` is at least the last place of both sequences."""
        out = []
        for k, (sums, mod) in enumerate(zip(self.sums, _MODULI, strict=True)):
            out.append((sums[at + size] - sums[at]) % mod * self._power(k, top + 1)[top - at] % mod)
        return (out[0] << 31) | out[1]


def greedy_tiles(item: np.ndarray, text: np.ndarray, least: int, closed: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length): longest first, none overlapping, ``least`` words or more.

    Equally long ones come first in the item, then in the text. Words are numbers below 2^31 - 1; ``closed`` marks words
    of the text that can't be in a tile.
    """
    item, text = np.asarray(item, np.int64), np.asarray(text, np.int64)
    in_item, in_text = np.zeros(item.size, bool), np.zeros(text.size, bool) if closed is None else closed.copy()
    of_item, of_text, top = Rolling(item), Rolling(text), max(item.size, text.size)
    tiles: list[tuple[int, int, int]] = []

    def open_places(marked: np.ndarray, size: int) -> np.ndarray:
        """Where stretches of ``size`` words without a mark begin."""
        if marked.size < size:
            return np.zeros(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(marked)])
        return np.flatnonzero(sums[size:] == sums[:-size])

    def agreeing(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and hashes of open stretches of the text that are also in the item, and of the item's, both by hash and place."""
        p, t = open_places(in_item, size), open_places(in_text, size)
        hp, ht = of_item.hashes(p, size, top), of_text.hashes(t, size, top)
        order = np.argsort(hp, kind="stable")
        p, hp = p[order], hp[order]
        if not p.size:
            return p, hp, t[:0], ht[:0]
        common = hp[np.minimum(np.searchsorted(hp, ht), hp.size - 1)] == ht
        t, ht = t[common], ht[common]
        order = np.argsort(ht, kind="stable")
        return p, hp, t[order], ht[order]

    most = min(item.size, text.size)
    while most >= least:
        low, high = least - 1, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if agreeing(middle)[2].size else (low, middle - 1)
        if low < least:
            break
        p, hp, t, ht = agreeing(low)
        shared = np.isin(hp, ht)
        p, hp = p[shared], hp[shared]
        begin, end = np.searchsorted(ht, hp), np.searchsorted(ht, hp, side="right")
        in_order = np.argsort(p, kind="stable")
        passed: dict[int, int] = {}
        free = 0
        for i in in_order.tolist():
            at = int(p[i])
            if at < free:
                continue
            where, stop = passed.get(int(begin[i]), int(begin[i])), int(end[i])
            # A place is shut for good once a tile of this length has one of its ends.
            while where < stop and (in_text[t[where]] or in_text[t[where] + low - 1]):
                where += 1
            found = where
            while found < stop and not np.array_equal(item[at : at + low], text[t[found] : t[found] + low]):
                found += 1
            passed[int(begin[i])] = where
            if found < stop and not (in_text[t[found]] or in_text[t[found] + low - 1]):
                place = int(t[found])
                in_item[at : at + low] = in_text[place : place + low] = True
                tiles.append((at, place, low))
                free = at + low
        most = low - 1
    return tiles


class Items:
    """A block of items: their words, and which items have each seed."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        data, offsets = utf8_column(pa.array([t for _, t in rows], pa.string()))
        words, counts = word_hashes(data, offsets)
        ends = np.cumsum(counts)
        self.ids, self.sizes = [i for i, _ in rows], counts
        self.words = [words[e - c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
        seeds, have = shingle_hashes(words, counts, SEED)
        owner = np.repeat(np.arange(len(rows)), have)
        short = np.repeat(counts < SEED, have)
        self.seeds = np.split(seeds, np.cumsum(have)[:-1])
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        # An item shorter than a seed is looked for as stretches of its own length.
        for size in sorted({SEED, *counts[(counts > 0) & (counts < SEED)].tolist()}):
            mine = short & (counts[owner] == size) if size < SEED else ~short
            order = np.lexsort((owner[mine], seeds[mine]))
            s, o = seeds[mine][order], owner[mine][order]
            new = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (o[1:] != o[:-1]))[: s.size])
            self.by_size[size] = (s[new], o[new], np.diff(np.append(new, s.size)))


def _candidates(items: Items, words: np.ndarray, counts: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Texts and items that share enough seeds: both numbers, the seed's size and the seeds' places in the text."""
    begins = np.cumsum(counts) - counts
    for size, (seeds, owners, times) in items.by_size.items():
        shingles, have = shingle_hashes(words, counts, size)
        if not shingles.size or not seeds.size:
            continue
        hit = np.flatnonzero(seeds[np.minimum(np.searchsorted(seeds, shingles), seeds.size - 1)] == shingles)
        ends = np.cumsum(have)
        doc = np.searchsorted(ends, hit, side="right")
        whole = counts[doc] >= size
        hit, doc = hit[whole], doc[whole]
        if not hit.size:
            continue
        # Every seed counts once per text, however often it is there.
        order = np.lexsort((shingles[hit], doc))
        d, s = doc[order], shingles[hit][order]
        new = np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1]))
        d, s = d[new], s[new]
        lo, hi = np.searchsorted(seeds, s), np.searchsorted(seeds, s, side="right")
        total = np.cumsum(hi - lo)
        entry = np.repeat(lo - (total - (hi - lo)), hi - lo) + np.arange(int(total[-1]))
        d, owner, n = np.repeat(d, hi - lo), owners[entry], times[entry]
        order = np.lexsort((owner, d))
        d, owner, n = d[order], owner[order], n[order]
        first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (owner[1:] != owner[:-1])))
        # A tile of k words has k - size + 1 of the item's seeds, so at most size words for each of them.
        enough = size * np.add.reduceat(n, first) >= threshold * items.sizes[owner[first]]
        for i in first[enough].tolist():
            a, b = np.searchsorted(doc, [d[i], d[i] + 1])
            mine = hit[a:b][np.isin(shingles[hit[a:b]], items.seeds[owner[i]])]
            yield int(d[i]), int(owner[i]), size, mine - (ends[d[i]] - have[d[i]]) + begins[d[i]]


def _scan(items: Items, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8_column(batch.column(1))
        ids, rows = batch.column(0).to_pylist(), []
        for a, b in pieces(offsets):
            words, counts = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for doc, owner, size, places in _candidates(items, words, counts, threshold):
                # Only words in shared seeds can be in a tile, so the text is cut down to them.
                spots = np.unique((places[:, None] + np.arange(size)).ravel())
                item = items.words[owner]
                known, numbers = np.unique(item, return_inverse=True)
                if np.isin(item, words[spots]).sum() < threshold * item.size:
                    continue
                gap = np.flatnonzero(np.diff(spots) > 1) + 1
                text = np.insert(np.searchsorted(known, words[spots]), gap, 0)
                closed = np.insert(np.zeros(spots.size, bool), gap, True)
                tiles = greedy_tiles(numbers, text, size, closed)
                covered = sum(k for _, _, k in tiles)
                if covered >= threshold * item.size:
                    rows.append((ids[a + doc], items.ids[owner], item.size, covered, covered / item.size, len(tiles), max(k for _, _, k in tiles)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append(tuple(row))
        size += len((row[1] or "").split()) + 1
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document and item it contains: words covered, coverage, tiles and the longest tile."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for block in _blocks(benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), "text")):
        sent = spark.sparkContext.broadcast(Items(block))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            return _scan(sent.value, threshold, batches)

        out = out.unionByName(texts.mapInArrow(run, SCHEMA))
    return out
