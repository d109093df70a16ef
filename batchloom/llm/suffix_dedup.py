"""Repeated passages: bytes covered by a 50-byte string that also starts in a document with a smaller id.

Texts are dealt to blocks by a hash of id and text once; everything else moves as packed arrays between blocks and buckets.

1. A block cuts its texts into runs of windows that share a minimizer: the smallest hash of the 24-byte strings in
   the window. Equal windows have equal minimizers, so they always meet in the bucket that the minimizer names.
   The block asks each bucket about its distinct minimizers; only those that occur in several documents matter.
2. For these the block sends each distinct run of bytes once, with the smallest and largest document that has it.
   A minimizer that very many documents have is not kept together: each of its windows goes to a bucket of its own.
3. A bucket joins its runs to one text and sorts the suffixes at window starts by two-stage sorting: those smaller
   than their successor are sorted directly, eight bytes at a time; scanning the first-byte buckets in order induces
   the others. Adjacent common prefixes then show which windows are equal, and the smallest document of each.
4. The block marks the windows whose smallest document is smaller than their own, and cuts the covered bytes.

Exact copies of a whole text are found first by SHA-256, very frequent ones in several tasks; they take no part, as
all their windows start in the first copy. The result is exact: hashes only choose where strings meet, bytes decide.

Edge cases: a null text is empty; texts under 50 bytes lose nothing; rows with the same id are the same document,
so they don't cut each other, whether their texts are equal or not; a row without an id neither cuts nor is cut; an empty table gives an empty
table; extra columns are ignored; a long text is many runs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm.common import mixed, pieces, spread_join, utf8_column, written

WINDOW, GRAM = 50, 24
SPAN = WINDOW - GRAM + 1
#: Bytes of text for a block, growing with the square root of the corpus up to the larger, and for a bucket.
BLOCK_BYTES, MOST_BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 32 << 20, 4 << 20
#: A minimizer in so many documents is dealt window by window.
HOT = 20_000

_OFFSETS = (0, 8, 16, 24, 32, 40, 42)
_MULT = np.random.default_rng(50).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_ASK = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary())])
_MAIL = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("id", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_SEND = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("lens", pa.binary()), ("least", pa.binary()), ("most", pa.binary()), ("bytes", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())])
ASK = "bucket int, block int, keys binary, docs binary"
MAIL = "block int, kind int, bucket int, id long, a binary, b binary, c binary, d binary"
SEND = "bucket int, block int, lens binary, least binary, most binary, bytes binary"
OUT = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"
COPY, FLAGS, ANSWER = 0, 1, 2


def _words(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from every place of ``data`` (which has padding) as one number."""
    return np.ndarray((data.size - 7,), f"{order}u8", data, strides=(1,))


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All numbers from each start on, ``lens`` of them."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)


# ---- suffix sorting -------------------------------------------------------------------------------------------


def _sort_directly(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``places`` in order of the 50 bytes from each on."""
    words = _words(text, ">")
    first = words[places].astype(np.uint64)
    order = np.argsort(first)
    places, first = places[order], first[order]
    tied = np.zeros(places.size + 1, bool)
    tied[1:-1] = first[1:] == first[:-1]
    for offset in _OFFSETS[1:]:
        at = np.flatnonzero(tied[1:] | tied[:-1])
        if not at.size:
            break
        group = np.cumsum(~tied[:-1][at])
        value = words[places[at] + offset].astype(np.uint64)
        order = np.lexsort((value, group))
        places[at] = places[at][order]
        value = value[order]
        # Group numbers don't move, as sorting stays inside groups.
        tied[at[1:]] &= value[1:] == value[:-1]
    return places


def suffix_order(text: np.ndarray, wanted: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """The places marked in ``wanted``, in order of the 50 bytes from each on, by two-stage sorting.

    ``text`` has 64 bytes of padding. ``lasts`` are the wanted places whose successor isn't wanted: what follows them, up
    to the next suffix smaller than its successor, is sorted along.
    """
    n = text.size - 64
    rises = text[:-1] < text[1:]
    level = text[:-1] == text[1:]
    here = np.where(level, text.size, np.arange(text.size - 1, dtype=np.int32))
    after = np.minimum.accumulate(here[::-1])[::-1]
    small = np.ones(text.size, bool)
    inner = after < text.size - 1
    small[:-1][inner] = rises[after[inner]]
    small[n:] = True
    next_small = np.minimum.accumulate(np.where(small, np.arange(text.size, dtype=np.int32), text.size)[::-1])[::-1]
    need = wanted.copy()
    chain = lasts[~small[lasts]]
    need[ranges(chain + 1, next_small[chain] - chain)] = True

    seeds = _sort_directly(text, np.flatnonzero(need & small))
    induced = need & ~small
    by_byte = np.searchsorted(text[seeds], np.arange(257))
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(places: np.ndarray, byte: int) -> np.ndarray | None:
        """Put the predecessors that are larger than these in their buckets; returns those of this bucket."""
        before = places[places > 0] - 1
        before = before[induced[before]]
        heads = text[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        cuts = np.flatnonzero(np.diff(heads)) + 1
        same = None
        for part in np.split(before, cuts) if before.size else ():
            if text[part[0]] == byte:
                same = part
            else:
                large[text[part[0]]].append(part)
        return same

    for byte in range(256):
        wave = np.concatenate(large[byte]) if large[byte] else None
        while wave is not None:
            out.append(wave)
            wave = induce(wave, byte)
        if by_byte[byte] < by_byte[byte + 1]:
            own = seeds[by_byte[byte] : by_byte[byte + 1]]
            out.append(own)
            induce(own, byte)
        large[byte] = []
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix in ``order`` shares with the one before it, 50 at most; 0 for the first."""
    words = _words(text)
    out = np.full(order.size, WINDOW, np.int8)
    if order.size:
        out[0] = 0
    at = np.arange(1, order.size)
    for offset in _OFFSETS:
        x = words[order[at] + offset] ^ words[order[at - 1] + offset]
        apart = x != 0
        low = x[apart]
        out[at[apart]] = offset + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) >> 3)
        at = at[~apart]
    return out


def first_documents(text: np.ndarray, lens: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The smallest document of every window of joined runs; ``lens`` counts the windows of each run."""
    starts = np.cumsum(lens + WINDOW - 1) - (lens + WINDOW - 1)
    places = ranges(starts, lens)
    wanted = np.zeros(text.size, bool)
    wanted[places] = True
    number = np.zeros(text.size, np.int32)
    number[places] = np.arange(places.size, dtype=np.int32)
    order = suffix_order(text, wanted, starts + lens - 1)
    heads = np.flatnonzero(common_prefixes(text, order) < WINDOW)
    window = number[order]
    docs = np.repeat(least, lens)[window]
    out = np.empty(places.size, np.int64)
    out[window] = np.repeat(np.minimum.reduceat(docs, heads), np.diff(np.append(heads, order.size)))
    return out


# ---- blocks ---------------------------------------------------------------------------------------------------


def minimizer_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of consecutive texts: key, first window, number of windows, and text."""
    n = data.size
    lens = np.diff(offsets)
    if n < WINDOW or not (lens >= WINDOW).any():
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    words = _words(np.concatenate([data, np.zeros(64, np.uint8)]))
    h = np.zeros(n, np.uint64)
    for j in range(GRAM // 8):
        w = words[8 * j : 8 * j + n] * _MULT[j]
        w ^= w >> np.uint64(32)
        h += w
        h *= _MULT[7]
        h ^= h >> np.uint64(29)
    least, width = h, 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: least.size - (SPAN - width)], least[SPAN - width :])
    valid = np.zeros(n + 1, np.int32)
    some = lens >= WINDOW
    np.add.at(valid, offsets[:-1][some], 1)
    np.add.at(valid, offsets[1:][some] - WINDOW + 1, -1)
    valid = np.cumsum(valid)[: n - WINDOW + 1] > 0
    least = least[: valid.size]
    new = np.empty(valid.size, bool)
    new[0] = True
    new[1:] = least[1:] != least[:-1]
    new[offsets[:-1][some]] = True
    starts = np.flatnonzero(new & valid)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], n), offsets[1:][doc] - WINDOW + 1)
    keys = mixed(least[starts])
    long = ends - starts
    parts = -(-long // SPAN)
    if (parts > 1).any():
        step = ranges(np.zeros(len(parts), np.int64), parts) * SPAN
        keys, doc, starts, ends = (np.repeat(x, parts) for x in (keys, doc, starts, ends))
        starts = starts + step
        long = np.minimum(ends - starts, SPAN)
    return keys, starts, long, doc


class Block:
    """The texts of one block in order of document, and their runs; the same in every pass."""

    def __init__(self, docs: pa.Table, mail: pa.Table, buckets: int):
        self.buckets = buckets
        docs = docs.select(["doc_id", "text"]).combine_chunks()
        docs = docs.take(pa.compute.sort_indices(docs, [("doc_id", "ascending"), ("text", "ascending")]))
        kind = mail.column("kind").to_numpy()
        copies = mail.filter(pa.array(kind == COPY)).select(["id", "a"])
        self.mail = {k: mail.filter(pa.array(kind == k)).sort_by("bucket") for k in (FLAGS, ANSWER)}
        self.ids = docs.column("doc_id")
        self.data, self.offsets = utf8_column(docs.column("text").combine_chunks())
        doc_ids = self.ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        self.copy = np.zeros(len(doc_ids), bool)
        # An id may have several texts, so a copy is known by its id and the SHA-256 of its text.
        prints = set(zip(copies.column("id").to_pylist(), copies.column("a").to_pylist(), strict=True))
        for i in np.flatnonzero(np.isin(doc_ids, copies.column("id").to_numpy())).tolist():
            text = self.data[self.offsets[i] : self.offsets[i + 1]]
            self.copy[i] = (int(doc_ids[i]), hashlib.sha256(text).digest()) in prints
        found = []
        for a, b in pieces(self.offsets):
            lo = self.offsets[a]
            keys, starts, lens, doc = minimizer_runs(self.data[lo : self.offsets[b]], self.offsets[a : b + 1] - lo)
            found.append((keys, starts + lo, lens, doc + a))
        self.keys, self.starts, self.lens, doc = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
        usable = ~(self.copy | self.ids.is_null().to_numpy())[doc]
        self.keys, self.starts, self.lens = self.keys[usable], self.starts[usable], self.lens[usable]
        self.doc = doc_ids[doc[usable]]
        order = np.lexsort((self.doc, self.keys))
        keys, ids = self.keys[order], self.doc[order]
        new = np.empty(keys.size, bool)
        new[:1] = True
        new[1:] = keys[1:] != keys[:-1]
        self.group = np.empty(keys.size, np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.distinct = keys[new]
        apart = new.copy()
        apart[1:] |= ids[1:] != ids[:-1]
        self.n_docs = np.add.reduceat(apart.astype(np.int64), np.flatnonzero(new)) if keys.size else np.zeros(0, np.int64)

    def strings(self) -> None:
        """The distinct runs of bytes whose minimizer several documents have."""
        flags = np.frombuffer(b"".join(self.mail[FLAGS].column("a").to_pylist()), np.uint8)
        mine = flags[self.group]
        keep, hot = mine > 0, mine == 2
        cold = keep & ~hot
        lens = self.lens[hot]
        starts = np.concatenate([self.starts[cold], ranges(self.starts[hot], lens)])
        doc = np.concatenate([self.doc[cold], np.repeat(self.doc[hot], lens)])
        length = np.concatenate([self.lens[cold], np.ones(int(lens.sum()), np.int64)])
        words = _words(np.concatenate([self.data, np.zeros(64, np.uint8)]))

        def window_hash(at: np.ndarray) -> np.ndarray:
            h = np.zeros(at.size, np.uint64)
            for j, offset in enumerate(_OFFSETS):
                h = mixed(h + words[at + offset] * _MULT[j])
            return h

        head, tail = window_hash(starts), window_hash(starts + length - 1)
        keys = np.concatenate([self.keys[cold], head[int(cold.sum()) :]])
        identity = mixed(head + mixed(tail + length.astype(np.uint64)))
        order = np.lexsort((doc, tail, identity, keys))
        new = np.empty(order.size, bool)
        new[:1] = True
        k, i, t = keys[order], identity[order], tail[order]
        new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (t[1:] != t[:-1])
        at = np.flatnonzero(new)
        self.s_start, self.s_doc, self.s_len, self.s_first = starts[order], doc[order], length[order], at
        self.s_count = np.diff(np.append(at, order.size))
        self.s_keys = k[new]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def used_buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted keys name, and where each one's keys begin, with the end."""
    of = bucket_of(keys, buckets)
    at = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: of.size])
    return of[at].astype(np.int32), np.append(at, of.size)


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Stretches of an array, from each cut to the next, as binary values."""
    values = np.ascontiguousarray(values)
    offsets = ((cuts - cuts[0]) * values.itemsize).astype(np.int32) if cuts.size else np.zeros(1, np.int32)
    part = values[cuts[0] : cuts[-1]] if cuts.size else values[:0]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(part.tobytes())])


def _rows(schema: pa.Schema, n: int, **columns) -> pa.Table:
    """``n`` rows of arrays, or of one value for all; columns that aren't given are null."""
    def made(f: pa.Field) -> pa.Array:
        value = columns.get(f.name)
        if value is None:
            return pa.nulls(n, f.type)
        return value if isinstance(value, pa.Array) else pa.array(np.broadcast_to(value, n), f.type)

    return pa.Table.from_arrays([made(f) for f in schema], schema=schema)


def _ask(buckets: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, mail: pa.Table) -> pa.Table:
        block = Block(docs, mail, buckets)
        bucket, cuts = used_buckets(block.distinct, buckets)
        docs_ = np.minimum(block.n_docs, 65535).astype(np.uint16)
        return _rows(_ASK, bucket.size, bucket=bucket, block=key[0].as_py(), keys=packed(block.distinct, cuts), docs=packed(docs_, cuts))

    return run


def _flag(key: tuple[pa.Scalar, ...], asked: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, np.uint64) for x in asked.column("keys").to_pylist()]
    keys = np.concatenate(parts)
    docs = np.concatenate([np.frombuffer(x, np.uint16) for x in asked.column("docs").to_pylist()]).astype(np.int64)
    order = np.argsort(keys)
    k = keys[order]
    new = np.empty(k.size, bool)
    new[0] = True
    new[1:] = k[1:] != k[:-1]
    total = np.add.reduceat(docs[order], np.flatnonzero(new))
    flags = np.empty(k.size, np.uint8)
    flags[order] = np.repeat((total > 1).astype(np.uint8) + (total >= HOT), np.diff(np.append(np.flatnonzero(new), k.size)))
    cuts = np.append(0, np.cumsum([p.size for p in parts]))
    return _rows(_MAIL, len(parts), block=asked.column("block").to_numpy(), kind=FLAGS, bucket=key[0].as_py(), a=packed(flags, cuts))


def _send(buckets: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, mail: pa.Table) -> pa.Table:
        block = Block(docs, mail, buckets)
        block.strings()
        bucket, cuts = used_buckets(block.s_keys, buckets)
        least, most = block.s_doc[block.s_first], block.s_doc[block.s_first + block.s_count - 1]
        start, lens = block.s_start[block.s_first], block.s_len[block.s_first]
        ends = np.append(0, np.cumsum(lens + WINDOW - 1))
        return _rows(
            _SEND, bucket.size, bucket=bucket, block=key[0].as_py(), lens=packed(lens.astype(np.uint8), cuts), least=packed(least, cuts), most=packed(most, cuts),
            bytes=packed(block.data[ranges(start, lens + WINDOW - 1)], ends[cuts] if bucket.size else cuts),
        )

    return run


def _sort(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
    def joined(name: str, dtype) -> np.ndarray:
        return np.frombuffer(b"".join(sent.column(name).to_pylist()), dtype)

    lens, least, most = joined("lens", np.uint8).astype(np.int64), joined("least", np.int64), joined("most", np.int64)
    text = np.concatenate([joined("bytes", np.uint8), np.zeros(64, np.uint8)])
    firsts = first_documents(text, lens, least)
    begins = np.cumsum(lens) - lens
    new = np.empty(firsts.size, bool)
    new[0] = True
    new[1:] = firsts[1:] != firsts[:-1]
    new[begins] = True
    at = np.flatnonzero(new)
    run = np.searchsorted(begins, at, side="right") - 1
    size = np.diff(np.append(at, firsts.size))
    useful = firsts[at] < most[run]
    at, run, size = at[useful], run[useful], size[useful]
    counts = np.array([len(x) for x in sent.column("lens").to_pylist()], np.int64)
    ends = np.cumsum(counts)
    cuts = np.searchsorted(run, np.append(0, ends))
    own = (run - np.repeat(ends - counts, np.diff(cuts))).astype(np.int32)
    # The number of runs comes first, so that the block can number the runs of all its buckets.
    return _rows(
        _MAIL, counts.size, block=sent.column("block").to_numpy(), kind=ANSWER, bucket=key[0].as_py(), id=counts, a=packed(own, cuts),
        b=packed((at - begins[run]).astype(np.uint8), cuts), c=packed(size.astype(np.uint8), cuts), d=packed(firsts[at], cuts),
    )


def _cut(buckets: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, mail: pa.Table) -> pa.Table:
        block = Block(docs, mail, buckets)
        n = block.data.size
        depth = np.zeros(n + 1, np.int32)
        answers = block.mail[ANSWER]
        if answers.num_rows:
            block.strings()
            counts = answers.column("id").to_numpy()
            parts = [np.frombuffer(x, np.int32) for x in answers.column("a").to_pylist()]
            which = np.concatenate([p + base for p, base in zip(parts, np.cumsum(counts) - counts, strict=True)])
            first, size, least = (np.frombuffer(b"".join(answers.column(c).to_pylist()), t).astype(np.int64) for c, t in (("b", np.uint8), ("c", np.uint8), ("d", np.int64)))
            times = block.s_count[which]
            rows = ranges(block.s_first[which], times)
            first, size, least = np.repeat(first, times), np.repeat(size, times), np.repeat(least, times)
            later = least < block.s_doc[rows]
            start = block.s_start[rows][later] + first[later]
            depth += np.bincount(start, minlength=n + 1).astype(np.int32)
            depth -= np.bincount(start + size[later] + WINDOW - 1, minlength=n + 1).astype(np.int32)
        gone = np.cumsum(depth)[:n] > 0
        begins, ends = block.offsets[:-1], block.offsets[1:]
        for i in np.flatnonzero(block.copy):
            gone[begins[i] : ends[i]] = True
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        at, to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        starts, stops, kept = [], [], []
        for lo, hi in zip(begins.tolist(), ends.tolist(), strict=True):
            # A removed stretch may run on into the next text of the block.
            i = np.searchsorted(to, lo, side="right")
            j = np.searchsorted(at, hi) if lo < hi else i
            starts.append((np.maximum(at[i:j], lo) - lo).tolist())
            stops.append((np.minimum(to[i:j], hi) - lo).tolist())
            own = block.data[lo:hi]
            kept.append((own[~gone[lo:hi]] if j > i else own).tobytes())
        return pa.Table.from_arrays([block.ids.combine_chunks(), pa.array(ends - begins), pa.array(starts, pa.list_(pa.int64())), pa.array(stops, pa.list_(pa.int64())), pa.array(kept, pa.binary())], schema=_OUT)

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, starts and ends of the removed stretches, and the kept bytes."""
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_bytes = min(MOST_BLOCK_BYTES, int(BLOCK_BYTES * max(1.0, math.sqrt(total / 1e9))))
    blocks, buckets = max(4, -(-total // block_bytes)), max(4, -(-total // BUCKET_BYTES))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")

    prints = texts.where((F.octet_length("text") >= WINDOW) & F.col("doc_id").isNotNull())
    prints = written(spark, prints.select("doc_id", F.unhex(F.sha2("text", 256)).alias("print"), block.alias("block")), "repeat-prints")
    firsts = prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n_rows")).where("first < last")
    firsts = written(spark, firsts.drop("last"), "repeat-firsts")
    copies = spread_join(prints, firsts, ["print"], "doc_id", prints.count()).where("doc_id > first")
    nothing = [F.lit(None).cast("binary").alias(c) for c in "bcd"]
    copies = copies.select("block", F.lit(COPY).alias("kind"), F.lit(0).alias("bucket"), F.col("doc_id").alias("id"), F.col("print").alias("a"), *nothing)

    dealt = texts.select(block.alias("block"), "doc_id", "text").groupBy("block")
    asked = dealt.cogroup(copies.groupBy("block")).applyInArrow(_ask(buckets), ASK)
    flags = asked.groupBy("bucket").applyInArrow(_flag, MAIL)
    sent = dealt.cogroup(copies.unionByName(flags).groupBy("block")).applyInArrow(_send(buckets), SEND)
    answers = sent.groupBy("bucket").applyInArrow(_sort, MAIL)
    return dealt.cogroup(copies.unionByName(flags).unionByName(answers).groupBy("block")).applyInArrow(_cut(buckets), OUT)
