"""Shared helpers: the shared work folder, joins on frequent keys, Arrow text access and vectorised word hashing."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.sources.shared import stage_path, work_dir as work_dir

#: So much text at a time that its hashes stay in a core's cache.
CHUNK_BYTES = 1 << 18

_rng = np.random.default_rng(20240607)
_SHINGLE_MULT = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_WORD_MULT = _rng.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_KEY = _rng.bytes(32)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words up to so many bytes are hashed all at once, longer ones one by one.
_SHORT_WORD = 64
#: At most so many keys are told apart as frequent, so lists of them may be broadcast.
MOST_FREQUENT, LEAST_FREQUENT, FEW_ROWS = 10_000, 64, 100_000


_made = threading.local()


def _stages() -> list[str]:
    """Folders of the stages that this thread has written."""
    if not hasattr(_made, "paths"):
        _made.paths = []
    return _made.paths


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it again."""
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _stages().append(path)
    return spark.read.schema(df.schema).parquet(path)


def stages_so_far() -> int:
    return len(_stages())


def drop_stages(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Delete the stages written after the first ``since``, but those with a name in ``keep``."""
    jvm, paths = spark.sparkContext._jvm, _stages()
    gone = [p for p in paths[since:] if p.rsplit("/", 1)[-1].rsplit("-", 1)[0] not in keep]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    paths[:] = [p for p in paths if p not in gone]


def spread_join(rows: DataFrame, table: DataFrame, key: list[str], by: str, total: int, how: str = "inner", maybe_few: bool = True) -> DataFrame:
    """``rows`` joined to ``table`` on ``key``, the rows of a frequent key dealt over several tasks.

    ``table`` has one row per key, and in ``n_rows`` how many of the ``total`` rows have it. Where it is counted to have at most
    ``FEW_ROWS`` rows, it is broadcast; ``maybe_few`` is false for a table that is wide, or grows with the rows anyway.
    Otherwise a key is frequent if more than ``total / MOST_FREQUENT`` rows have it, so there are at most ``MOST_FREQUENT`` of
    them, and only hashes of these come to the driver. Each is dealt, by a hash of the column ``by``, to a power of two of
    tasks, and its row of ``table`` is repeated as often: at most four times ``MOST_FREQUENT`` rows in all. Keys are not null.
    """
    if maybe_few and table.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        return rows.join(F.broadcast(table.drop("n_rows")), key, how)
    share = max(LEAST_FREQUENT, -(-total // MOST_FREQUENT))
    times = F.ceil(F.log2(F.col("n_rows") / share)).cast("int")
    deals: dict[int, list[int]] = {}
    for found, power in table.where(F.col("n_rows") > share).select(F.xxhash64(*key), times).toLocalIterator():
        deals.setdefault(2**power, []).append(found)
    if not deals:
        return rows.join(table.drop("n_rows"), key, how)
    n = F.lit(1)
    for count, hashes in deals.items():
        n = F.when(F.col("__hash").isin(hashes), F.lit(count)).otherwise(n)
    rows = rows.withColumn("__hash", F.xxhash64(*key)).withColumn("__deal", F.pmod(F.xxhash64(by), n).cast("int")).drop("__hash")
    table = table.withColumn("__hash", F.xxhash64(*key)).withColumn("__deal", F.explode(F.sequence(F.lit(0), n - 1))).drop("n_rows", "__hash")
    return rows.join(table, [*key, "__deal"], how).drop("__deal")


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and the n + 1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, ends - ends[0]


def pieces(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes together, or of one longer document."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, end
        start = end


def mixed(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on all."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of consecutive texts, A-Z lower-cased.

    Eight bytes at a time are mixed in; words over 64 bytes have a keyed BLAKE2b hash. Returns the hashes in text order
    and, for each text, how many it has.
    """
    n_docs = len(offsets) - 1
    if data.size == 0:
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    inner = ~_IS_SPACE[data]
    before = np.empty_like(inner)
    before[0] = False
    before[1:] = inner[:-1]
    cut = offsets[1:-1]
    before[cut[cut < data.size]] = False
    starts = np.flatnonzero(inner & ~before)
    after = np.empty_like(inner)
    after[-1] = False
    after[:-1] = inner[1:]
    last = offsets[1:-1] - 1
    after[last[last >= 0]] = False
    lens = np.flatnonzero(inner & ~after) + 1 - starts
    lower = np.zeros(data.size + 8, np.uint8)
    lower[: data.size] = _LOWER[data]
    eight = np.ndarray((data.size,), "<u8", lower, strides=(1,))
    hashes = mixed(lens.astype(np.uint64) * _WORD_MULT[0])
    some = np.arange(starts.size)
    for at in range(0, _SHORT_WORD, 8):
        if at:
            some = some[lens[some] > at]
        if not some.size:
            break
        part = eight[starts[some] + at] & _MASK[np.minimum(lens[some] - at, 8)]
        hashes[some] = mixed((hashes[some] ^ part) * _WORD_MULT[1] + _WORD_MULT[2])
    for i in np.flatnonzero(lens > _SHORT_WORD).tolist():
        raw = lower[starts[i] : starts[i] + lens[i]].tobytes()
        hashes[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=_KEY).digest(), "little")
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``size``-word shingle of consecutive texts; a shorter text gives its whole sequence as one.

    Returns the hashes and how many each text has (0 without words).
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    have = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    total = int(have.sum())
    if not total:
        return np.zeros(0, np.uint64), have
    first = np.repeat(starts - (np.cumsum(have) - have), have) + np.arange(total)
    length = np.repeat(np.minimum(counts, size), have)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    out = length.astype(np.uint64)
    for j in range(size):
        term = padded[first + j] * _SHINGLE_MULT[j]
        short = length <= j
        if short.any():
            term[short] = 0
        out += term ^ (term >> np.uint64(31))
    return mixed(out), have
