"""WARC archives of captured pages, and an index in global order by external merging.

``write_archives`` writes one record per page into gzipped WARC 1.1 files in the shared folder; each file is a
run of index entries sorted by URL key, timestamp and page. ``merge_index`` deals the entries by key range and
merges the runs of each range with a loser tree, at most ``FAN_IN`` at a time, so the ranges in order hold the
whole capture history in order; ``ranked`` numbers the entries in this order. ``read_archives`` reads the files back,
record by record.

Of records with equal payloads of at least 1000 bytes, the one with the largest page id is the response and the
others revisit it; smaller ones are all responses. Who revisits whom is found from ids and hashes alone. A revisit is
written from these, too: only the payload of a response is read on, and none is moved for this but to tell responses
from revisits by page id and hash.

The order is that of the URL key's code points, then the time, then the page id, a missing one first.

Edge cases: null html is an empty payload; a null URL has the key ``-`` and no target header, and line breaks in
URLs are escaped; rows with the response's page id are responses too; a row without a page id is never
the response of others; without a timestamp column the capture time is 2024-01-01 plus the page id modulo 2^28 in
seconds, so any 64-bit id has one; a very long page is one record; an empty table gives empty tables; extra columns are
ignored. Files of lost or repeated tasks stay unread, as only files of the written index are opened.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchloom.llm.common import spread_join, stage_path, written

LEAST_REVISIT = 1000
RUN_BYTES, RUN_ROWS = 32 << 20, 50_000
FAN_IN = 16
RANGE_ROWS, MOST_RANGES = 50_000, 100_000
EPOCH, EPOCH_SECONDS = datetime(2024, 1, 1, tzinfo=UTC), 2**28

ENTRY = "url_key string, ts string, page_id long, file string, offset long, length long, run string, seq long"
_ENTRY_ARROW = pa.schema([("url_key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("run", pa.string()), ("seq", pa.int64())])
RECORD = "file string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RECORD_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: reversed host without ``www``, then port, path and query in lower case."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.strip().lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")"
    return (key + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def _clean(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)


def record_bytes(page_id: int | None, url: str | None, when: str, payload: bytes, size: int, digest: bytes, owner: int | None) -> bytes:
    """One WARC record; a revisit of ``owner`` keeps the HTTP head but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if owner is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if owner is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {when}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if owner is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{owner}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Page, payload size, digest, type and referred page of one record; checks the payload of a response."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    size = int(fields["content-length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    n = int(next(x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
    page = lambda v: None if v is None or v == "<urn:page:none>" else int(v.removeprefix("<urn:page:").rstrip(">"))
    return {"page_id": page(fields["warc-record-id"]), "payload_bytes": n, "payload_digest": digest.hex(), "record_type": kind, "refers_to": page(fields.get("warc-refers-to"))}


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        out, entries, at, name = None, [], 0, ""

        def closed() -> pa.RecordBatch:
            out.close()
            entries.sort(key=lambda e: (e["url_key"], e["ts"], e["page_id"] is not None, e["page_id"] or 0, e["offset"]))
            for seq, e in enumerate(entries):
                e["seq"] = seq
            return pa.RecordBatch.from_pylist(entries, schema=_ENTRY_ARROW)

        for batch in batches:
            for page_id, url, html, ts, owner, size, sha1 in zip(*batch.columns, strict=True):
                page_id, url, owner = page_id.as_py(), url.as_py(), owner.as_py()
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                digest = bytes.fromhex(sha1.as_py()) if sha1.is_valid else hashlib.sha1(payload).digest()
                if out is None:
                    name = f"{base}/{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(base, recursive=True)
                    out, entries, at = fs.open_output_stream(name, compression=None), [], 0
                when = ts.as_py() or (EPOCH + timedelta(seconds=(page_id or 0) % EPOCH_SECONDS))
                raw = record_bytes(page_id, url, when.strftime("%Y-%m-%dT%H:%M:%SZ"), payload, size.as_py() if size.is_valid else len(payload), digest, owner)
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                entries.append({"url_key": url_key(url), "ts": when.strftime("%Y%m%d%H%M%S"), "page_id": page_id, "file": name, "offset": at, "length": len(member), "run": name})
                at += len(member)
                if at >= RUN_BYTES or len(entries) >= RUN_ROWS:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return run


def write_archives(spark: SparkSession, pages: DataFrame, ts_col: str | None = None) -> tuple[DataFrame, str]:
    """Write the archives; returns their index entries, sorted within runs, and the folder."""
    folder = stage_path(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    ts = F.col(ts_col).cast("timestamp_ntz") if ts_col else F.lit(None).cast("timestamp_ntz")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), ts.alias("ts"))
    large = F.octet_length("html") >= LEAST_REVISIT
    hashes = rows.where(large).select("page_id", "url", "ts", F.octet_length("html").cast("long").alias("size"), F.sha1("html").alias("sha1"), F.sha2("html", 256).alias("key"))
    hashes = written(spark, hashes, "warc-hashes")
    owners = hashes.groupBy("key").agg(F.max("page_id").alias("owner"), F.count("*").alias("n_rows")).where("n_rows > 1")
    revisits = spread_join(hashes, written(spark, owners, "warc-owners"), ["key"], "url", hashes.count())
    revisits = written(spark, revisits.where("owner IS NOT NULL AND NOT page_id <=> owner"), "warc-revisits")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("owner", "long"), ("size", "long"), ("sha1", "string"))]
    small = rows.where(~large).select("page_id", "url", "html", "ts", *nothing)
    # The ids are made numbers, so that rows without one don't meet in one task.
    gone = revisits.select(F.col("page_id").alias("p"), F.col("key").alias("k")).distinct()
    first = rows.where(large).withColumn("key", F.sha2("html", 256))
    first = first.join(gone, (F.coalesce("page_id", F.lit(-1)) == F.coalesce("p", F.lit(-1))) & first["page_id"].eqNullSafe(gone["p"]) & (F.col("key") == F.col("k")), "left_anti")
    first = first.select("page_id", "url", "html", "ts", *nothing)
    again = revisits.select("page_id", "url", F.lit(None).cast("binary").alias("html"), "ts", "owner", "size", "sha1")
    return written(spark, small.unionByName(first).unionByName(again).mapInArrow(_writer(folder), ENTRY), "warc-runs"), folder


class LoserTree:
    """Merges sorted iterators; each step replays one path of comparisons from a leaf to the root."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._replay(leaf, build=True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None
        return (x, a) < (y, b)

    def _replay(self, leaf: int, build: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.tree[node] < 0 and build:
                self.tree[node] = winner
                return
            if self._before(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.tree[0]] is not None:
            winner = self.tree[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner)


def merged(runs: list[Iterable[tuple]]) -> Iterable[tuple]:
    """All runs in one order, ``FAN_IN`` at a time in as many passes as that takes."""
    while len(runs) > FAN_IN:
        runs = [list(LoserTree(runs[i : i + FAN_IN])) for i in range(0, len(runs), FAN_IN)]
    return LoserTree(runs) if runs else []


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    runs: list[list[tuple]] = []
    last = None
    for batch in batches:
        for key, ts, page, file, offset, length, run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run != last:
                runs.append([])
                last = run
            runs[-1].append((key, ts, page is not None, page or 0, file, offset, length))
    for lo, rows in enumerate(_chunks(merged(runs), 10_000)):
        key, ts, some, page, file, offset, length = zip(*rows, strict=True)
        n = len(rows)
        yield pa.RecordBatch.from_pydict(
            {
                "range": pa.array([part] * n, pa.int64()),
                "position": pa.array(range(lo * 10_000, lo * 10_000 + n), pa.int64()),
                "url_key": pa.array(key),
                "ts": pa.array(ts),
                "page_id": pa.array([p if z else None for z, p in zip(some, page, strict=True)], pa.int64()),
                "file": pa.array(file),
                "offset": pa.array(offset, pa.int64()),
                "length": pa.array(length, pa.int64()),
            }
        )


def _chunks(rows: Iterable[tuple], size: int) -> Iterator[list[tuple]]:
    chunk: list[tuple] = []
    for row in rows:
        chunk.append(row)
        if len(chunk) == size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def merge_index(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """The index in global order: by ``range``, then ``position`` in it."""
    ranges = min(MOST_RANGES, max(1, -(-entries.count() // RANGE_ROWS)))
    dealt = entries.repartitionByRange(ranges, "url_key", "ts", "page_id", "offset").sortWithinPartitions("run", "seq")
    return dealt.select("url_key", "ts", "page_id", "file", "offset", "length", "run").mapInArrow(
        _merge, "range long, position long, url_key string, ts string, page_id long, file string, offset long, length long"
    )


def ranked(spark: SparkSession, index: DataFrame) -> DataFrame:
    """The merged index with ``rank``, the place of every entry in the whole order, from 1 on; written once.

    The order inside a range is the merge's own; what is summed are the sizes of the ranges, a row each.
    """
    index = written(spark, index, "warc-index")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = index.groupBy("range").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return index.join(sizes, "range").withColumn("rank", F.col("start") + F.col("position") + 1).drop("start")


def _reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def members(stream) -> Iterator[tuple[int, bytes]]:
        """Offset and content of every gzip member."""
        at, buffer, done = 0, b"", False
        while True:
            unpacker, parts, start = zlib.decompressobj(31), [], at
            while not unpacker.eof:
                if not buffer:
                    buffer, done = stream.read(1 << 20), False
                    if not buffer:
                        if parts or at != start:
                            raise ValueError("archive ends inside a record")
                        return
                parts.append(unpacker.decompress(buffer))
                at += len(buffer) - len(unpacker.unused_data)
                buffer = unpacker.unused_data
            yield start, b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(name, compression=None) as stream:
                    for rows in _chunks(({"file": name, "offset": at, **parse_record(raw)} for at, raw in members(stream)), 2_000):
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_ARROW)

    return run


def read_archives(spark: SparkSession, entries: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives that the index names, read file by file."""
    files = entries.select("file").distinct()
    # Dealt by a hash of the name, as dealing by the name itself could be merged with the exchange of distinct().
    return files.repartition(max(1, files.count()), F.xxhash64("file")).mapInArrow(_reader(folder), RECORD)


def archive_pages(spark: SparkSession, pages: DataFrame, ts_col: str | None = None) -> DataFrame:
    """Write, index and read back; one row per page with its place in the global capture order."""
    entries, folder = write_archives(spark, pages, ts_col)
    index = ranked(spark, merge_index(spark, entries)).select(F.col("file").alias("f"), F.col("offset").alias("o"), "range", "position", "rank", "url_key", "ts")
    records = read_archives(spark, entries, folder)
    # What Python reads has no size estimate, so neither side may be broadcast.
    out = records.hint("merge").join(index.hint("merge"), (F.col("file") == F.col("f")) & (F.col("offset") == F.col("o")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "range", "position", "rank")
