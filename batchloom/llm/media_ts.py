"""Media columns as MPEG transport streams (ISO/IEC 13818-1).

``to_transport_stream`` packs each payload into 188-byte packets: a program association table, a
program map table and one private elementary stream whose packetised units carry a presentation
timestamp and a random-access mark. ``read_transport_stream`` finds the stream through the tables, checks every continuity counter, reassembles the units and
lists timestamps and random-access points.

The reader takes the first elementary stream of the first program, of any stream that is not scrambled: tables over several
packets, other and null packets between, packets with an adaptation field only, one repeat of a packet, counters that jump
where a discontinuity is marked, units with or without a timestamp (null), padding units (skipped), and units without a
length, which end where the next begins (video only).

Edge cases: a null text is empty; an empty text becomes one block of 64 zero bytes; repeated rows give
equal rows; extra columns are ignored; an empty table gives an empty table. A long text is many units.
A damaged stream raises ``ValueError`` naming the fault: lost synchronisation, an error mark, a jump of a counter, a table or
unit that is cut off or missing.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from batchloom.llm.common import written

PACKET, SYNC = 188, 0x47
PMT_PID, ES_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x100, 0x101, 1, 0x06, 0xBD
UNIT_BYTES = 32_768
TICKS = 3_600  # 90 kHz ticks between units
PES_HEAD = 14
BLOCK = 64

MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, timestamps array<long>, random_access array<long>"
)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), ident, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(0, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, STREAM_TYPE, 0xE000 | ES_PID, 0xF000))
)


def padded(text: bytes) -> bytes:
    """``text`` followed by zero bytes up to a positive multiple of 64."""
    return text.ljust(max(BLOCK, -(-len(text) // BLOCK) * BLOCK), b"\0")


def _unit(data: bytes, number: int) -> bytes:
    pts = (number * TICKS) & (2**33 - 1)
    stamp = struct.pack(">BHH", 0x21 | (pts >> 29) & 0x0E, (pts >> 14) & 0xFFFE | 1, (pts << 1) & 0xFFFE | 1)
    return b"\0\0\1" + struct.pack(">BHBBB", STREAM_ID, len(data) + 8, 0x84, 0x80, 5) + stamp + data


def to_transport_stream(payload: bytes) -> bytes:
    """The payload as one program with one elementary stream."""
    out, counter = [TABLES], 0
    for number, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        unit = np.frombuffer(_unit(payload[at : at + UNIT_BYTES], number), np.uint8)
        # The first packet has an adaptation field of two bytes at least, for the random-access mark.
        rest = max(0, len(unit) - 182)
        n = 1 + -(-rest // 184)
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1] = ES_PID >> 8
        packets[0, 1] |= 0x40
        packets[:, 2] = ES_PID & 0xFF
        packets[:, 3] = 0x10 | ((counter + np.arange(n)) & 15)
        first = min(len(unit), 182)
        packets[0, 3] |= 0x20
        packets[0, 4] = 183 - first
        packets[0, 5] = 0x40
        packets[0, PACKET - first :] = unit[:first]
        full = rest // 184
        if full:
            packets[1 : 1 + full, 4:] = unit[first : first + full * 184].reshape(full, 184)
        if left := rest - full * 184:
            packets[-1, 3] |= 0x20
            packets[-1, 4] = 183 - left
            if left < 183:
                packets[-1, 5] = 0
            packets[-1, PACKET - left :] = unit[len(unit) - left :]
        counter = (counter + n) & 15
        out.append(packets.tobytes())
    return b"".join(out)


#: Stream ids whose units have no header beyond the length; the first is padding.
PADDING_ID, PLAIN_IDS = 0xBE, frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))


class _Packets:
    """The packets of one identifier that carry payload, each once, with their continuity checked."""

    def __init__(self, packets: np.ndarray, where: np.ndarray):
        own = packets[where]
        control = (own[:, 3] >> 4) & 3
        if (own[:, 1] & 0x80).any() or (own[:, 3] & 0xC0).any() or (control == 0).any():
            raise ValueError("packets are marked as damaged or scrambled")
        carries, field = (control & 1) > 0, (control & 2) > 0
        length = np.where(field, own[:, 4], 0).astype(np.int32)
        if (length > np.where(carries, 182, 183)).any():
            raise ValueError("an adaptation field is longer than its packet")
        flags = np.where(field & (length > 0), own[:, 5], 0)
        step = np.diff((own[:, 3] & 15).astype(np.int16)) % 16
        same = np.zeros(len(own), bool)
        if (step == 0).any():
            at = np.flatnonzero(carries[1:] & carries[:-1] & (step == 0)) + 1
            same[at] = (own[at] == own[at - 1]).all(axis=1)
        # Counters count packets with payload; one may be repeated as it is.
        good = same[1:] | ((flags[1:] & 0x80) > 0) | np.where(carries[1:], step == 1, step == 0)
        if not good.all() or (same[1:] & same[:-1]).any():
            raise ValueError("continuity counters jump")
        keep = carries & ~same
        self.random_access = where[((flags & 0x40) > 0) & ~same]
        self.count, self.starts = len(own), (own[keep, 1] & 0x40) > 0
        skip = np.where(field, 5 + length, 4)[keep]
        self.ends = np.cumsum(PACKET - skip)
        self.begins = self.ends - (PACKET - skip)
        self.data = own[keep][np.arange(PACKET) >= skip[:, None]]


def _checked(section: bytes, table: int, name: str) -> bytes:
    if section[0] != table or _remainder(section):
        raise ValueError(f"damaged {name}")
    return section


#: Streams of one writer have the same tables, so their checksums are remembered.
_remainder = functools.lru_cache(256)(crc32_mpeg)


def _section_of(packets: np.ndarray, pids: np.ndarray, pid: int, table: int, name: str) -> bytes:
    """The first whole section of a table."""
    where = np.flatnonzero(pids == pid)
    if not where.size:
        raise ValueError(f"no {name}")
    if where.size == 1 and packets[where[0], 1] >> 6 == 1 and packets[where[0], 3] & 0xF0 == 0x10:
        # Most tables are one packet, which has no counter to follow.
        raw = packets[where[0]].tobytes()
        at = 5 + raw[4]
        if at + 3 <= PACKET and at + (size := 3 + (struct.unpack(">H", raw[at + 1 : at + 3])[0] & 0xFFF)) <= PACKET:
            return _checked(raw[at : at + size], table, name)
    found, section = _Packets(packets, where), None
    for start, a, b in zip(found.starts.tolist(), found.begins.tolist(), found.ends.tolist(), strict=True):
        data = found.data[a:b].tobytes()
        if start:
            # The first byte counts those that still belong to the section before.
            rest, data = data[1 : 1 + data[0]], data[1 + data[0] :]
            section = data if section is None else section + rest
        elif section is not None:
            section += data
        if section is not None and len(section) >= 3 and len(section) >= (size := 3 + (struct.unpack(">H", section[1:3])[0] & 0xFFF)):
            return _checked(section[:size], table, name)
    raise ValueError(f"{name} is cut off")


def _unit_parts(unit: bytes) -> tuple[bytes, int | None]:
    """Payload and timestamp of a packetised unit."""
    if len(unit) < 6 or unit[:3] != b"\0\0\1":
        raise ValueError("damaged packetised unit")
    kind, size = unit[3], struct.unpack(">H", unit[4:6])[0]
    if size + 6 != len(unit) and not (size == 0 and kind >> 4 == 0xE):
        raise ValueError("a packetised unit is cut off")
    if kind in PLAIN_IDS:
        return unit[6:], None
    if len(unit) < 9 + unit[8] or unit[6] >> 6 != 2 or (unit[7] & 0x80 and unit[8] < 5):
        raise ValueError("damaged packetised unit")
    stamp = None
    if unit[7] & 0x80:
        a, b, c = struct.unpack(">BHH", unit[9:14])
        stamp = ((a & 0x0E) << 29) | ((b & 0xFFFE) << 14) | (c >> 1)
    return unit[9 + unit[8] :], stamp


def read_transport_stream(media: bytes) -> tuple[bytes, list[int | None], list[int], dict[str, int]]:
    """Payload, timestamps by unit, numbers of the random-access packets, and counts."""
    if not media or len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    pids = ((packets[:, 1].astype(np.int32) & 0x1F) << 8) | packets[:, 2]
    programs = _section_of(packets, pids, 0, 0, "program association table")[8:-4]
    # Program 0 is not a program but the network's table.
    maps = [pid & 0x1FFF for number, pid in struct.iter_unpack(">HH", programs) if number]
    if not maps:
        raise ValueError("no program")
    streams = _section_of(packets, pids, maps[0], 2, "program map table")
    at = 12 + (struct.unpack(">H", streams[10:12])[0] & 0xFFF)
    if at + 5 > len(streams) - 4:
        raise ValueError("a program without streams")
    es_pid = struct.unpack(">H", streams[at + 1 : at + 3])[0] & 0x1FFF
    where = np.flatnonzero(pids == es_pid)
    if not where.size:
        raise ValueError("no elementary packets")
    es = _Packets(packets, where)
    begins = es.begins[es.starts].tolist()
    if not begins or begins[0]:
        raise ValueError("the stream begins inside a unit")
    parts, stamps = [], []
    for start, end in zip(begins, [*begins[1:], int(es.ends[-1])], strict=True):
        unit = es.data[start:end].tobytes()
        payload, stamp = _unit_parts(unit)
        if unit[3] != PADDING_ID:
            parts.append(payload)
            stamps.append(stamp)
    return b"".join(parts), stamps, es.random_access.tolist(), {"packets": len(packets), "es": es.count, "units": len(parts), "stream_type": streams[at], "pid": es_pid}


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [(t or "").encode() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_transport_stream(padded(t)) for t in texts], pa.binary())], schema=schema)


def _features(doc_id: int | None, n_bytes: int, media: bytes) -> dict:
    payload, stamps, access, counts = read_transport_stream(media)
    values, known = np.frombuffer(payload, np.uint8), [t for t in stamps if t is not None]
    feature = ";".join([*(f"{k}={v}" for k, v in counts.items()), f"access={len(access)}", f"first={known[0] if known else None}", f"last={known[-1] if known else None}", f"sum={int(values.sum(dtype=np.int64))}", f"peak={int(values.max(initial=0))}"])
    return {
        "doc_id": doc_id,
        "n_bytes": n_bytes,
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-BLOCK:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": feature,
        "timestamps": stamps,
        "random_access": access,
    }


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64())]
    + [("media_sha256", pa.string()), ("feature", pa.string()), ("timestamps", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int64()))]
)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = [_features(*row) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=_OUT)


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One transport stream per document, as a binary column."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_encode, MEDIA)


def read_media(media: DataFrame) -> DataFrame:
    """Features, timestamps and random-access points of stored streams."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode, FEATURES)


def media_columns(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Store every text as a transport stream in the shared folder, read it back and derive its columns."""
    return read_media(written(spark, encode_media(docs), "media"))
