"""Exact round trips through transport streams, and damaged ones."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from batchloom.llm.media_ts import PACKET, UNIT_BYTES, encode_media, media_columns, padded, read_transport_stream, to_transport_stream


@pytest.mark.parametrize("n", [64, 128, 168, 169, 182, 183, 184, 366, 367, 368, UNIT_BYTES - 1, UNIT_BYTES, UNIT_BYTES + 1, 5 * UNIT_BYTES + 77])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    media = to_transport_stream(payload)
    back, stamps, access, counts = read_transport_stream(media)
    units = -(-n // UNIT_BYTES)
    assert back == payload and len(media) % PACKET == 0
    assert stamps == [3600 * i for i in range(units)] and len(access) == counts["units"] == units
    assert (counts["pid"], counts["stream_type"]) == (0x101, 6)


def test_timestamps_beyond_32_bits():
    from batchloom.llm import media_ts

    number = 2**32 // media_ts.TICKS + 5
    media = bytearray(to_transport_stream(b"x" * 64))
    unit = media_ts._unit(b"x" * 64, number)
    media[-len(unit) :] = unit
    assert read_transport_stream(bytes(media))[1] == [number * media_ts.TICKS]


def test_padding():
    assert [len(padded(b"x" * n)) for n in (0, 1, 64, 65)] == [64, 64, 64, 128]


def flip(media, at):
    return media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :]


@pytest.mark.parametrize("at, text", [(0, "synchron"), (6, "table"), (PACKET + 6, "table"), (4 * PACKET + 3, "continuity")])
def test_damage_is_found(at, text):
    with pytest.raises(ValueError, match=text):
        read_transport_stream(flip(to_transport_stream(b"abc" * 1000), at))
    with pytest.raises(ValueError):
        read_transport_stream(b"")


def packet(pid, counter, payload=None, start=False, field=None, error=False):
    """One packet by hand: an adaptation field (flags and more), stuffing, and payload."""
    payload = b"" if payload is None else payload
    control = (0x10 if payload else 0) | (0x20 if field is not None or len(payload) < 184 else 0)
    head = bytes([0x47, (0x80 if error else 0) | (0x40 if start else 0) | pid >> 8, pid & 255, control | counter & 15])
    room = PACKET - 4 - len(payload)
    body = b""
    if control & 0x20:
        content = (field if field is not None else b"\0" if room > 1 else b"").ljust(room - 1, b"\xff")
        body = bytes([room - 1]) + content
    out = head + body + payload
    assert len(out) == PACKET
    return out


def table(pid, section, counter=0):
    """A section over as many packets as it takes, with a pointer before it."""
    data, out = b"\0" + section, []
    for i in range(0, len(data), 184):
        out.append(packet(pid, counter + i // 184, data[i : i + 184].ljust(184, b"\xff"), start=i == 0))
    return out


def section(ident, number, body):
    from batchloom.llm.media_ts import crc32_mpeg

    head = bytes([ident]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def unit(kind, payload, stamp=None, sized=True, plain=False):
    head = b""
    if not plain:
        times = b""
        if stamp is not None:
            times = bytes([0x21 | (stamp >> 29) & 14]) + ((stamp >> 14) & 0xFFFE | 1).to_bytes(2, "big") + ((stamp << 1) & 0xFFFE | 1).to_bytes(2, "big")
        head = bytes([0x80, 0x80 if times else 0, len(times) + 2]) + times + b"\xff\xff"
    return b"\0\0\1" + bytes([kind]) + (len(head + payload) if sized else 0).to_bytes(2, "big") + head + payload


def foreign(fault=None):
    """A stream as other writers make them: network and long tables, video without lengths, marks, fill and repeats."""
    programs = section(0, 7, (0).to_bytes(2, "big") + (0xE010).to_bytes(2, "big") + (3).to_bytes(2, "big") + (0xE020).to_bytes(2, "big"))
    streams = section(2, 3, (0xE101).to_bytes(2, "big") + (0xF000 + 200).to_bytes(2, "big") + bytes([9, 198]) + b"d" * 198 + bytes([0x1B]) + (0xE101).to_bytes(2, "big") + b"\xf0\0" + bytes([3]) + (0xE102).to_bytes(2, "big") + b"\xf0\0")
    rng = random.Random(1)
    contents = [rng.randbytes(n) for n in (400, 10, 250, 30)]
    units = [unit(0xE0, contents[0], 2**33 - 1, sized=False), unit(0xE0, contents[1], None), unit(0xBE, b"\xff" * 50, plain=True), unit(0xE0, contents[2], 90_000), unit(0xE0, contents[3], None)]
    out, counter = [*table(0, programs), *table(0x20, streams)], 5
    for n, u in enumerate(units):
        first = True
        while u:
            size = min(len(u), 150 if first else 184)
            field = b"\x40" if n == 0 and first else b"\x80" if n == 3 and first else None
            if n == 3 and first:
                counter += 9  # as the mark of a discontinuity allows
            out.append(packet(0x101, counter, u[:size], first, field))
            if n == 1 or (fault == "repeats" and n == 0 and first):
                out += [out[-1]] * (2 if fault == "repeats" else 1)
            if n == 0:
                out += [packet(0x101, counter, None, field=b"\0"), packet(0x1FFF, 0, b"\xff" * 184), packet(0x102, 3, b"\0" * 184)]
            u, first, counter = u[size:], False, counter + 1
        if fault == "gap" and n == 0:
            counter += 1
    if fault == "error":
        out.append(packet(0x101, counter, b"x", error=True))
    if fault == "no program":
        out = [*table(0, section(0, 7, (0).to_bytes(2, "big") + (0xE010).to_bytes(2, "big"))), *out[1:]]
    if fault == "cut table":
        del out[2]
    if fault == "cut unit":
        out.pop()
        out.append(packet(0x101, counter - 1, b"\0\0\1\xe0\0\x50\x80\0\0", True))
    return b"".join(out), b"".join(contents)


def test_a_stream_of_another_writer():
    media, contents = foreign()
    back, stamps, access, counts = read_transport_stream(media)
    assert back == contents
    assert stamps == [2**33 - 1, None, 90_000, None]
    assert (counts["units"], counts["stream_type"], counts["pid"], len(access)) == (4, 0x1B, 0x101, 1)


@pytest.mark.parametrize("fault, text", [("gap", "counters"), ("repeats", "counters"), ("error", "marked as damaged"), ("no program", "no program"), ("cut table", "program map table|damaged"), ("cut unit", "cut off")])
def test_faults_of_other_streams(fault, text):
    with pytest.raises(ValueError, match=text):
        read_transport_stream(foreign(fault)[0])


def test_columns(spark):
    texts = {1: None, 2: "", 3: "é" * 40, 4: "long " * 30_000, 5: "é" * 40}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, "x", "x")], "doc_id long, text string, media string")
    stored = {r["doc_id"]: bytes(r["media"]) for r in encode_media(docs).collect()}
    rows = {r["doc_id"]: r for r in media_columns(spark, docs).collect()}
    for i, t in texts.items():
        raw, r = (t or "").encode(), rows[i]
        payload = padded(raw)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
    assert rows[3]["feature"] == rows[5]["feature"] and len(rows) == 6
    assert media_columns(spark, docs.limit(0)).collect() == []
