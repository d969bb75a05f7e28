"""Media columns: MPEG transport streams.

``write_stream`` stores a payload as a transport stream: a program association table and a program map table, then
the payload in elementary packets (PES) of PES_BYTES, each with a presentation time stamp and, every KEY_EVERY packets,
a random-access mark; 188-byte packets carry continuity counters and are stuffed to size. ``read_stream`` is a reader
of its own: it finds the program through the tables (CRC-checked), checks continuity counters, drops repeated packets,
reassembles elementary packets and returns their time stamps and random-access points.

Defined results: null text is the empty payload, padded to one unit. Equal texts give equal bytes. Damaged streams:
packets without sync byte are counted and skipped, a gap of counters is counted, an elementary packet that misses its
start or whose header is cut short is dropped and counted. Texts of any length are stored whole. Repeated rows give
repeated rows, an empty table an empty one. Null ids stay null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from clausegraph.llm.runtime import table

PACKET, SYNC = 188, 0x47
BODY = PACKET - 4
UNIT = 64
PAT_PID, PMT_PID, DATA_PID, NO_CLOCK_PID = 0x0000, 0x0100, 0x0101, 0x1FFF
PROGRAM, PRIVATE_DATA, STREAM_ID = 1, 0x06, 0xBD
PES_BYTES, KEY_EVERY, TICKS = 16384, 4, 3600


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _table_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    """One section in one packet: header, version 0, current, section 0 of 0, body, CRC, stuffing."""
    section = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    section += section_crc(section).to_bytes(4, "big")
    packet = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section
    return packet.ljust(PACKET, b"\xff")


PAT = _table_packet(PAT_PID, 0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
PMT = _table_packet(PMT_PID, 0x02, PROGRAM, (0xE000 | NO_CLOCK_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _stamp(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def write_stream(payload: bytes) -> bytes:
    out, counter = [PAT, PMT], 0
    for number, at in enumerate(range(0, len(payload), PES_BYTES)):
        data = payload[at : at + PES_BYTES]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(number * TICKS) + data
        key = number % KEY_EVERY == 0
        first = 2 * key  # bytes of an adaptation field in the first packet of a random-access point
        at_pes, start = 0, True
        while at_pes < len(pes):
            room = BODY - (first if start else 0)
            part = pes[at_pes : at_pes + room]
            field = b""
            if (start and key) or len(part) < room:
                size = BODY - len(part)
                field = bytes([size - 1]) + (bytes([0x40 if start and key else 0]) + b"\xff" * (size - 2) if size > 1 else b"")
            out.append(bytes([SYNC]) + (DATA_PID | (0x4000 if start else 0)).to_bytes(2, "big") + bytes([(0x30 if field else 0x10) | counter]) + field + part)
            counter = counter + 1 & 15
            at_pes += len(part)
            start = False
    return b"".join(out)


def _section(body: bytes) -> bytes | None:
    """The section of a table packet's body, if its CRC holds."""
    start = 1 + body[0]
    size = 3 + (int.from_bytes(body[start + 1 : start + 3], "big") & 0xFFF)
    section = body[start : start + size]
    return section if len(section) == size and section_crc(section) == 0 else None


def read_stream(data: bytes) -> dict:
    """payload, programs, pid, packets, bad_sync, gaps, repeats, damaged (elementary packets dropped), stamps (ticks),
    random_access (elementary packet numbers)."""
    grid = np.frombuffer(data, np.uint8, len(data) // PACKET * PACKET).reshape(-1, PACKET)
    bad = int((grid[:, 0] != SYNC).sum()) if len(grid) else 0
    if bad:
        grid = grid[grid[:, 0] == SYNC]
    pids = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    rows = [grid[i].tobytes() for i in np.flatnonzero(pids == PAT_PID)]
    programs: dict[int, int] = {}
    for row in rows:
        if (s := _section(row[4:])) is not None:
            for at in range(8, len(s) - 4, 4):
                programs[int.from_bytes(s[at : at + 2], "big")] = int.from_bytes(s[at + 2 : at + 4], "big") & 0x1FFF
    streams: list[int] = []
    for pmt in programs.values():
        for i in np.flatnonzero(pids == pmt):
            if (s := _section(grid[i].tobytes()[4:])) is not None:
                at = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
                while at < len(s) - 4:
                    pid = int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF
                    streams += [pid] if pid not in streams else []
                    at += 5 + (int.from_bytes(s[at + 3 : at + 5], "big") & 0xFFF)
    out = {"payload": b"", "programs": len(programs), "pid": streams[0] if streams else -1, "packets": len(grid), "bad_sync": bad, "gaps": 0, "repeats": 0, "damaged": 0, "stamps": [], "random_access": []}
    own = grid[pids == out["pid"]]
    if not len(own):
        return out
    has_field, has_body = own[:, 3] & 0x20 > 0, own[:, 3] & 0x10 > 0
    own, has_field = own[has_body], has_field[has_body]
    step = np.diff(own[:, 3] & 15) & 15
    again = np.r_[False, (step == 0) & (own[1:] == own[:-1]).all(1)]
    out["repeats"] = int(again.sum())
    out["gaps"] = int(((step != 1) & ~again[1:]).sum())
    own, has_field = own[~again], has_field[~again]
    begin = np.where(has_field, 5 + own[:, 4].astype(np.int32), 4)
    key = has_field & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
    starts = np.flatnonzero(own[:, 1] & 0x40)
    columns = np.arange(PACKET)
    parts = []
    for number, (a, b) in enumerate(zip(starts, np.r_[starts[1:], len(own)], strict=True)):
        block = own[a:b]
        pes = block[columns >= begin[a:b, None]].tobytes()
        head = 9 + pes[8] if len(pes) > 8 else 9
        if pes[:3] != b"\x00\x00\x01" or len(pes) < head or (pes[7] & 0x80 and head < 14):
            out["damaged"] += 1
            continue
        size = int.from_bytes(pes[4:6], "big")
        if pes[7] & 0x80:
            s = pes[9:14]
            out["stamps"].append((s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1)
        if key[a]:
            out["random_access"].append(number)
        parts.append(pes[head : 6 + size if size else None])
    out["payload"] = b"".join(parts)
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def store(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, n_bytes, media (a transport stream)."""
    source = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):  # small batches of long binaries
                batch = whole.slice(at, 500)
                both = [padded(t.as_py()) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in both], pa.int64()), pa.array([write_stream(p) for _, p in both], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """Reads the media column back: digests of payload and stream, and what the stream's tables and packets say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column("media"):
                data = media.as_py()
                got = read_stream(data)
                payload, stamps, points = got["payload"], got["stamps"], got["random_access"]
                text = f"programs={got['programs']} pid={got['pid']} packets={got['packets']} pes={len(stamps)} first_pts={stamps[0] if stamps else -1} last_pts={stamps[-1] if stamps else -1} random_access={len(points)} gaps={got['gaps']} repeats={got['repeats']} damaged={got['damaged']} bad_sync={got['bad_sync']}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), text, stamps, points))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *arrays], names=["doc_id", "n_bytes", *names])

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access"]
    id_type = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(run, f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<int>")


def op9_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents")))


QUERIES = {"op9_transport_stream": op9_transport_stream}
SQL: dict[str, str] = {}
