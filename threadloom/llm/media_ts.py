"""Media columns: MPEG transport streams (operator 9).

``store`` puts a binary column into a transport stream: program association and
program map tables, then packetized elementary packets of ``UNIT`` bytes with a
presentation time stamp each; every ``GROUP``-th access unit is a random-access
point, announced by the tables, the random-access indicator and a clock
reference. ``load`` parses the tables (sections may span packets; the first program that is none
of network information, its first stream), checks sync bytes, checksums and
continuity counters, reassembles the elementary packets (of given or open length) and
returns the payload with its time stamps and random-access points as columns.

Each row is handled alone and packets are built and parsed as numpy matrices, so
memory is bounded by a few copies of the longest text. Nulls: a null text is the
empty payload (576 bytes of 255); a null doc_id stays null. Repeated rows give
equal rows. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_rows

PAD = 576
PACKET = 188
#: Bytes of payload in one elementary packet, and access units from one random-access point to the next.
UNIT, GROUP = 20 * PAD, 8
PID_PAT, PID_PMT, PID_ES = 0x0000, 0x1000, 0x0100
PROGRAM, STREAM_TYPE, STREAM_ID = 1, 0x06, 0xBD
#: 90 kHz ticks from one access unit to the next, and of the first one.
TICKS, FIRST_PTS = 3600, 9000
PES_HEADER = 14


def padded(data: bytes) -> bytes:
    """The bytes with 255s appended up to a positive multiple of 576."""
    n = max(PAD, -(-len(data) // PAD) * PAD)
    return data + b"\xff" * (n - len(data))


def crc_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2, as sections carry it."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ext.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


_PAT = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PID_PMT).to_bytes(2, "big"))
_PMT = _section(2, PROGRAM, (0xE000 | PID_ES).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | PID_ES).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    head = b"\x47" + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10 | counter & 15]) + b"\x00"
    return (head + section).ljust(PACKET, b"\xff")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def _unstamp(b: bytes) -> int:
    if b[0] >> 4 != 2 or not b[0] & b[2] & b[4] & 1:
        raise ValueError("time stamp without its marker bits")
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _packets(data: bytes, pid: int, counter: int, field: bytes) -> bytes:
    """Packets of one elementary packet; field: flags and what follows them in the first adaptation field."""
    first = PACKET - 4 - (1 + len(field) if field else 0)
    lead, rest = data[:first], data[first:]
    full, tail = divmod(len(rest), PACKET - 4)
    out = []
    if len(lead) < first:
        field = (field or b"\x00").ljust(PACKET - 5 - len(lead), b"\xff")
    head = b"\x47" + (0x4000 | pid).to_bytes(2, "big") + bytes([(0x30 if field else 0x10) | counter & 15])
    out.append(head + (bytes([len(field)]) + field if field else b"") + lead)
    if full:
        middle = np.empty((full, PACKET), np.uint8)
        middle[:, 0] = 0x47
        middle[:, 1], middle[:, 2] = pid >> 8, pid & 0xFF
        middle[:, 3] = 0x10 | (counter + 1 + np.arange(full)) & 15
        middle[:, 4:] = np.frombuffer(rest, np.uint8, full * (PACKET - 4)).reshape(full, PACKET - 4)
        out.append(middle.tobytes())
    if tail:
        fill = PACKET - 5 - tail
        stuffing = bytes([fill]) + (b"\x00" + b"\xff" * (fill - 1) if fill else b"")
        out.append(b"\x47" + pid.to_bytes(2, "big") + bytes([0x30 | counter + 1 + full & 15]) + stuffing + rest[len(rest) - tail :])
    return b"".join(out)


def mux(payload: bytes) -> bytes:
    """The transport stream that carries the payload."""
    out, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        pts, unit, field = FIRST_PTS + k * TICKS, payload[at : at + UNIT], b""
        if k % GROUP == 0:
            out += [_table_packet(PID_PAT, _PAT, tables), _table_packet(PID_PMT, _PMT, tables)]
            tables += 1
            clock = pts - TICKS
            field = b"\x50" + (clock << 15 | 0x7E00).to_bytes(6, "big")
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + PES_HEADER - 6).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
        made = _packets(pes, PID_ES, counter, field)
        counter += len(made) // PACKET
        out.append(made)
    return b"".join(out)


def _section_of(rows: np.ndarray, pid: np.ndarray, want: int, table_id: int) -> bytes:
    """What the first section on a PID holds, which may span packets."""
    own = rows[pid == want]
    found = np.flatnonzero(own[:, 1] & 0x40)
    if not len(found):
        raise ValueError(f"no section on PID {want}")
    body = b""
    for row in own[found[0] :]:
        data = row[5 + row[4] if row[3] & 0x20 else 4 :].tobytes()
        if row[1] & 0x40:  # a pointer says where a new section starts; what is before it ends the old one
            if body:
                body += data[1 : 1 + data[0]]
                break
            data = data[1 + data[0] :]
        body += data
        if len(body) >= 3 and len(body) >= 3 + (int.from_bytes(body[1:3], "big") & 0xFFF):
            break
    size = 3 + (int.from_bytes(body[1:3], "big") & 0xFFF)
    if len(body) < size or body[0] != table_id or crc_mpeg(body[:size]):
        raise ValueError(f"bad section on PID {want}")
    return body[8 : size - 4]


def demux(stream: bytes) -> dict:
    """payload, pts (of each access unit), rap (positions of random-access points), packets and tables."""
    rows = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != 0x47).any():
        raise ValueError("lost sync")
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    pat = _section_of(rows, pid, PID_PAT, 0)
    programs = [(int.from_bytes(pat[k : k + 2], "big"), int.from_bytes(pat[k + 2 : k + 4], "big") & 0x1FFF) for k in range(0, len(pat), 4)]
    pmt_pid = next((p for n, p in programs if n), None)  # program 0 is network information
    if pmt_pid is None:
        raise ValueError("no program")
    pmt = _section_of(rows, pid, pmt_pid, 2)
    skip = 4 + (int.from_bytes(pmt[2:4], "big") & 0xFFF)
    es_pid = int.from_bytes(pmt[skip + 1 : skip + 3], "big") & 0x1FFF
    es = rows[pid == es_pid]
    for part in (es, rows[pid == PID_PAT], rows[pid == pmt_pid]):
        if (np.diff(part[:, 3].astype(np.int16) & 15) % 16 != 1).any():
            raise ValueError("continuity counter out of step")
    has_field = es[:, 3] & 0x20 > 0
    start = np.where(has_field, 5 + es[:, 4].astype(np.int32), 4)
    data = es[np.arange(PACKET) >= start[:, None]]
    ends = np.cumsum(PACKET - start)
    begins = np.flatnonzero(es[:, 1] & 0x40)
    at = np.append((ends - (PACKET - start))[begins], ends[-1])
    rap = has_field[begins] & (es[begins, 4] > 0) & (es[begins, 5] & 0x40 > 0)
    payload, pts = [], []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        head = data[a : a + PES_HEADER].tobytes()
        if head[:4] != b"\x00\x00\x01" + bytes([STREAM_ID]) or int.from_bytes(head[4:6], "big") not in (0, b - a - 6):
            raise ValueError("bad elementary packet")
        pts.append(_unstamp(head[9:14]))
        payload.append(data[a + 9 + head[8] : b].tobytes())
    return {"payload": b"".join(payload), "pts": pts, "rap": np.flatnonzero(rap).tolist(), "packets": len(rows), "stream_type": pmt[skip]}


_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_LOADED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("pts", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int32())), ("packets", pa.int64()), ("stream_type", pa.int32()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in text_rows(batches, ("doc_id", "text"), 256):
        data = [(t or "").encode() for t in texts]
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(list(map(len, data)), pa.int64()), pa.array([mux(padded(d)) for d in data], pa.binary())], schema=_STORED)


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, sizes, media in text_rows(batches, ("doc_id", "n_bytes", "media"), 64):
        rows = []
        for i, n, m in zip(ids, sizes, media, strict=True):
            found = demux(m)
            rows.append((i, n, found["payload"], found["pts"], found["rap"], found["packets"], found["stream_type"], len(m), hashlib.sha256(m).hexdigest()))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LOADED, strict=True)], schema=_LOADED)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the transport stream of each text, as the binary column ``media``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def load(stored: DataFrame) -> DataFrame:
    """The payload read back from each stream, with its time stamps (pts, of each access unit) and random-access points (places among them)."""
    kind = "doc_id long, n_bytes long, payload binary, pts array<long>, random_access array<int>, packets long, stream_type int, media_bytes long, media_sha256 string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_load, kind)


def digests(loaded: DataFrame) -> DataFrame:
    """Digests of loaded payloads, and a feature: stream type, packets, units, first and last time stamp, access points with theirs."""
    text = lambda c: c.cast("string")
    access = F.array_join(F.transform("random_access", lambda k: F.concat(text(k), F.lit("@"), text(F.get(F.col("pts"), k)))), ",")
    feature = F.concat(
        F.lit("type="), text(F.col("stream_type")), F.lit(";packets="), text(F.col("packets")), F.lit(";units="), text(F.size("pts")), F.lit(";pts="), text(F.get(F.col("pts"), F.lit(0))), F.lit("-"),
        text(F.element_at("pts", -1)), F.lit(";rap="), access,
    )
    p = F.col("payload")
    return loaded.select("doc_id", "n_bytes", F.octet_length(p).cast("long").alias("payload_bytes"), F.sha2(p, 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"))


def op9_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(load(materialize(spark, store(table(spark, sf_dir, "documents")), "media", "zstd")))


QUERIES = {"op9_media_ts": op9_media_ts}
ORACLES: dict[str, str] = {}
