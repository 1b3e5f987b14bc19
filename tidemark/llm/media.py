"""Media columns: payloads kept as MPEG transport streams, and a reader that indexes them.

A payload becomes one private elementary stream of program 1: access units of UNIT bytes, each in a PES packet with a
presentation time, cut into 188-byte packets. The program tables and a random-access point come before every RAP_EVERY-th
unit. The reader trusts nothing that the writer knows: it finds the packet grid, takes the streams from the program
tables (section CRCs checked), checks continuity counters, reassembles the PES packets and lists time stamps with
random-access points.

Nulls and empty texts give a payload of 64 zero bytes; equal payloads give equal streams; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.shared import map_batches, spread, texts_of, written

PACKET, BODY, SYNC = 188, 184, 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x0100, 0x0101
PRIVATE_PES, PRIVATE_TYPE = 0xBD, 0x06
UNIT = 45 * BODY - 22
RAP_EVERY = 8
TICKS = 3600
MASK33 = (1 << 33) - 1


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1) ^ (0x04C11DB7 if value & 0x80000000 else 0)
        table.append(value & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32 as program tables use it: most significant bit first, all ones at the start."""
    value = 0xFFFFFFFF
    for byte in data:
        value = ((value << 8) & 0xFFFFFFFF) ^ _CRC[(value >> 24) ^ byte]
    return value


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", section_crc(head + body))


PAT = _section(0x00, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))
PMT = _section(0x02, 1, struct.pack(">HH", 0xE000 | DATA_PID, 0xF000) + struct.pack(">BHH", PRIVATE_TYPE, 0xE000 | DATA_PID, 0xF000))


def _table_packet(pid: int, section: bytes, counter: int) -> np.ndarray:
    raw = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10 | (counter & 15)) + b"\0" + section
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), np.uint8).reshape(1, PACKET)


def _stamp(pts: int) -> bytes:
    pts &= MASK33
    return struct.pack(">BHH", 0x21 | (pts >> 30) << 1, (pts >> 14 & 0xFFFE) | 1, (pts << 1 & 0xFFFE) | 1)


def _unit_packets(pes: bytes, counter: int, clock: int | None) -> np.ndarray:
    """The packets of one PES packet; clock: its program clock if it is a random-access point."""
    field_bytes = b"" if clock is None else bytes([7, 0x50]) + struct.pack(">IH", clock >> 1 & 0xFFFFFFFF, (clock & 1) << 15 | 0x7E00)
    room = BODY - len(field_bytes)
    rest = max(0, len(pes) - room)
    full, last = divmod(rest, BODY)
    n = 1 + full + (last > 0)
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    if field_bytes:
        out[0, 3] |= 0x20
        out[0, 4 : 4 + len(field_bytes)] = np.frombuffer(field_bytes, np.uint8)
    data = np.frombuffer(pes, np.uint8)
    if len(pes) < room:  # one packet, stuffed inside its adaptation field
        spare = room - len(pes)
        if field_bytes:
            out[0, 4] += spare
        else:
            out[0, 3] |= 0x20
            out[0, 4] = spare - 1
            out[0, 5 : 5 + min(1, spare - 1)] = 0
        out[0, PACKET - len(pes) :] = data
        return out
    out[0, PACKET - room :] = data[:room]
    out[1 : 1 + full, 4:] = data[room : room + full * BODY].reshape(full, BODY)
    if last:
        spare = BODY - last
        out[-1, 3] |= 0x20
        out[-1, 4] = spare - 1
        out[-1, 5 : 5 + min(1, spare - 1)] = 0
        out[-1, PACKET - last :] = data[len(pes) - last :]
    return out


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """The payload as a transport stream; its length and bytes come back from demux()."""
    parts, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), unit)):
        chunk, pts = payload[at : at + unit], k * TICKS
        rap = k % RAP_EVERY == 0
        if rap:
            parts += [_table_packet(PAT_PID, PAT, tables), _table_packet(PMT_PID, PMT, tables)]
            tables += 1
        pes = b"\0\0\1" + struct.pack(">BHBBB", PRIVATE_PES, len(chunk) + 8, 0x84, 0x80, 5) + _stamp(pts) + chunk
        packets = _unit_packets(pes, counter, pts & MASK33 if rap else None)
        counter += len(packets)
        parts.append(packets)
    return b"".join(p.tobytes() for p in parts)


@dataclass
class Stream:
    """What the reader finds: one entry of pts, offsets, sizes and random_access for each PES packet."""

    payload: bytes = b""
    pid: int = -1
    stream_type: int = -1
    packets: int = 0
    continuity_errors: int = 0
    skipped_bytes: int = 0
    crc_errors: int = 0
    pts: list = field(default_factory=list)
    offsets: list = field(default_factory=list)
    sizes: list = field(default_factory=list)
    random_access: list = field(default_factory=list)


def packet_grid(data: bytes) -> tuple[np.ndarray, int]:
    """The packets as rows, and the bytes skipped to stay on sync bytes."""
    raw = np.frombuffer(data, np.uint8)
    whole = len(raw) // PACKET * PACKET
    rows = raw[:whole].reshape(-1, PACKET)
    if whole == len(raw) and (rows[:, 0] == SYNC).all():
        return rows, 0
    starts, at = [], 0
    while at + PACKET <= len(raw):
        if raw[at] == SYNC and (at + PACKET == len(raw) or at + PACKET < len(raw) and raw[at + PACKET] == SYNC or at + 2 * PACKET > len(raw)):
            starts.append(at)
            at += PACKET
        else:
            at += 1
    index = np.asarray(starts, np.int64)[:, None] + np.arange(PACKET)
    return raw[index] if starts else rows[:0], len(raw) - PACKET * len(starts)


def _sections(rows: np.ndarray, begins: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The sections carried by one PID's packets."""
    found, buffer = [], b""
    for row, begin, start in zip(rows, begins, starts, strict=True):
        body = row[begin:].tobytes()
        if start and body:
            buffer = body[1 + body[0] :]
        else:
            buffer += body
        while len(buffer) >= 3 and buffer[0] != 0xFF:
            size = 3 + (struct.unpack(">H", buffer[1:3])[0] & 0x0FFF)
            if len(buffer) < size:
                break
            found.append(buffer[:size])
            buffer = buffer[size:]
    return found


def demux(data: bytes) -> Stream:
    """The first elementary stream that the program tables name, reassembled and indexed."""
    out = Stream()
    rows, out.skipped_bytes = packet_grid(data)
    out.packets = len(rows)
    if not len(rows):
        return out
    pids = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    starts = (rows[:, 1] & 0x40) > 0
    control = rows[:, 3] >> 4 & 3
    carries = (control & 1) > 0
    fields = (control & 2) > 0
    begins = np.where(fields, 5 + rows[:, 4].astype(np.int32), 4)
    carries &= begins < PACKET
    flags = np.where(fields & (rows[:, 4] > 0), rows[:, 5], 0)

    def of(pid: int) -> np.ndarray:
        return np.flatnonzero((pids == pid) & carries)

    def good(pid: int, table_id: int) -> bytes | None:
        own = of(pid)
        for section in _sections(rows[own], begins[own], starts[own]):
            if section[0] != table_id:
                continue
            if section_crc(section):
                out.crc_errors += 1
                continue
            return section
        return None

    pat = good(PAT_PID, 0x00)
    if pat is None:
        return out
    programs = [struct.unpack(">HH", pat[k : k + 4]) for k in range(8, len(pat) - 4, 4)]
    pmt = next((s for number, pid in programs if number and (s := good(pid & 0x1FFF, 0x02))), None)
    if pmt is None:
        return out
    at = 12 + (struct.unpack(">H", pmt[10:12])[0] & 0x0FFF)
    if at + 5 > len(pmt) - 4:
        return out
    out.stream_type, pid, _ = struct.unpack(">BHH", pmt[at : at + 5])
    out.pid = pid & 0x1FFF

    own = of(out.pid)
    counters = rows[own, 3] & 15
    if len(own) > 1:
        step = (counters[1:].astype(np.int16) - counters[:-1]) & 15
        same = step == 0
        if same.any():  # a packet may be sent twice; the copy is dropped
            copies = np.flatnonzero(same)
            copies = copies[(rows[own[copies]][:, 4:] == rows[own[copies + 1]][:, 4:]).all(axis=1)]
            keep = np.ones(len(own), bool)
            keep[copies + 1] = False
            own = own[keep]
            counters = counters[keep]
            step = (counters[1:].astype(np.int16) - counters[:-1]) & 15
        announced = (flags[own[1:]] & 0x80) > 0
        out.continuity_errors = int(((step != 1) & ~announced).sum())
    body = rows[own]
    first = begins[own]
    data_bytes = body[np.arange(PACKET) >= first[:, None]].tobytes()
    sizes = PACKET - first
    at_packet = np.concatenate([[0], np.cumsum(sizes)])
    heads = np.flatnonzero(starts[own])
    edges = [*at_packet[heads].tolist(), int(at_packet[-1])]
    pieces, offset = [], 0
    for k, head in enumerate(heads.tolist()):
        unit = data_bytes[edges[k] : edges[k + 1]]
        if len(unit) < 9 or unit[:3] != b"\0\0\1":
            continue
        length = unit[4] << 8 | unit[5]
        skip = 9 + unit[8]
        pts = None
        if unit[7] & 0x80 and len(unit) >= 14:
            pts = (unit[9] >> 1 & 7) << 30 | unit[10] << 22 | (unit[11] >> 1) << 15 | unit[12] << 7 | unit[13] >> 1
        piece = unit[skip : 6 + length] if length else unit[skip:]
        pieces.append(piece)
        out.pts.append(pts)
        out.offsets.append(offset)
        out.sizes.append(len(piece))
        out.random_access.append(bool(flags[own[head]] & 0x40))
        offset += len(piece)
    out.payload = b"".join(pieces)
    return out


def padded(text: str) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def feature(stream: Stream) -> str:
    """A short index of the stream: units, random-access points, time range, faults."""
    pts = [p for p in stream.pts if p is not None]
    return f"units={len(stream.pts)};rap={sum(stream.random_access)};pts={min(pts, default=-1)}-{max(pts, default=-1)};packets={stream.packets};cc={stream.continuity_errors};crc={stream.crc_errors};skipped={stream.skipped_bytes}"


UNITS = pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("random_access", pa.bool_())]))
INDEX = "payload binary, pid int, stream_type int, packets long, continuity_errors long, crc_errors long, skipped_bytes long, units array<struct<pts:bigint,offset:bigint,size:bigint,random_access:boolean>>"


def _kept(df: DataFrame, *columns: str) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def with_media(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text of df as a transport stream. Null ids stay null, null texts count as empty."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch, text_column)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], names=[id_column, "n_bytes", "media"])

        return work

    return map_batches(spread(df.select(id_column, text_column)), _kept(df, id_column) + "n_bytes long, media binary", make)


def units_of(streams: list[Stream]) -> pa.Array:
    """The packets of each stream with their time stamps, places in the payload and random-access points."""
    rows = [[{"pts": p, "offset": o, "size": s, "random_access": r} for p, o, s, r in zip(x.pts, x.offsets, x.sizes, x.random_access, strict=True)] for x in streams]
    return pa.array(rows, UNITS)


def read_media(df: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """(id, payload, stream facts, units): every stream of df parsed. A null or broken stream gives an empty payload."""
    facts = (("pid", pa.int32()), ("stream_type", pa.int32()), ("packets", pa.int64()), ("continuity_errors", pa.int64()), ("crc_errors", pa.int64()), ("skipped_bytes", pa.int64()))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [demux(x or b"") for x in batch.column(media_column).to_pylist()]
            columns = [batch.column(0), pa.array([x.payload for x in found], pa.binary())]
            columns += [pa.array([getattr(x, k) for x in found], t) for k, t in facts]
            return pa.RecordBatch.from_arrays([*columns, units_of(found)], names=[id_column, "payload", *(k for k, _ in facts), "units"])

        return work

    return map_batches(df.select(id_column, media_column), _kept(df, id_column) + INDEX, make)


def media_digests(stored: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Digests and the index of stored streams (id, n_bytes, media): one row per row, with the units of each stream."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def one(media: bytes) -> tuple:
            stream = demux(media)
            payload = stream.payload
            return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(stream), stream

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            *columns, streams = zip(*map(one, batch.column("media").to_pylist()), strict=True)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), units_of(streams)], names=[id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "units"])

        return work

    schema = _kept(stored, id_column) + "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units array<struct<pts:bigint,offset:bigint,size:bigint,random_access:boolean>>"
    return map_batches(stored.select(id_column, "n_bytes", "media"), schema, make)


def stored_media(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The media column of df's texts as a table in the shared folder: (id, n_bytes, media)."""
    return written(with_media(df, id_column, text_column), "media")
