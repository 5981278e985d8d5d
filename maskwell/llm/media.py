"""Media columns: payloads stored as MPEG transport streams and read back.

:func:`mux` cuts a payload into access units of ``UNIT`` bytes and writes one PES
packet each, with a presentation timestamp, after a program association and a
program map table; units that start a group carry a random-access flag and a clock
reference.  :func:`demux` reads any such stream: it checks the tables' CRC, follows
PAT and PMT to the elementary stream, checks continuity counters, drops repeated
packets, reassembles the PES packets, and lists timestamps and random-access points.
Both work on whole packets as numpy matrices.

Defined results: a null payload counts as empty; :func:`store` pads with bytes 255 to
a positive multiple of ``UNIT``; equal payloads give equal streams; any length; other
columns are handed on (those named like new ones are replaced).  A stream that breaks
the format (sync byte, table CRC, packet length) raises ValueError with the reason.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_arrow

# Fixed values of the format.
PACKET, SYNC, STREAM_ID, PRIVATE_PES = 188, 0x47, 0xBD, 0x06
PROGRAM, PMT_PID, ES_PID = 1, 0x1000, 0x0101
CRC_POLY = 0x04C11DB7
UNIT, TICK, GROUP = 576, 3003, 8  # bytes a unit, 90 kHz ticks a unit, units a random-access group

UNITS = T.ArrayType(T.StructType([T.StructField("pts", T.LongType()), T.StructField("random_access", T.BooleanType()), T.StructField("offset", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("level", T.LongType())]))


def crc_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (CRC_POLY if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table: int, extension: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_PES]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(ticks: np.ndarray) -> np.ndarray:
    """The five bytes of presentation timestamps."""
    t = ticks.astype(np.int64)
    return np.stack([0x21 | (t >> 30 & 7) << 1, t >> 22 & 255, (t >> 14 & 254) | 1, t >> 7 & 255, (t << 1 & 254) | 1], axis=1).astype(np.uint8)


def _template() -> np.ndarray:
    """The four packets of a unit, without counters, stamps and data."""
    one = np.full((4, PACKET), 255, np.uint8)
    one[:, 0], one[:, 1], one[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
    one[0, 1] |= 0x40
    one[:, 3] = [0x30, 0x10, 0x10, 0x30]
    one[0, 4:12] = [7, 0x10, 0, 0, 0, 0, 0x7E, 0]
    one[0, 12:21] = [0, 0, 1, STREAM_ID, (UNIT + 8) >> 8, (UNIT + 8) & 255, 0x84, 0x80, 5]
    one[3, 4:6] = [PACKET - 5 - (UNIT - 162 - 368), 0]
    return one.reshape(-1)


_TEMPLATE = _template()
_LAST = UNIT - 162 - 2 * 184  # data bytes in a unit's fourth packet


def mux(payload: bytes) -> bytes:
    """The stream of a payload whose length is a multiple of UNIT."""
    data = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    n = len(data)
    at = np.arange(n, dtype=np.int64)
    ts = np.tile(_TEMPLATE, (n, 1))
    packets = ts.reshape(n * 4, PACKET)
    packets[:, 3] |= (np.arange(4 * n) & 15).astype(np.uint8)
    ticks = (at + 1) * TICK & (1 << 33) - 1
    clock = at * TICK & (1 << 33) - 1
    ts[:, 5] = np.where(at % GROUP == 0, 0x50, 0x10)
    for i, shift in enumerate((25, 17, 9, 1)):
        ts[:, 6 + i] = clock >> shift & 255
    ts[:, 10] = (clock & 1) << 7 | 0x7E
    ts[:, 21:26] = _stamp(ticks)
    ts[:, 26:188] = data[:, :162]
    ts[:, 192:376] = data[:, 162:346]
    ts[:, 380:564] = data[:, 346:530]
    ts[:, 752 - _LAST :] = data[:, 530:]
    return TABLES + ts.tobytes()


def _read_section(packet: np.ndarray, table: int) -> bytes:
    start = 4 + (1 + int(packet[4]) if packet[3] & 0x20 else 0)
    raw = packet[start + 1 + int(packet[start]) :].tobytes()
    size = 3 + (int.from_bytes(raw[1:3], "big") & 0xFFF)
    if raw[0] != table or crc_mpeg(raw[:size]):
        raise ValueError("a program table is damaged")
    return raw[:size]


def demux(stream: bytes) -> dict:
    """payload, pts, random_access, offset, size and level (sum of its samples) of each unit, and the number of continuity errors."""
    if not stream or len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    m = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (m[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pid = (m[:, 1] & 31).astype(np.int32) << 8 | m[:, 2]
    starts = m[:, 1] & 0x40 > 0
    first = lambda p: m[np.flatnonzero((pid == p) & starts)[:1]]
    if not len(pat := first(0)):
        raise ValueError("no program association table")
    body = _read_section(pat[0], 0)[8:-4]
    programs = [int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(body), 4) if body[i : i + 2] != b"\0\0"]
    if not programs or not len(pmt := first(programs[0])):
        raise ValueError("no program map table")
    body = _read_section(pmt[0], 2)[8:-4]
    at = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
    streams = []
    while at < len(body):
        streams.append((body[at], int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF))
        at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0xFFF)
    if not streams:
        raise ValueError("the program has no stream")

    m = m[pid == streams[0][1]]
    m = m[m[:, 3] & 0x10 > 0]
    counter = (m[:, 3] & 15).astype(np.int32)
    step = np.diff(counter) & 15
    again = np.concatenate([[False], step == 0])
    errors = int(((step != 1) & (step != 0)).sum())
    if again.any():
        m = m[~again]
    adapted = m[:, 3] & 0x20 > 0
    skip = 4 + np.where(adapted, 1 + m[:, 4].astype(np.int32), 0)
    if (skip > PACKET).any():
        raise ValueError("an adaptation field is too long")
    flagged = adapted & (m[:, 4] > 0) & (m[:, 5] & 0x40 > 0)
    begins = np.flatnonzero(m[:, 1] & 0x40)
    data = m[np.arange(PACKET) >= skip[:, None]]
    ends = np.concatenate([[0], np.cumsum(PACKET - skip)])
    head = ends[begins]  # where each PES packet starts in data
    if len(head) and ((data[head] != 0) | (data[head + 1] != 0) | (data[head + 2] != 1)).any():
        raise ValueError("no packet start code")
    size = data[head + 4].astype(np.int64) << 8 | data[head + 5]
    extra = data[head + 8].astype(np.int64)
    stop = np.where(size > 0, head + 6 + size, np.append(head[1:], len(data)))
    if (stop > np.append(head[1:], len(data))).any():
        raise ValueError("a packet is cut short")
    begin = head + 9 + extra
    p = [data[np.minimum(head + 9 + i, len(data) - 1)].astype(np.int64) for i in range(5)]
    pts = np.where(data[head + 7] & 0x80 > 0, (p[0] >> 1 & 7) << 30 | p[1] << 22 | (p[2] >> 1) << 15 | p[3] << 7 | p[4] >> 1, -1)
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, begin, 1)
    np.add.at(edge, stop, -1)
    payload = data[np.cumsum(edge[:-1]) > 0]
    length = stop - begin
    total = np.concatenate([[0], np.cumsum(payload, dtype=np.int64)])
    ends = np.cumsum(length)
    return {"payload": payload.tobytes(), "pts": pts, "random_access": flagged[begins], "offset": ends - length, "size": length, "level": total[ends] - total[ends - length], "errors": errors}


def padded(payload: bytes, unit: int = UNIT) -> bytes:
    return payload.ljust(max(1, -(-len(payload) // unit)) * unit, b"\xff")


def store(df: DataFrame, payload_col: str = "text", media_col: str = "media") -> DataFrame:
    """Adds binary ``media_col``: the stream of the padded payload (strings as UTF-8)."""

    def work():
        import pyarrow as pa

        def apply(column):
            values = [(v.encode() if isinstance(v, str) else v) if v is not None else b"" for v in column.to_pylist()]
            return [pa.array([mux(padded(v)) for v in values], pa.binary())]

        return apply

    return append_arrow(df, payload_col, [T.StructField(media_col, T.BinaryType())], work)


def read(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds binary ``payload``, array<struct> ``units`` and int ``continuity_errors``, read from the streams.  A null stream gives nulls."""

    def work():
        import pyarrow as pa

        def apply(column):
            found = [demux(v) if v is not None else None for v in column.to_pylist()]
            ok = [f for f in found if f]
            ends = np.cumsum([0, *[len(f["pts"]) if f else 0 for f in found]], dtype=np.int32)
            join = lambda k, t: pa.array(np.concatenate([f[k] for f in ok]).astype(t) if ok else np.empty(0, t))
            units = pa.StructArray.from_arrays([join("pts", np.int64), join("random_access", bool), join("offset", np.int64), join("size", np.int32), join("level", np.int64)], names=["pts", "random_access", "offset", "size", "level"])
            return [pa.array([f and f["payload"] for f in found], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), units), pa.array([f and f["errors"] for f in found], pa.int32())]

        return apply

    fields = [T.StructField("payload", T.BinaryType()), T.StructField("units", UNITS), T.StructField("continuity_errors", T.IntegerType())]
    return append_arrow(df, media_col, fields, work)


def feature(units: Column, errors: Column) -> Column:
    """units, random-access points, first and last timestamp, continuity errors; least, largest and total level."""
    points, levels = F.size(F.filter(units, lambda u: u["random_access"])), units["level"]
    total = F.aggregate(levels, F.lit(0).cast("long"), lambda a, x: a + x)
    shown = (("units", F.size(units)), ("rap", points), ("first", F.element_at(units, 1)["pts"]), ("last", F.element_at(units, -1)["pts"]), ("cc", errors), ("low", F.array_min(levels)), ("high", F.array_max(levels)), ("sum", total))
    return F.concat_ws(";", *[F.concat(F.lit(k + "="), v.cast("string")) for k, v in shown])
