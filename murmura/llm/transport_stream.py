"""MPEG transport streams as columns: multiplexing bytes, and reading program tables, packets, timestamps and entry points.

A stream is a sequence of 188-byte packets. The reader finds the programs (PAT) and their elementary streams (PMT), checks
each stream's continuity counters, reassembles its elementary packets, and lists their timestamps and which of them are
random-access points.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .runtime import prepare, refuse, utf8

# Fixed values of the format and of the streams written here.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, NULL_PID = 0x0000, 0x1000, 0x0100, 0x1FFF
PRIVATE_STREAM, PRIVATE_TYPE, PROGRAM = 0xBD, 0x06, 1
CLOCK, SAMPLE_RATE = 90_000, 8_000
#: Bytes in an access unit, which begins with tables and is a random-access point.
UNIT = 16_384


@lru_cache(1)
def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        table.append(c & 0xFFFFFFFF)
    return table


@lru_cache(256)
def section_crc(section: bytes) -> int:
    """CRC-32/MPEG-2; 0 over a whole section with its own CRC."""
    crc, table = 0xFFFFFFFF, _crc_table()
    for b in section:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ table[(crc >> 24) ^ b]
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + section_crc(head + body).to_bytes(4, "big")


@lru_cache(1)
def _tables() -> np.ndarray:
    """The packets of both tables, without counters."""
    pat = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    rows = [(bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + s).ljust(PACKET, b"\xff") for pid, s in ((PAT_PID, pat), (PMT_PID, pmt))]
    return np.frombuffer(b"".join(rows), np.uint8).reshape(2, PACKET)


def _timestamp(prefix: int, ticks: int) -> bytes:
    ticks &= (1 << 33) - 1
    return bytes([prefix << 4 | ticks >> 29 & 0x0E | 1, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1])


def _elementary(data: bytes, ticks: int) -> np.ndarray:
    """The transport packets of one elementary packet, without counters; the first has a clock reference and is an entry point."""
    header = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _timestamp(2, ticks)
    body = np.frombuffer(header + data, np.uint8)
    room, full = PACKET - 12, PACKET - 4
    n = 1 + max(0, -(-(len(body) - room) // full))
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF, 0x10
    first = min(room, len(body))
    base = ticks & (1 << 33) - 1
    clock = (base << 15 | 0x7E00).to_bytes(6, "big")
    out[0, 1], out[0, 3] = 0x40 | DATA_PID >> 8, 0x30
    out[0, 4:12] = np.frombuffer(bytes([PACKET - 5 - first, 0x50]) + clock, np.uint8)
    out[0, PACKET - first :] = body[:first]
    if n > 2:
        out[1:-1, 4:] = body[first : first + (n - 2) * full].reshape(n - 2, full)
    if n > 1:
        last = len(body) - first - (n - 2) * full
        if last < full:
            out[-1, 3] = 0x30
            out[-1, 4] = PACKET - 5 - last
            if last < full - 1:
                out[-1, 5] = 0
        out[-1, PACKET - last :] = body[len(body) - last :]
    return out


def write_stream(payload: bytes, unit: int = UNIT) -> bytes:
    """payload as 8-bit samples of a private stream: units with tables, a timestamp and an entry point each."""
    parts, groups = [], 0
    for i in range(0, len(payload), unit):
        parts += [_tables(), _elementary(payload[i : i + unit], i * CLOCK // SAMPLE_RATE)]
        groups += 1
    if not parts:
        parts, groups = [_tables()], 1
    out = np.concatenate(parts)
    pid = (out[:, 1].astype(np.int32) & 0x1F) << 8 | out[:, 2]
    for p in (PAT_PID, PMT_PID, DATA_PID):
        at = np.flatnonzero(pid == p)
        out[at, 3] |= (np.arange(len(at)) & 15).astype(np.uint8)
    return out.tobytes()


def _aligned(stream: bytes) -> tuple[np.ndarray, int]:
    """Packets in sync, and bytes that are in none: a place is in sync if a sync byte stands there and one packet on, or at the end."""
    data = np.frombuffer(stream, np.uint8)
    whole = len(data) // PACKET
    if len(data) == whole * PACKET and (data[::PACKET] == SYNC).all():
        return data.reshape(whole, PACKET), 0
    starts, i = [], 0
    marks = np.flatnonzero(data == SYNC)
    while i + PACKET <= len(data):
        if data[i] == SYNC and (i + PACKET == len(data) or data[i + PACKET] == SYNC or (starts and starts[-1] == i - PACKET)):
            starts.append(i)
            i += PACKET
        else:
            k = np.searchsorted(marks, i + 1)
            if k == len(marks):
                break
            i = int(marks[k])
    rows = data[np.array(starts, np.int64)[:, None] + np.arange(PACKET)] if starts else np.empty((0, PACKET), np.uint8)
    return rows, len(data) - len(starts) * PACKET


def _sections(payloads: list[bytes], starts: list[bool]) -> Iterator[bytes]:
    """Whole sections with a right CRC from the payloads of a table's packets."""
    kept: bytes | None = None
    for payload, start in zip(payloads, starts, strict=True):
        if start:
            if not payload:
                continue
            pointer = payload[0]
            parts = ([] if kept is None else [kept + payload[1 : 1 + pointer]]) + [payload[1 + pointer :]]
        else:
            parts = [] if kept is None else [kept + payload]
        kept = None
        for part in parts:
            while len(part) >= 3 and part[0] != 0xFF:
                size = 3 + (int.from_bytes(part[1:3], "big") & 0xFFF)
                if len(part) < size:
                    kept = part
                    break
                if size >= 12 and section_crc(part[:size]) == 0:
                    yield part[:size]
                part = part[size:]


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def read_stream(stream: bytes) -> dict:
    """What a transport stream holds: streams [{program, pid, type}], units [{pid, pts, dts, random_access, packet, offset, size,
    complete}] with offset and size in `data`, the units' bytes in order of their streams; packets, lost_bytes, errors
    (packets with the error flag), gaps (breaks of continuity counters without a discontinuity flag) and repeats."""
    rows, lost = _aligned(stream)
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    bad = (rows[:, 1] & 0x80) != 0
    start, control, counter = (rows[:, 1] & 0x40) != 0, rows[:, 3] >> 4 & 3, rows[:, 3] & 15
    extra = np.where(control & 2, rows[:, 4].astype(np.int32) + 1, 0)
    flags = np.where(((control & 2) != 0) & (extra > 1), rows[:, 5], 0)
    begin = np.where(control & 1, np.minimum(4 + extra, PACKET), PACKET)
    out = {"streams": [], "units": [], "data": b"", "packets": len(rows), "lost_bytes": lost, "errors": int(bad.sum()), "gaps": 0, "repeats": 0}

    def of(p: int) -> np.ndarray:
        return np.flatnonzero((pid == p) & ~bad)

    def table(p: int) -> list[bytes]:
        at = of(p)
        return list(dict.fromkeys(_sections([rows[i, begin[i] :].tobytes() for i in at], start[at].tolist())))

    programs: dict[int, int] = {}
    for s in table(PAT_PID):
        if s[0] == 0x00:
            for i in range(8, len(s) - 4, 4):
                if number := int.from_bytes(s[i : i + 2], "big"):
                    programs[number] = int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF
    types: dict[int, tuple[int, int]] = {}
    for number, p in programs.items():
        for s in table(p):
            if s[0] == 0x02 and int.from_bytes(s[3:5], "big") == number:
                i = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
                while i + 5 <= len(s) - 4:
                    types.setdefault(int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF, (number, s[i]))
                    i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0xFFF)
    parts, offset = [], 0
    for p, (number, kind) in sorted(types.items()):
        out["streams"].append({"program": number, "pid": p, "type": kind})
        at = of(p)
        at = at[(control[at] & 1) != 0]  # counters stand still without payload
        if not len(at):
            continue
        step = (counter[at][1:].astype(np.int32) - counter[at][:-1]) & 15
        same = np.concatenate([[False], (step == 0) & ((flags[at][1:] & 0x80) == 0)])
        jump = np.concatenate([[False], (step > 1) & ((flags[at][1:] & 0x80) == 0)])
        out["repeats"] += int(same.sum())
        out["gaps"] += int(jump.sum())
        at, jump = at[~same], jump[~same]
        sizes = PACKET - begin[at]
        ends = np.cumsum(sizes)
        bytes_ = rows[at][np.arange(PACKET) >= begin[at][:, None]].tobytes()
        heads = np.flatnonzero(start[at])
        for h, nxt in zip(heads, [*heads[1:], len(at)], strict=True):
            raw = bytes_[ends[h] - sizes[h] : ends[nxt - 1]]
            if raw[:3] != b"\x00\x00\x01" or len(raw) < 9:
                continue
            size, shown, behind = int.from_bytes(raw[4:6], "big"), raw[7] >> 6, 9 + raw[8]
            data = raw[behind : 6 + size if size else len(raw)]
            whole = not jump[h + 1 : nxt].any() and (not size or len(raw) >= 6 + size)
            pts = _ticks(raw[9:14]) if shown & 2 and len(raw) >= 14 else None
            dts = _ticks(raw[14:19]) if shown == 3 and len(raw) >= 19 else pts
            out["units"].append({"pid": p, "pts": pts, "dts": dts, "random_access": bool(flags[at[h]] & 0x40), "packet": int(at[h]), "offset": offset, "size": len(data), "complete": bool(whole)})
            parts.append(data)
            offset += len(data)
    out["data"] = b"".join(parts)
    return out


_STREAMS = pa.list_(pa.struct([("program", pa.int32()), ("pid", pa.int32()), ("type", pa.int32())]))
_UNITS = pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("packet", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("complete", pa.bool_())]))
_READ = {"streams": _STREAMS, "units": _UNITS, "data": pa.binary(), **{k: pa.int64() for k in ("packets", "lost_bytes", "errors", "gaps", "repeats")}}
READ_SCHEMA = (
    "streams array<struct<program: int, pid: int, type: int>>, units array<struct<pid: int, pts: bigint, dts: bigint, random_access: boolean, packet: bigint, offset: bigint, size: bigint, complete: boolean>>, "
    "data binary, packets bigint, lost_bytes bigint, errors bigint, gaps bigint, repeats bigint"
)


def pad(text: bytes | None, block: int = 64) -> bytes:
    """A text's bytes and then zeros up to a positive multiple of block."""
    text = text or b""
    return text.ljust(max(block, -(-len(text) // block) * block), b"\x00")


def _store(text_col: str, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [write_stream(pad(t)) for t in utf8(batch[text_col])]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(media, pa.binary())], [*keep, "media"])

    return run


def _read(media_col: str, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_stream(m or b"") for m in batch[media_col].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *(pa.array([f[k] for f in found], kind) for k, kind in _READ.items())], [*keep, *_READ])

    return run


def _fields(df: DataFrame, names: tuple[str, ...]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in names)


def store(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, media): each row's text (null: empty), zero-padded to a positive multiple of 64 bytes, as a transport stream.

    Equal texts give equal streams. Repeated rows come out as often as they came in; an empty table gives an empty result. keep must
    not name media.
    """
    prepare(docs.sparkSession)
    refuse(keep, ["media"])
    return docs.select(*dict.fromkeys((*keep, text_col))).mapInArrow(_store(text_col, keep), _fields(docs, keep) + "media binary")


def read(rows: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep and what read_stream gives) of each row's transport stream; null, empty and foreign bytes have no streams or units.

    A damaged stream gives what can be read: bytes out of sync, packets with the error flag, gaps and repeats are counted,
    and units that lack packets are not complete. Repeated rows come out as often as they came in; an empty table gives an empty
    result. keep must not name the new columns.
    """
    prepare(rows.sparkSession)
    refuse(keep, StructType.fromDDL(READ_SCHEMA).names)
    return rows.select(*dict.fromkeys((*keep, media_col))).mapInArrow(_read(media_col, keep), _fields(rows, keep) + READ_SCHEMA)
