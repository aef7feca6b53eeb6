"""MPEG transport streams as a binary column: writing payloads into them, and reading any such stream back.

`mux` carries a payload in packetised elementary stream (PES) packets of a private-data stream: a program association
table (PAT) and a program map table (PMT) come before every random-access point, each PES packet has a presentation
time stamp (PTS), the first packet of each one a program clock reference (PCR). `demux` reads streams from anywhere:
it finds the sync bytes, parses and checks the tables, follows the continuity counters (dropping repeated packets),
puts elementary packets together, and lists their time stamps and random-access points.

Defined results: a null or empty text is a payload of 192 spaces; equal payloads give equal streams. Lost packets are
counted and mark the elementary packet they fall in as broken; sections with a wrong checksum are left out; bytes
between packets are skipped. An empty stream has no programs and no elementary packets. No rows give no rows, repeated
rows repeat, a null doc_id stays null, and other columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, PAT_PID, NULL_PID = 188, 0x47, 0x0000, 0x1FFF
PRIVATE_STREAM_1, PRIVATE_PES = 0xBD, 0x06
CRC_POLYNOMIAL = 0x04C11DB7
CLOCK = 90_000
#: Choices of the writer.
PROGRAM, PMT_PID, ES_PID = 1, 0x1000, 0x0100
UNIT, UNIT_TICKS, UNITS_PER_ACCESS = 192 * 32, CLOCK // 25, 4
PAYLOAD_MULTIPLE, PAD = 192, b" "


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        r = byte << 24
        for _ in range(8):
            r = ((r << 1) ^ CRC_POLYNOMIAL if r & 0x80000000 else r << 1) & 0xFFFFFFFF
        table.append(r)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    r = 0xFFFFFFFF
    for b in data:
        r = ((r << 8) & 0xFFFFFFFF) ^ _CRC[(r >> 24) ^ b]
    return r


def padded(payload: bytes) -> bytes:
    """The payload with spaces up to a positive multiple of 192 bytes."""
    return payload + PAD * (max(1, -(-len(payload) // PAYLOAD_MULTIPLE)) * PAYLOAD_MULTIPLE - len(payload))


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


_TABLES = np.stack([
    _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))),
    _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_PES]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")),
])


def _pts_bytes(ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def _pes_packets(unit: np.ndarray, ticks: int, access: bool, counter: int) -> np.ndarray:
    """The transport packets of one elementary packet."""
    head = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _pts_bytes(ticks)
    body = np.concatenate([np.frombuffer(head, np.uint8), unit])
    n = min(len(body), PACKET - 12)
    full, rest = divmod(len(body) - n, PACKET - 4)
    out = np.full((1 + full + (rest > 0), PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
    out[:, 3] = 0x10 | (counter + np.arange(len(out))) & 0x0F
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    out[0, 4], out[0, 5] = PACKET - 5 - n, 0x50 if access else 0x10
    out[0, 6:12] = np.frombuffer(((ticks & (1 << 33) - 1) << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
    out[0, PACKET - n :] = body[:n]
    if full:
        out[1 : 1 + full, 4:] = body[n : n + full * (PACKET - 4)].reshape(full, PACKET - 4)
    if rest:
        out[-1, 3] |= 0x20
        out[-1, 4] = PACKET - 5 - rest
        if rest < PACKET - 5:
            out[-1, 5] = 0
        out[-1, PACKET - rest :] = body[len(body) - rest :]
    return out


def mux(payload: bytes) -> bytes:
    """A transport stream that carries the payload."""
    data = np.frombuffer(payload, np.uint8)
    out, counter = [], 0
    for k, i in enumerate(range(0, len(data), UNIT)):
        access = k % UNITS_PER_ACCESS == 0
        if access:
            tables = _TABLES.copy()
            tables[:, 3] |= k // UNITS_PER_ACCESS & 0x0F
            out.append(tables)
        packets = _pes_packets(data[i : i + UNIT], k * UNIT_TICKS, access, counter)
        counter += len(packets)
        out.append(packets)
    return np.concatenate(out).tobytes() if out else b""


@dataclass
class Elementary:
    """An elementary packet: its stream, time stamp (ticks; None without one), random-access mark, payload and whether all of it came."""

    pid: int
    pts: int | None
    random_access: bool
    whole: bool
    payload: bytes


@dataclass
class Stream:
    packets: int = 0
    skipped_bytes: int = 0
    errors: int = 0
    repeated: int = 0
    bad_sections: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    kinds: dict[int, int] = field(default_factory=dict)
    units: list[Elementary] = field(default_factory=list)


def _synced(data: np.ndarray) -> tuple[np.ndarray, int]:
    """Rows of 188 bytes that begin with the sync byte, and how many bytes lie between them."""
    n = len(data) // PACKET
    if len(data) == n * PACKET and (data[::PACKET] == SYNC).all():
        return data.reshape(n, PACKET), 0
    starts, i = [], 0
    marks = np.flatnonzero(data == SYNC)
    while len(rest := marks[np.searchsorted(marks, i) :]):
        i = int(rest[0])
        if i + PACKET > len(data):
            break
        if i + PACKET == len(data) or data[i + PACKET] == SYNC or (starts and starts[-1] + PACKET == i):
            starts.append(i)
            i += PACKET
        else:
            i += 1
    rows = np.stack([data[s : s + PACKET] for s in starts]) if starts else np.zeros((0, PACKET), np.uint8)
    return rows, len(data) - rows.size


def _sections(chunks: list[tuple[bool, bytes]]) -> Iterator[bytes]:
    """Sections out of the payloads of one PID's packets, each with its start mark."""
    held, begun = b"", False
    for start, data in chunks:
        if start and data:
            skip = data[0]
            held, after = (held + data[1 : 1 + skip], data[1 + skip :])
            if begun and len(held) >= 3 and len(held) >= (size := 3 + int.from_bytes(held[1:3], "big") % 4096):
                yield held[:size]
            held, begun = after, True
        else:
            held += data
        while begun and len(held) >= 3 and held[0] != 0xFF and len(held) >= (size := 3 + int.from_bytes(held[1:3], "big") % 4096):
            yield held[:size]
            held = held[size:]


def demux(media: bytes) -> Stream:
    """What a transport stream holds."""
    rows, skipped = _synced(np.frombuffer(media, np.uint8))
    out = Stream(packets=len(rows), skipped_bytes=skipped)
    if not len(rows):
        return out
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    start, control, counter = rows[:, 1] & 0x40 > 0, rows[:, 3] >> 4 & 3, rows[:, 3] & 0x0F
    extra = np.where(control & 2, rows[:, 4].astype(np.int32) + 1, 0)
    flags = np.where(extra > 1, rows[:, 5], 0)
    sound = (rows[:, 1] & 0x80 == 0) & (extra <= PACKET - 4) & (rows[:, 3] >> 6 == 0)
    out.errors += int((~sound).sum())
    first = 4 + extra
    columns = np.arange(PACKET)

    def follow(p: int) -> tuple[np.ndarray, np.ndarray]:
        """The PID's packets with payload, without repeats, and which of them come after a loss."""
        at = np.flatnonzero((pid == p) & (control & 1 > 0) & sound)
        if len(at) > 1:
            step = (counter[at][1:].astype(np.int8) - counter[at][:-1]) % 16
            same = np.concatenate([[False], step == 0])
            if same.any():
                same[1:] &= (rows[at[1:], 12:] == rows[at[:-1], 12:]).all(axis=1)
                same[1:] &= ~same[:-1]
                out.repeated += int(same.sum())
                at = at[~same]
        lost = np.zeros(len(at), bool)
        lost[1:] = ((counter[at][1:].astype(np.int8) - counter[at][:-1]) % 16 != 1) & (flags[at][1:] & 0x80 == 0)
        out.errors += int(lost.sum())
        return at, lost

    def checked(p: int, table: int) -> Iterator[bytes]:
        at, _ = follow(p)
        for s in dict.fromkeys(_sections([(bool(start[i]), rows[i, first[i] :].tobytes()) for i in at])):
            if section_crc(s):
                out.bad_sections += 1
            elif s[0] == table and s[5] & 1:
                yield s

    for s in checked(PAT_PID, 0):
        for i in range(8, len(s) - 4, 4):
            if number := int.from_bytes(s[i : i + 2], "big"):
                out.programs[number] = int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF
    for p in dict.fromkeys(out.programs.values()):
        for s in checked(p, 2):
            i = 12 + (int.from_bytes(s[10:12], "big") & 0x0FFF)
            while i + 5 <= len(s) - 4:
                out.kinds[int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF] = s[i]
                i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0x0FFF)
    for p in out.kinds:
        at, lost = follow(p)
        begins = np.flatnonzero(start[at])
        if not len(begins):
            continue
        at, lost, begins = at[begins[0] :], lost[begins[0] :], begins - begins[0]
        data = rows[at][columns[None, :] >= first[at][:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(PACKET - first[at])])
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(at)], strict=True):
            unit = data[ends[a] : ends[b]]
            if unit[:3] != b"\x00\x00\x01" or len(unit) < 9:
                out.errors += 1
                continue
            size, begin = int.from_bytes(unit[4:6], "big"), 9 + unit[8]
            whole = not lost[a + 1 : b].any() and (b == len(at) or not lost[b]) and len(unit) >= 6 + size
            pts = (unit[9] & 0x0E) << 29 | unit[10] << 22 | (unit[11] & 0xFE) << 14 | unit[12] << 7 | unit[13] >> 1 if unit[7] & 0x80 and len(unit) >= 14 else None
            out.units.append(Elementary(p, pts, bool(flags[at[a]] & 0x40), whole, unit[begin : 6 + size if size else len(unit)]))
    return out


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text in UTF-8, and the stream that carries the padded text as column media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in common.blocks(batches):
            raw, edges = data.tobytes(), at.tolist()
            media = [mux(padded(raw[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(np.diff(at), pa.int64()), "media": pa.array(media, pa.binary())})

    return common.documents(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(media: DataFrame) -> DataFrame:
    """The streams' payloads, programs, elementary streams, time stamps with random-access points, and faults; other columns pass through."""
    extra = "payload binary, packets int, errors int, repeated int, bad_sections int, skipped_bytes long, programs map<int,int>, streams map<int,int>, units array<struct<pid:int,pts:long,random_access:boolean,whole:boolean,bytes:int>>"
    kept = [f for f in media.schema.fields if f.name not in {x.split()[0] for x in extra.split(", ")}]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), extra])
    unit = pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("random_access", pa.bool_()), ("whole", pa.bool_()), ("bytes", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in common.blocks(batches, "media"):
            raw, edges = data.tobytes(), at.tolist()
            found = [demux(raw[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            column = lambda f, kind: pa.array([f(x) for x in found], kind)
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in kept} | {
                "payload": column(lambda x: b"".join(u.payload for u in x.units), pa.binary()),
                "packets": column(lambda x: x.packets, pa.int32()), "errors": column(lambda x: x.errors, pa.int32()), "repeated": column(lambda x: x.repeated, pa.int32()),
                "bad_sections": column(lambda x: x.bad_sections, pa.int32()), "skipped_bytes": column(lambda x: x.skipped_bytes, pa.int64()),
                "programs": column(lambda x: [*x.programs.items()], pa.map_(pa.int32(), pa.int32())), "streams": column(lambda x: [*x.kinds.items()], pa.map_(pa.int32(), pa.int32())),
                "units": column(lambda x: [{"pid": u.pid, "pts": u.pts, "random_access": u.random_access, "whole": u.whole, "bytes": len(u.payload)} for u in x.units], pa.list_(unit)),
            })

    return media.select(*(f.name for f in kept)).mapInArrow(run, schema)


def digests(read_back: DataFrame) -> DataFrame:
    """Checksums of payload and stream, and a feature string of what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["payload", "media", "packets", "errors", "programs", "streams", "units"]).to_pylist()
            sums = []
            for r in rows:
                p, units = r["payload"], r["units"]
                index = ",".join(f"{u['pts']}{'r' if u['random_access'] else ''}" for u in units)
                feature = f"programs={dict(r['programs'])};streams={dict(r['streams'])};packets={r['packets']};errors={r['errors']};units={len(units)};whole={sum(u['whole'] for u in units)};access={sum(u['random_access'] for u in units)};last_pts={units[-1]['pts'] if units else ''};index={zlib.crc32(index.encode()):08x}"
                sums.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(r["media"]), hashlib.sha256(r["media"]).hexdigest(), feature))
            names, kinds = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            found = zip(*sums, strict=True) if sums else [[]] * 6
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")} | {n: pa.array(x, k) for n, k, x in zip(names, kinds, found, strict=True)})

    return read_back.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
