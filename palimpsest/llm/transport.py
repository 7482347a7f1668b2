"""Media columns: MPEG transport streams in a binary column.

``demux`` reads each value as a stream of 188-byte packets. Where sync bytes are not where they should be,
packets are looked for again. Headers of all packets of a group of streams are decoded at once with NumPy.
Program association and program map tables, whose sections may be cut over packets or share one (with
their CRC checked, in the order and version in which they are current), give programs and their elementary
streams; continuity counters tell duplicates (of equal bytes, dropped) from gaps (recorded); payloads are
put together to elementary packets, whose presentation and decoding timestamps, random-access mark and
bytes are stored: one row an elementary packet.

``mux`` writes such streams, for tables that have no media of their own.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.names import named
from palimpsest.llm.tokens import groups
from palimpsest.storage import ship

SIZE, SYNC = 188, 0x47
OUT = "doc_id long, program int, pid int, stream_type int, pes int, stream_id int, pts long, dts long, random_access boolean, gap boolean, complete boolean, n_packets int, scrambled boolean, data binary"
#: Stream ids whose elementary packets have no optional header: maps, padding, private 2, ECM, EMM, DSM-CC, H.222.1 E, directory.
BARE = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))
PMT_PID, VIDEO, AUDIO = 0x1000, 0x100, 0x101


def _crc_table() -> np.ndarray:
    t = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1) & 0xFFFFFFFF
        t[i] = c
    return t


_CRC = _crc_table().tolist()


def crc32_mpeg(data: bytes) -> int:
    """The tables' checksum; over a section with its checksum it is 0."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


@lru_cache(4096)
def _valid(section: bytes) -> bool:
    return len(section) >= 12 and crc32_mpeg(section) == 0


def _cut(held: bytes, out: list, position: int) -> bytes:
    """Takes the whole sections off the front; what is left may go on in the next packet."""
    while len(held) >= 3 and held[0] != 0xFF:
        n = 3 + ((held[1] & 0x0F) << 8 | held[2])
        if len(held) < n:
            return held
        if _valid(held[:n]):
            out.append((position, held[:n]))
        held = held[n:]
    return held if len(held) < 3 and held[:1] != b"\xff" else b""


def sections(packets: Iterator[tuple[int, bytes, bool, bool]]) -> list[tuple[int, bytes]]:
    """(position, section) of the valid sections of a PID's packets (position, payload, start, gap before it), each at the packet that ends it."""
    out: list[tuple[int, bytes]] = []
    held = b""
    for position, payload, start, gap in packets:
        if gap:
            held = b""
        if not payload:
            continue
        if start:
            tail, new = payload[1 : 1 + payload[0]], payload[1 + payload[0] :]
            if held:
                _cut(held + tail, out, position)
            held = _cut(new, out, position)
        elif held:
            held = _cut(held + payload, out, position)
    return out


def pat(s: bytes) -> list[tuple[int, int]]:
    """(PID of a map, program) of an association section."""
    return [((s[k + 2] & 0x1F) << 8 | s[k + 3], s[k] << 8 | s[k + 1]) for k in range(8, len(s) - 7, 4) if s[k] << 8 | s[k + 1]]


def pmt(s: bytes) -> dict[int, int]:
    """Stream type by PID, of a map section."""
    out, k = {}, 12 + ((s[10] & 0x0F) << 8 | s[11])
    while k + 5 <= len(s) - 4:
        out[(s[k + 1] & 0x1F) << 8 | s[k + 2]] = s[k]
        k += 5 + ((s[k + 3] & 0x0F) << 8 | s[k + 4])
    return out


class Programs:
    """What is on which PID, from where in the stream on."""

    def __init__(self, associations: list[tuple[int, bytes]]):
        self.pids: dict[int, set[int]] = {}  # programs by the PID of a map, at any time
        self.events: list[tuple[int, int, object]] = []
        version, parts = None, {}
        for at, s in associations:
            if s[0] == 0 and s[5] & 1:
                if s[5] >> 1 & 31 != version:
                    version, parts = s[5] >> 1 & 31, {}
                parts[s[6]] = pat(s)
                for pid, program in parts[s[6]]:
                    self.pids.setdefault(pid, set()).add(program)
                if len(parts) > s[7]:  # all sections of the version are here
                    self.events.append((at, 0, frozenset(p for x in parts.values() for _, p in x)))

    def add(self, pid: int, maps: list[tuple[int, bytes]]) -> None:
        for at, s in maps:
            if s[0] == 2 and s[5] & 1 and (program := s[3] << 8 | s[4]) in self.pids[pid]:
                self.events.append((at, 1, (program, pmt(s))))

    def done(self) -> None:
        now: dict[int, dict[int, int]] = {}
        self.at, self.known = [], []
        for at, kind, x in sorted(self.events, key=lambda e: e[:2]):
            if kind:
                now = now | {x[0]: x[1]}
            else:
                now = {p: m for p, m in now.items() if p in x}
            flat = {pid: (program, t) for program, m in now.items() for pid, t in m.items()}
            if not self.known or flat != self.known[-1]:
                self.at.append(at)
                self.known.append(flat)

    def of(self, pid: int, position: int) -> tuple[int, int] | None:
        """(program, stream type) by the tables that are current there, or if none before named it, by the first after."""
        k = bisect_right(self.at, position)
        if k and pid in self.known[k - 1]:
            return self.known[k - 1][pid]
        if any(pid in x for x in self.known[:k]):
            return None  # no longer
        return next((x[pid] for x in self.known[k:] if pid in x), None)


def stamp(b: bytes) -> int:
    """A 33-bit timestamp of five bytes."""
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def aligned(raw: np.ndarray) -> np.ndarray:
    """Where the packets of a stream begin: every 188 bytes, or where sync bytes are found again."""
    n = len(raw)
    at = np.arange(n // SIZE) * SIZE
    sync = raw == SYNC
    if sync[at].all():
        return at
    next1, next2 = np.ones(n, bool), np.ones(n, bool)  # beyond the end there is nothing to hold against it
    next1[: max(0, n - SIZE)] = sync[SIZE:]
    next2[: max(0, n - 2 * SIZE)] = sync[2 * SIZE :]
    fair = sync & (next1 | next2)
    (sure,) = np.nonzero(sync & next1 & next2)
    out, p = [], 0
    while p + SIZE <= n:
        if not fair[p]:  # the last packet before some junk, if a byte after it doesn't begin others
            k = int(np.searchsorted(sure, p))
            there = k < len(sure)
            if not (sync[p] and out and out[-1] == p - SIZE) or there and sure[k] < p + SIZE:
                if not there:
                    break
                p = int(sure[k])
                if p + SIZE > n:
                    break
        out.append(p)
        p += SIZE
    return np.array(out, np.int64)


def elementary(whole: bytes) -> tuple[int, int | None, int | None, int, int] | None:
    """(stream id, pts, dts, where the payload begins, where it ends or 0) of an elementary packet."""
    if len(whole) < 6 or whole[:3] != b"\0\0\1":
        return None
    sent = whole[4] << 8 | whole[5]
    end = 6 + sent if sent else 0
    if whole[3] in BARE:
        return whole[3], None, None, 6, end
    if len(whole) < 9 or whole[6] >> 6 != 2:
        return None
    pts = dts = None
    mark = whole[7] >> 6
    if mark & 2 and len(whole) >= 14:
        pts = dts = stamp(whole[9:14])
        if mark == 3 and len(whole) >= 19:
            dts = stamp(whole[14:19])
    return whole[3], pts, dts, 9 + whole[8], end


def parse(raw: np.ndarray, ends: np.ndarray) -> list[tuple]:
    """Rows (stream, program, pid, stream type, number, stream id, pts, dts, random access, gap, complete,
    packets, scrambled, bytes) of the streams ``raw[ends[k]:ends[k + 1]]``, in order of stream, pid and number."""
    places = [aligned(raw[a:b]) + a for a, b in zip(ends[:-1], ends[1:])]
    n = np.array([len(p) for p in places], np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    if not len(owner):
        return []
    at = np.concatenate(places)
    head = raw[at[:, None] + np.arange(6)].astype(np.int64)
    ok = (head[:, 0] == SYNC) & (head[:, 1] & 0x80 == 0)
    pid = (head[:, 1] & 0x1F) << 8 | head[:, 2]
    start, control, counter, secret = head[:, 1] >> 6 & 1, head[:, 3] >> 4 & 3, head[:, 3] & 15, head[:, 3] >> 6 > 0
    length = np.where(control & 2, head[:, 4] + 1, 0)
    flags = np.where((control & 2 > 0) & (head[:, 4] > 0), head[:, 5], 0)
    skip = np.where(control & 1, 4 + length, SIZE)
    ok &= (skip <= SIZE) & (pid != 0x1FFF)
    rows = np.nonzero(ok)[0]
    order = rows[np.lexsort((rows, pid[rows], owner[rows]))]
    same = np.zeros(len(order), bool)
    same[1:] = (owner[order][1:] == owner[order][:-1]) & (pid[order][1:] == pid[order][:-1])
    c, has = counter[order], control[order] & 1
    step = np.zeros(len(order), np.int64)
    step[1:] = (c[1:] - c[:-1]) & 15
    jump = (flags[order] & 0x80) > 0
    duplicate = same & (step == 0) & (has == 1)
    (twice,) = np.nonzero(duplicate)
    for k in range(0, len(twice), 4096):  # only packets of equal bytes; the adaptation field may carry another clock
        x = twice[k : k + 4096]
        one, two = (raw[at[order[y]][:, None] + np.arange(SIZE)] for y in (x - 1, x))
        equal = one == two
        equal[:, 4:] |= np.arange(4, SIZE) < skip[order[x]][:, None]
        duplicate[x] = equal.all(1) & (skip[order[x]] == skip[order[x - 1]])
    gap = same & ~duplicate & ~jump & (step != has)
    keep = ~duplicate
    order, gap = order[keep], gap[keep]
    own, p, first = owner[order], pid[order], start[order].astype(bool)
    new = np.ones(len(order), bool)
    new[1:] = (own[1:] != own[:-1]) | (p[1:] != p[:-1])
    edges = np.nonzero(new)[0].tolist() + [len(order)]
    data = raw.tobytes()
    body, upto = (at[order] + skip[order]).tolist(), (at[order] + SIZE).tolist()
    access, hidden = (flags[order] & 0x40) > 0, secret[order]
    position = order.tolist()
    runs = [(int(own[a]), int(p[a]), a, b) for a, b in zip(edges[:-1], edges[1:])]

    def packets(a: int, b: int) -> Iterator[tuple[int, bytes, bool, bool]]:
        return ((position[r], data[body[r] : upto[r]], bool(first[r]), bool(gap[r])) for r in range(a, b) if not hidden[r])

    programs = {k: Programs(sections(packets(a, b))) for k, q, a, b in runs if q == 0}
    for k, q, a, b in runs:
        if k in programs and q in programs[k].pids:
            programs[k].add(q, sections(packets(a, b)))
    for x in programs.values():
        x.done()
    out = []
    for k, q, a, b in runs:
        if k not in programs or q == 0:
            continue
        begins = (a + np.nonzero(first[a:b])[0]).tolist()
        for number, (r, s) in enumerate(zip(begins, [*begins[1:], b])):
            what = programs[k].of(q, position[r])
            if what is None:
                continue
            whole = b"".join([data[body[x] : upto[x]] for x in range(r, s)])
            scrambled = bool(hidden[r:s].any())
            lost = bool(gap[r + 1 : s].any()) or bool(s < b and gap[s])
            got = elementary(whole)
            if got is None:
                if not scrambled:
                    continue
                got = (None, None, None, 0, 0)  # its header can't be read
            sid, pts, dts, begin, end = got
            payload = whole[begin:end] if end else whole[begin:]
            complete = not lost and not scrambled and (not end or len(whole) >= end)
            out.append((k, what[0], q, what[1], number, sid, pts, dts, bool(access[r:s].any()), lost, complete, s - r, scrambled, payload))
    return out


def demux(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row an elementary packet (schema ``OUT``).

    ``gap``: a continuity counter is missing within it or right after it; ``complete``: none is, all
    announced bytes are there and none are scrambled. Of a scrambled packet whose header can't be read the
    stream id and timestamps are null. Null, empty and too short values give no rows; values may be of any
    length. Bytes that are in no packet are skipped; packets with the error mark are left out, and streams that no
    valid table names too, as are bytes before a stream's first start mark. A null id stays null (ids are
    whole numbers); repeated rows give repeated rows. Other columns are ignored; an empty table gives no rows.
    """
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in OUT.split(", ")]
        kinds = [pa.int64(), *[pa.int32()] * 5, pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.bool_(), pa.binary()]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, _, raw, ends in groups(batch.column(1)):
                rows = [(ids[i + r[0]], *r[1:]) for r in parse(raw, ends)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return media.select(named(id_col).cast("long").alias("doc_id"), named(media_col).cast("binary").alias("media")).mapInArrow(run, OUT)


def _table_packet(pid: int, section: bytes) -> bytes:
    s = section + crc32_mpeg(section).to_bytes(4, "big")
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + s).ljust(SIZE, b"\xff")


def _tables() -> bytes:
    a = bytes([0, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255])
    es = b"".join(bytes([t, 0xE0 | p >> 8, p & 255, 0xF0, 0]) for t, p in ((0x1B, VIDEO), (0x0F, AUDIO)))
    b = bytes([2, 0xB0, 13 + len(es), 0, 1, 0xC1, 0, 0, 0xE0 | VIDEO >> 8, VIDEO & 255, 0xF0, 0]) + es
    return _table_packet(0, a) + _table_packet(PMT_PID, b)


TABLES = _tables()
#: Bytes of an elementary packet that ``mux`` writes, and elementary packets between random-access points.
PES, ACCESS = 2048, 4


def _stamp_bytes(mark: int, v: int) -> bytes:
    return bytes([mark << 4 | v >> 29 & 14 | 1, v >> 22 & 255, v >> 14 & 254 | 1, v >> 7 & 255, v << 1 & 254 | 1])


def mux_one(data: bytes, base: int = 0, lose: int = 0) -> bytes:
    """A stream of one program whose video and audio in turn carry ``data``, PES bytes at a time.

    The first packet of every ACCESS-th elementary packet of a kind is a random-access point. lose:
    leave out each packet after the first of a kind whose number is a multiple of it, and repeat the
    one before; 0 for a stream without faults.
    """
    out, seen = [TABLES], {VIDEO: 0, AUDIO: 0}
    for k in range(0, len(data), PES):
        number = k // PES
        pid, sid = ((VIDEO, 0xE0), (AUDIO, 0xC0))[number % 2]
        pts = base + 3003 * number
        body = data[k : k + PES]
        if pid == VIDEO:
            extra = bytes([0x80, 0xC0, 10]) + _stamp_bytes(3, pts + 3003) + _stamp_bytes(1, pts)
        else:
            extra = bytes([0x80, 0x80, 5]) + _stamp_bytes(2, pts)
        body = b"\0\0\1" + bytes([sid]) + (len(extra) + len(body)).to_bytes(2, "big") + extra + body
        at, first = 0, True
        while at < len(body):
            access = first and number // 2 % ACCESS == 0
            field = b"\1\x40" if access else b""
            room = SIZE - 4 - len(field)
            rest = len(body) - at
            if rest < room:  # stuffing
                more = room - rest
                if not field:
                    field = bytes([more - 1]) + (b"\0" + b"\xff" * (more - 2) if more > 1 else b"")
                else:
                    field = bytes([1 + more, 0x40]) + b"\xff" * more
                room = rest
            packet = bytes([SYNC, (0x40 if first else 0) | pid >> 8, pid & 255, (0x30 if field else 0x10) | seen[pid] & 15]) + field + body[at : at + room]
            if not lose or seen[pid] == 0 or seen[pid] % lose:
                out.append(packet)
            else:
                out.append(out[-1])
            seen[pid] += 1
            at, first = at + room, False
    return b"".join(out)


def mux(docs: DataFrame, *, id_col: str = "doc_id", data_col: str = "text", faulty: int = 8, lose: int = 11) -> DataFrame:
    """(doc_id, media): streams that carry the bytes of a column; one id in ``faulty`` loses packets.

    A null value has a null stream; an empty one has tables only.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for k in range(0, len(batch), 256):
                some = ids.slice(k, 256).to_pylist()
                data = batch.column(1).slice(k, 256).to_pylist()
                media = [None if d is None else mux_one(d, (i or 0) * 90, lose if faulty and i is not None and i % faulty == 0 else 0) for i, d in zip(some, data)]
                yield pa.RecordBatch.from_arrays([ids.slice(k, 256), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(named(id_col).cast("long").alias("doc_id"), named(data_col).cast("binary").alias("data")).mapInArrow(run, "doc_id long, media binary")
