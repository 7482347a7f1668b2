"""Streams made by hand here, byte by byte, not by the operator's own writer."""

import numpy as np
import pytest

from palimpsest.llm import transport


def crc(data):
    c = 0xFFFFFFFF
    for b in data:
        for k in range(8):
            c = (c << 1 ^ (0x04C11DB7 if (c >> 31) ^ (b >> (7 - k) & 1) else 0)) & 0xFFFFFFFF
    return c


def section(table, number, body, version=0, current=1, part=0, last=0):
    s = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255]) + number.to_bytes(2, "big") + bytes([0xC0 | version << 1 | current, part, last]) + body
    return s + crc(s).to_bytes(4, "big")


def pat(programs, **k):
    return section(0, 1, b"".join(n.to_bytes(2, "big") + (0xE000 | p).to_bytes(2, "big") for n, p in programs.items()), **k)


def pmt(program, streams, **k):
    return section(2, program, b"\xe1\x00\xf0\x00" + b"".join(bytes([t]) + (0xE000 | p).to_bytes(2, "big") + b"\xf0\x00" for p, t in streams.items()), **k)


class Writer:
    def __init__(self):
        self.count, self.packets = {}, []

    def packet(self, pid, payload, start=False, scrambled=0, access=False):
        assert len(payload) <= 184 - 2 * access
        c = self.count[pid] = (self.count.get(pid, -1) + 1) & 15
        room = 184 - len(payload)
        field = b""
        if room:
            field = bytes([room - 1]) + (bytes([0x40 if access else 0]) + b"\xff" * (room - 2) if room > 1 else b"")
        self.packets.append(bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, scrambled << 6 | (0x30 if field else 0x10) | c]) + field + payload)
        return self

    def table(self, pid, *sections, stuff=True):
        data = b"\0" + b"".join(sections)
        for k in range(0, len(data), 184):
            part = data[k : k + 184]
            self.packet(pid, part.ljust(184, b"\xff") if stuff else part, start=k == 0)
        return self

    def pes(self, pid, data, sid=0xE0, pts=None, dts=None, length=True, access=False, **k):
        def stamp(mark, v):
            return bytes([mark << 4 | (v >> 30) << 1 | 1, v >> 22 & 255, (v >> 15 & 127) << 1 | 1, v >> 7 & 255, (v & 127) << 1 | 1])

        stamps = b"" if pts is None else stamp(2, pts) if dts is None else stamp(3, pts) + stamp(1, dts)
        extra = b"" if sid in (0xBE, 0xBF, 0xF0) else bytes([0x80, 0 if pts is None else 0x80 if dts is None else 0xC0, len(stamps)]) + stamps
        n = len(extra) + len(data) if length else 0
        whole = b"\0\0\1" + bytes([sid]) + n.to_bytes(2, "big") + extra + data
        at = 0
        while at < len(whole):
            room = 184 - 2 * (access and at == 0)
            self.packet(pid, whole[at : at + room], start=at == 0, access=access and at == 0, **k)
            at += room
        return self

    @property
    def bytes(self):
        return b"".join(self.packets)


NAMES = "stream program pid type number sid pts dts access gap complete packets scrambled data".split()


def read(*streams):
    raw = np.frombuffer(b"".join(streams), np.uint8)
    return [dict(zip(NAMES, r)) for r in transport.parse(raw, np.cumsum([0, *map(len, streams)]))]


def small(data=b"payload" * 60, **k):
    return Writer().table(0, pat({1: 0x100})).table(0x100, pmt(1, {0x101: 0x1B})).pes(0x101, data, **k)


def test_one_program():
    w = small(pts=2**33 - 1, dts=5, access=True).pes(0x101, b"second", pts=90)
    a, b = read(w.bytes)
    assert (a["program"], a["pid"], a["type"], a["sid"], a["pts"], a["dts"], a["access"], a["complete"], a["data"]) == (1, 0x101, 0x1B, 0xE0, 2**33 - 1, 5, True, True, b"payload" * 60)
    assert (b["pts"], b["dts"], b["access"], b["number"], b["data"], b["packets"]) == (90, 90, False, 1, b"second", 1)


def test_long_tables_over_packets_and_several_in_one():
    streams = {0x200 + k: 0x0F for k in range(50)}
    w = Writer().table(0, pat({7: 0x100, 8: 0x100})).table(0x100, pmt(7, streams), pmt(8, {0x300: 0x1B}))
    for p in (*streams, 0x300):
        w.pes(p, b"x%d" % p)
    assert {(r["program"], r["pid"], r["data"]) for r in read(w.bytes)} == {(7, p, b"x%d" % p) for p in streams} | {(8, 0x300, b"x768")}
    lost = [p for k, p in enumerate(w.packets) if k != 2]  # the second packet of the table
    assert {r["pid"] for r in read(b"".join(lost))} == set()


def test_association_of_several_sections():
    many = {k: 0x100 + k for k in range(1, 80)}
    w = Writer().table(0, pat(dict(list(many.items())[:40]), last=1)).table(0, pat(dict(list(many.items())[40:]), part=1, last=1))
    w.table(0x100 + 79, pmt(79, {0x301: 3})).pes(0x301, b"far")
    assert [(r["program"], r["data"]) for r in read(w.bytes)] == [(79, b"far")]


@pytest.mark.parametrize("junk", [b"\0", b"junk", b"\x47" * 5, bytes(range(200)), b"\x47" + b"\1" * 187])
def test_packets_are_found_again(junk):
    w = small(b"one")
    for k in range(6):
        w.pes(0x101, b"more%d" % k)
    for cut in (0, 2, 3):
        s = b"".join(w.packets[:cut]) + junk + b"".join(w.packets[cut:])
        assert [r["data"] for r in read(s, w.bytes) if r["stream"] == 0] == [b"one"] + [b"more%d" % k for k in range(6)]
        assert [r["data"] for r in read(w.bytes + junk)] == [b"one"] + [b"more%d" % k for k in range(6)]
    broken = [p if k != 4 else b"\0" + p[1:] for k, p in enumerate(w.packets)]
    got = read(b"".join(broken))
    assert [r["data"] for r in got] == [b"one", b"more0"] + [b"more%d" % k for k in range(2, 6)] and got[1]["gap"]


@pytest.mark.parametrize("sid", [0xBE, 0xBF, 0xF0])
def test_ids_without_an_optional_header(sid):
    (r,) = read(small(bytes(range(20)), sid=sid).bytes)
    assert (r["sid"], r["pts"], r["data"], r["complete"]) == (sid, None, bytes(range(20)), True)


def test_versions_in_order():
    w = small(b"old").pes(0x101, b"old too").table(0x100, pmt(1, {0x101: 0x24, 0x102: 0x0F}, version=1)).pes(0x101, b"new").pes(0x102, b"sound")
    w.table(0x100, pmt(1, {0x102: 0x03}, version=2, current=0)).pes(0x102, b"same")
    w.table(0, pat({2: 0x110}, version=1)).table(0x110, pmt(2, {0x102: 0x1B})).pes(0x102, b"other").pes(0x101, b"gone")
    got = sorted((r["data"], r["program"], r["type"]) for r in read(w.bytes))
    assert got == sorted([(b"old", 1, 0x1B), (b"old too", 1, 0x1B), (b"new", 1, 0x24), (b"sound", 1, 0x0F), (b"same", 1, 0x0F), (b"other", 2, 0x1B)])


def test_tables_after_the_packets_they_name():
    w = Writer().pes(0x101, b"early").table(0, pat({1: 0x100})).table(0x100, pmt(1, {0x101: 6}))
    assert [(r["data"], r["type"]) for r in read(w.bytes)] == [(b"early", 6)]


def test_duplicates_are_of_equal_bytes():
    w = small(bytes(range(256)) * 20)
    twice = [p for k, p in enumerate(w.packets) for _ in range(1 + (k == 7))]
    (r,) = read(b"".join(twice))
    assert r["complete"] and r["data"] == bytes(range(256)) * 20
    lost = w.packets[:7] + w.packets[7 + 16 :]  # the counter is as if nothing were lost
    other = [*w.packets[:8], *w.packets[8 + 15 :]]  # equal counter, other bytes
    (a,), (b,) = read(b"".join(lost)), read(b"".join(other))
    assert not a["complete"] and not b["complete"] and b["gap"]
    assert b["packets"] == len(w.packets) - 2 - 15


def test_scrambled_marked_and_damaged():
    w = small(b"clear").pes(0x101, b"secret", scrambled=2)
    w.packets[-1] = w.packets[-1][:-13] + bytes(range(13))  # not a start code any more
    a, b = read(w.bytes)
    assert a["data"] == b"clear" and not a["scrambled"] and b["scrambled"] and not b["complete"] and b["sid"] is None
    error = [p if k != 2 else p[:1] + bytes([p[1] | 0x80]) + p[2:] for k, p in enumerate(small(b"x" * 1000).packets)]
    assert read(b"".join(error)) == []


def test_unbounded_length_and_nothing():
    (r,) = read(small(b"z" * 70_000, length=False).bytes)
    assert r["data"] == b"z" * 70_000 and r["complete"]
    assert read(b"", b"\x47", b"no stream at all" * 100) == []
