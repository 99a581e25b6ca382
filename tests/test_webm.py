"""WebM headers, clusters, cues and paddings; pages of Ogg files; edits of a list of stages."""

import struct

import pytest

from tonaris.plans.params import Stages
from tonaris.sources import containers, decoders
from tonaris.sources.files import ogg_crc


def element(ident: int, body: bytes, unknown: bool = False) -> bytes:
    size = b"\x01" + b"\xff" * 7 if unknown else (1 << 56 | len(body)).to_bytes(8)
    return ident.to_bytes((ident.bit_length() + 7) // 8) + size + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8)))


def block(*packets: bytes, track: int = 1) -> bytes:
    if len(packets) == 1:
        return bytes([0x80 | track, 0, 0, 0]) + packets[0]
    return bytes([0x80 | track, 0, 0, 4, len(packets) - 1]) + b"".join(packets)


TWENTY, TEN = bytes([31 << 3, 1, 2]), bytes([30 << 3, 5, 6])  # 960 and 480 samples


def movie(duration: float | None = None, unknown: bool = False) -> bytes:
    head = b"OpusHead\x01\x02" + struct.pack("<HIhB", 312, 48000, 0, 0)
    info = element(containers.SCALE, (1_000_000).to_bytes(3)) + (element(containers.DURATION, struct.pack(">d", duration)) if duration else b"")
    video = element(0xAE, number(0xD7, 2) + number(0x83, 1) + element(0x86, b"V_VP9"))
    sound = element(0xAE, number(0xD7, 1) + number(0x83, 2) + element(0x86, b"A_OPUS") + element(0x63A2, head) + number(0x56AA, 6_500_000))
    start = element(0x1549A966, info) + element(0x1654AE6B, video + sound)
    padded = element(0xA0, element(0xA1, block(TWENTY)) + element(0x75A2, (5_000_000).to_bytes(4, signed=True)))
    longer = element(0xA0, element(0x75A2, (-5_000_000).to_bytes(4, signed=True)) + element(0xA1, block(TEN)))
    one = element(0x1F43B675, number(0xE7, 0) + element(0xA3, block(TWENTY)) + element(0xA3, block(TWENTY, TWENTY)) + element(0xA3, block(TWENTY, track=2)), unknown)
    two = element(0x1F43B675, number(0xE7, 60) + longer + padded, unknown)
    cue = lambda time, place: element(0xBB, number(0xB3, time) + element(0xB7, number(0xF7, 1) + number(0xF1, place)))
    cues = element(0x1C53BB6B, cue(60, len(start) + len(one)) + cue(0, len(start)))
    return element(0x1A45DFA3, element(0x4282, b"webm")) + element(0x18538067, start + one + two + cues, unknown)


@pytest.mark.parametrize("unknown", [False, True])
def test_webm_clusters_and_cues(spark, unknown):
    data = movie(unknown=unknown)
    table = spark.createDataFrame([("a", data), ("bad", b"\x1a\x45\xdf\xa3\x80"), ("none", None)], "path string, content binary")
    got = {r["path"]: r for r in containers.clusters(table).collect() if r["error"]}
    assert set(got) == {"bad", "none"} and "no Opus track" in got["bad"]["error"]
    rows = [tuple(r)[1:5] for r in containers.clusters(table.filter("path = 'a'")).collect()]
    assert [r[1:] for r in rows] == [(0, 0, 2880), (60_000_000, 2880, 480 + 240 + 960 - 240)]
    assert all(data[r[0] : r[0] + 4] == bytes.fromhex("1F43B675") for r in rows)
    points = [tuple(r)[1:3] for r in containers.cues(table.filter("path = 'a'")).collect()]
    assert points == [(0, rows[0][0]), (60_000_000, rows[1][0])]


def test_webm_length(spark):
    assert containers.webm(movie()) == {"container": "webm", "codec": "opus", "rate": 48000, "channels": 2, "total": 2880 + 1440 - 312, "skip": 312}
    assert containers.webm(movie(100.0))["total"] == 4800 - 312 and containers.webm(movie(1.0))["total"] is None
    table = spark.createDataFrame([("a", movie())], "path string, content binary")
    assert decoders.probe_files(table).first()["total"] == 2880 + 1440 - 312
    with pytest.raises(ValueError, match="no Opus track"):
        containers.webm(element(0x1A45DFA3, b"") + element(0x18538067, b""))


def test_packets_of_all_configurations():
    for config in range(32):
        ms = (10, 20, 40, 60)[config % 4] if config < 12 else (10, 20)[config % 2] if config < 16 else (2.5, 5, 10, 20)[config % 4]
        for code, second in ((0, 0), (1, 0), (2, 0), (3, 1), (3, 0), (3, 63)):
            n = {0: 1, 1: 2, 2: 2}.get(code, second) * ms * 48
            assert containers.packet_length(bytes([config << 3 | code, second])) == (n if 0 < n <= 5760 else -1)
    assert containers.packet_length(b"") == containers.packet_length(b"\x03") == -1


def page(granule: int, seq: int, body: bytes) -> bytes:
    head = b"OggS\0\0" + struct.pack("<qIII", granule, 7, seq, 0) + bytes([1, len(body)])
    return head[:22] + struct.pack("<I", ogg_crc(head + body)) + head[26:] + body


def test_last_page_of_an_ogg_file():
    head = b"OpusHead\x01\x02" + struct.pack("<HIhB", 312, 48000, 0, 0)
    start = page(0, 0, head)
    pages = [page(960 * k, k, bytes([k]) * 50) for k in range(1, 40)]
    assert containers.ogg(start + b"".join(pages), tail=200)["total"] == 960 * 39 - 312
    # a tail without a whole page: all of the file is read
    damaged = start + b"".join(pages[:-3]) + b"x" * 500
    assert containers.ogg(damaged, tail=200)["total"] == 960 * 36 - 312
    with pytest.raises(ValueError, match="pre-skip"):
        containers.ogg(start + page(100, 1, b"a"))


def test_edits_of_stages():
    stages = Stages([{"id": "gain-2", "kind": "gain"}])
    assert [stages.add("gain"), stages.add("gain"), stages.add("eq", "wide")] == ["gain-1", "gain-3", "wide-4"]
    stages.move("wide-4", 0)
    stages.move("gain-2", 3)
    assert [s["id"] for s in stages.specs] == ["wide-4", "gain-1", "gain-3", "gain-2"]
    stages.remove("gain-3")
    assert stages.add("gain") == "gain-5" and len(stages.specs) == 4
    for wrong in (lambda: stages.remove("gain-3"), lambda: stages.move("none", 0)):
        with pytest.raises(KeyError):
            wrong()
    with pytest.raises(IndexError):
        stages.move("gain-1", 4)
    with pytest.raises(ValueError, match="kind"):
        stages.add("")
