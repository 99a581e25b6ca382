"""Headers of compressed audio files: what can be known of a stream without decoding it.

Every probe maps a file's bytes to a dict with some of container, codec, rate, channels, total (source samples) and skip (samples
to drop at the start), or raises ValueError. ``probe`` runs them over files; what can't be read comes back with an error, not dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tonaris.sources.files import ebml_elements, ogg_pages, parse_wav

#: Bit rates and sample rates of MPEG audio layer III, by version.
_KBPS = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
#: Ids of WebM elements.
SCALE, DURATION, TRACK, NUMBER, KIND, CODEC, PRIVATE, DELAY = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x83, 0x86, 0x63A2, 0x56AA
SEGMENT, CLUSTER, TIME, SIMPLE, GROUP, BLOCK, PADDING, CUE, CUE_TIME, CUE_PLACE = 0x18538067, 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x75A2, 0xBB, 0xB3, 0xF1
#: Where the last page of an Ogg file is looked for first.
TAIL = 1 << 16
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _after_id3(data: bytes) -> int:
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    size = 0
    for b in data[6:10]:
        size = size << 7 | b & 127
    return 10 + size + (10 if data[5] & 0x10 else 0)


def flac(data: bytes) -> dict:
    """STREAMINFO of a FLAC file."""
    at = _after_id3(data)
    if data[at : at + 4] != b"fLaC":
        raise ValueError("not a FLAC file")
    at += 4
    while at + 4 <= len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4])
        body = data[at + 4 : at + 4 + size]
        if kind & 127 == 0 and len(body) >= 18:
            bits = int.from_bytes(body[10:18])
            total = bits & (1 << 36) - 1
            return {"container": "flac", "codec": "flac", "rate": bits >> 44, "channels": (bits >> 41 & 7) + 1, "total": total or None, "skip": 0}
        if kind & 128:
            break
        at += 4 + size
    raise ValueError("no STREAMINFO")


def mp3(data: bytes) -> dict:
    """First frame header of an MP3 file, and the frame count of its Xing, Info or VBRI header if it has one."""
    at = _after_id3(data)
    while at + 4 <= len(data):
        head = int.from_bytes(data[at : at + 4])
        version, layer, rate, kbps = head >> 19 & 3, head >> 17 & 3, head >> 10 & 3, head >> 12 & 15
        if head >> 21 == 0x7FF and version != 1 and layer == 1 and rate < 3 and 0 < kbps < 15:
            break
        at = data.find(b"\xff", at + 1)
        if at < 0:
            raise ValueError("no frame")
    else:
        raise ValueError("no frame")
    mono, first = head >> 6 & 3 == 3, version == 3
    hz, per = _RATES[version][rate], 1152 if first else 576
    side = (17 if mono else 32) if first else (9 if mono else 17)
    tag, frames, skip = at + 4 + side, None, 0
    if data[tag : tag + 4] in (b"Xing", b"Info"):
        flags = int.from_bytes(data[tag + 4 : tag + 8])
        place = tag + 8
        if flags & 1:
            frames = int.from_bytes(data[place : place + 4])
            place += 4
        place += (4 if flags & 2 else 0) + (100 if flags & 4 else 0) + (4 if flags & 8 else 0)
        if len(data) >= place + 24 and data[place : place + 4] in (b"LAME", b"Lavc", b"Lavf"):
            skip = int.from_bytes(data[place + 21 : place + 24]) >> 12
    elif data[at + 36 : at + 40] == b"VBRI":
        frames = int.from_bytes(data[at + 50 : at + 54])
    return {"container": "mp3", "codec": "mp3", "rate": hz, "channels": 1 if mono else 2, "total": frames * per if frames else None, "skip": skip, "kbps": _KBPS[1 if first else 2][kbps]}


def boxes(data: bytes, lo: int = 0, hi: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the payload of each box between two offsets; a box cut by the end is the last."""
    hi = len(data) if hi is None else hi
    while lo + 8 <= hi:
        size, name, head = int.from_bytes(data[lo : lo + 4]), data[lo + 4 : lo + 8], 8
        if size == 1 and lo + 16 <= hi:
            size, head = int.from_bytes(data[lo + 8 : lo + 16]), 16
        size = hi - lo if size == 0 else size
        if size < head:
            return
        yield name, lo + head, min(hi, lo + size)
        lo += size


def _find(data: bytes, lo: int, hi: int, *path: bytes) -> tuple[int, int] | None:
    for name, a, b in boxes(data, lo, hi):
        if name == path[0]:
            found = (a, b) if len(path) == 1 else _find(data, a, b, *path[1:])
            if found:
                return found
    return None


def m4a(data: bytes) -> dict:
    """Rate, length and edit list of the first sound track of an MP4 file: ``skip`` is the edit's media time, ``total`` its length in samples."""
    if data[4:8] != b"ftyp":
        raise ValueError("not an MP4 file")
    movie = _find(data, 0, len(data), b"moov")
    for name, a, b in boxes(data, *movie) if movie else ():
        handler = _find(data, a, b, b"mdia", b"hdlr") if name == b"trak" else None
        if not handler or data[handler[0] + 8 : handler[0] + 12] != b"soun":
            continue
        lo, _ = _find(data, a, b, b"mdia", b"mdhd") or (None, None)
        if lo is None:
            break
        rate, total = struct.unpack_from(">IQ", data, lo + 20) if data[lo] else struct.unpack_from(">II", data, lo + 12)
        scale_at, _ = _find(data, *movie, b"mvhd") or (None, None)
        skip, edit = 0, _find(data, a, b, b"edts", b"elst")
        if edit and scale_at is not None:
            scale = struct.unpack_from(">I", data, scale_at + (20 if data[scale_at] else 12))[0]
            n, at = struct.unpack_from(">I", data, edit[0] + 4)[0], edit[0] + 8
            step, shape = (20, ">Qq") if data[edit[0]] else (12, ">Ii")
            for k in range(n):
                length, media = struct.unpack_from(shape, data, at + k * step)
                if media >= 0:
                    skip, total = media, length * rate // scale if scale else total
                    break
        return {"container": "mp4", "codec": "aac", "rate": rate, "total": total, "skip": skip}
    raise ValueError("no sound track")


def ogg_packets(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """Stream, page number, granule (of the page a packet ends on; -1 if another packet ends there after it) and bytes of each packet.

    Packets run on over pages of their stream; a page that is missing or damaged breaks the packet that is open.
    """
    held: dict[int, tuple[int, bytes]] = {}
    for at, granule, seq, good in ogg_pages(data):
        serial, n = struct.unpack_from("<I", data, at + 14)[0], data[at + 26]
        if not good:
            held.pop(serial, None)
            continue
        table, body = data[at + 27 : at + 27 + n], at + 27 + n
        before, rest = held.pop(serial, (None, b""))
        going = bool(data[at + 5] & 1)
        rest, broken = (rest, False) if going and before == seq - 1 else (b"", going)
        ends = [i for i, size in enumerate(table) if size < 255]
        start = 0
        for k, end in enumerate(ends):
            size = sum(table[start : end + 1])
            if not broken:
                yield serial, seq, granule if k == len(ends) - 1 else -1, rest + data[body : body + size]
            rest, broken, body, start = b"", False, body + size, end + 1
        if start < n and not broken:
            held[serial] = (seq, rest + data[body : body + sum(table[start:])])


def ogg(data: bytes, tail: int = TAIL) -> dict:
    """Channels, pre-skip and length at 48 kHz of an Ogg Opus file: the last good page's granule less the pre-skip.

    That page is looked for in the last ``tail`` bytes, and if none is whole there, in all of the file. Without one the length
    is not known; a granule before the pre-skip is an error.
    """
    first = next((p for *_, p in ogg_packets(data)), b"")
    if first[:8] != b"OpusHead" or len(first) < 19:
        raise ValueError("not an Ogg Opus file")
    skip = struct.unpack_from("<H", first, 10)[0]
    last = None
    for part in (data[-tail:], data):
        last = max((o, g) for o, g in [(-1, -1), *((o, g) for o, g, _, good in ogg_pages(part) if good and g >= 0)])[1]
        if last >= 0:
            break
    if 0 <= last < skip:
        raise ValueError(f"granule {last} is before the pre-skip {skip}")
    return {"container": "ogg", "codec": "opus", "rate": 48000, "channels": first[9], "total": last - skip if last >= 0 else None, "skip": skip, "gain": struct.unpack_from("<h", first, 16)[0]}


def wav(data: bytes) -> dict:
    rate, x = parse_wav(data)
    return {"container": "wav", "codec": "wav", "rate": rate, "channels": x.shape[1], "total": len(x), "skip": 0}


def vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """A number of variable length and where it ends; ``keep``: with its length mark. All ones: -1 (unknown)."""
    if at >= len(data) or not data[at]:
        raise ValueError("no number")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError("a number is cut")
    value = int.from_bytes(data[at : at + n])
    if not keep:
        value &= (1 << 7 * n) - 1
        value = -1 if value == (1 << 7 * n) - 1 else value
    return value, at + n


def laced(block: bytes) -> list[bytes]:
    """Frames of a WebM block: one, or several laced by Xiph, fixed or EBML sizes."""
    _, at = vint(block, 0)
    flags, at = block[at + 2], at + 3
    kind = flags >> 1 & 3
    if not kind:
        return [block[at:]]
    n, at = block[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (len(block) - at) % n:
            raise ValueError("frames of unequal size")
        sizes = [(len(block) - at) // n] * (n - 1)
    for k in range(n - 1 if kind != 2 else 0):
        if kind == 1:
            size = 0
            while True:
                size, at = size + block[at], at + 1
                if block[at - 1] < 255:
                    break
        else:
            size, end = vint(block, at)
            if k:  # later sizes are signed differences
                size = sizes[-1] + size - ((1 << 7 * (end - at) - 1) - 1)
            at = end
        sizes.append(size)
    out = []
    for size in sizes:
        if size < 0 or at + size > len(block):
            raise ValueError("a frame is cut")
        out.append(block[at : at + size])
        at += size
    return [*out, block[at:]]


def packet_length(packet: bytes) -> int:
    """Samples at 48 kHz of an Opus packet, -1 if it can't be timed."""
    if not packet:
        return -1
    config, code = packet[0] >> 3, packet[0] & 3
    if config < 12:
        each = (480, 960, 1920, 2880)[config & 3]
    else:
        each = 480 << (config & 1) if config < 16 else 120 << (config & 3)
    count = 1 + (code > 0) if code < 3 else packet[1] & 63 if len(packet) > 1 else 0
    return each * count if 0 < each * count <= 5760 else -1


def _block_length(block: bytes, padding: int) -> int:
    """Samples of a block's packets: a positive padding (nanoseconds) cuts its end, a negative one adds silence."""
    n = sum(max(0, packet_length(p)) for p in laced(block))
    cut = (abs(padding) * 48_000 + 500_000_000) // 1_000_000_000
    return n - min(n, cut) if padding > 0 else n + cut


def _webm(data: bytes) -> dict:
    """What one walk over a WebM file finds: scale, duration, where its segment begins, the Opus track, its clusters and cues."""
    out: dict = {"scale": 1_000_000, "duration": None, "segment": 0}
    tracks, clusters, cues = [], [], []
    for at, ident, size, _ in ebml_elements(data):
        part = _payload(data, at, size) if ident not in (SEGMENT, CLUSTER) else b""
        value = int.from_bytes(part) if size <= 8 else 0
        if ident == SEGMENT:
            out["segment"] = at + 4 + 9 - data[at + 4].bit_length()
        elif ident == SCALE:
            out["scale"] = value or 1_000_000
        elif ident == DURATION and size in (4, 8):
            out["duration"] = struct.unpack(">f" if size == 4 else ">d", part)[0]
        elif ident == TRACK:
            tracks.append({})
        elif ident in (NUMBER, KIND, DELAY) and tracks:
            tracks[-1].setdefault(ident, value)
        elif ident in (CODEC, PRIVATE) and tracks:
            tracks[-1].setdefault(ident, part)
        elif ident == CLUSTER:
            clusters.append({"offset": at, "time": 0, "blocks": []})
        elif ident == TIME and clusters:
            clusters[-1]["time"] = value
        elif ident == SIMPLE and clusters:
            clusters[-1]["blocks"].append((part, 0))
        elif ident == GROUP and clusters:
            inside = {i: _payload(part, o, n) for o, i, n, _ in ebml_elements(part)}
            if BLOCK in inside:
                clusters[-1]["blocks"].append((inside[BLOCK], int.from_bytes(inside.get(PADDING, b""), signed=True)))
        elif ident == CUE:
            cues.append({})
        elif ident in (CUE_TIME, CUE_PLACE) and cues:
            cues[-1][ident] = value
    track = next((t for t in tracks if t.get(KIND) == 2 and t.get(CODEC, b"").rstrip(b"\0") == b"A_OPUS"), None)
    if track is None:
        raise ValueError("no Opus track")
    position = 0
    for c in clusters:
        c["position"] = position
        position += sum(_block_length(block, padding) for block, padding in c.pop("blocks") if vint(block, 0)[0] == track.get(NUMBER))
        c["time"] *= out["scale"]
        c["samples"] = position - c["position"]
    points = sorted((c[CUE_TIME] * out["scale"], out["segment"] + c[CUE_PLACE]) for c in cues if len(c) == 2)
    return out | {"track": track, "clusters": clusters, "cues": points, "samples": position}


def _payload(data: bytes, at: int, size: int) -> bytes:
    """The payload of the element at an offset."""
    at += 9 - data[at].bit_length()
    at += 9 - data[at].bit_length()
    return data[at : at + size]


def webm(data: bytes) -> dict:
    """Channels, pre-skip and length at 48 kHz of a WebM file's first Opus track, by its stated duration or else by its packets."""
    found = _webm(data)
    head, ticks = found["track"].get(PRIVATE, b""), found["duration"]
    skip = (found["track"].get(DELAY, 0) * 48_000 + 500_000_000) // 1_000_000_000
    if not skip and head[:8] == b"OpusHead" and len(head) >= 12:
        skip = struct.unpack_from("<H", head, 10)[0]
    whole = int(ticks * found["scale"] * 48_000 / 1e9 + 0.5) if ticks is not None and 0 < ticks < 1e18 else found["samples"]
    return {"container": "webm", "codec": "opus", "rate": 48000, "channels": head[9] if len(head) > 9 else None, "total": whole - skip if whole >= skip else None, "skip": skip}


def _rows(table: DataFrame, names: list[str], walk) -> DataFrame:
    """``path, names..., error`` of files (path, content): a row for each tuple, or one with an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = [(path, *r, None) for r in walk(bytes(data))]
                except (ValueError, TypeError, IndexError, struct.error) as e:
                    rows = [(path, *[None] * len(names), f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", *names, "error"]).astype(dict.fromkeys(names, "Int64"))

    return table.select("path", "content").mapInPandas(run, "path string, " + ", ".join(f"{n} long" for n in names) + ", error string")


def clusters(table: DataFrame) -> DataFrame:
    """Seek index of WebM files: offset, time, and first sample and samples at 48 kHz of each cluster, by its packets and paddings."""
    return _rows(table, ["offset", "time_ns", "position", "samples"], lambda d: [(c["offset"], c["time"], c["position"], c["samples"]) for c in _webm(d)["clusters"]])


def cues(table: DataFrame) -> DataFrame:
    """Cue points of WebM files by time: where in the file the cluster of each begins."""
    return _rows(table, ["time_ns", "offset"], lambda d: _webm(d)["cues"])


PROBES = {"flac": flac, "mp3": mp3, "m4a": m4a, "ogg": ogg, "wav": wav, "webm": webm}
_FIELDS = {"container": "string", "codec": "string", "rate": "long", "channels": "long", "total": "long", "skip": "long"}


def probe(table: DataFrame, kind: str = "kind") -> DataFrame:
    """``path`` and what its header tells (container, codec, rate, channels, total, skip), or ``error``; ``table``: path, content and the kind to probe as."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, data, k in zip(pdf["path"], pdf["content"], pdf[kind], strict=True):
                try:
                    found = PROBES[k](bytes(data))
                    rows.append({"path": path, **{f: found.get(f) for f in _FIELDS}, "error": None})
                except (ValueError, KeyError, TypeError, IndexError, ZeroDivisionError, struct.error) as e:
                    rows.append({"path": path, **dict.fromkeys(_FIELDS), "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["path", *_FIELDS, "error"]).astype({f: "Int64" for f, t in _FIELDS.items() if t == "long"})

    return table.select("path", "content", kind).mapInPandas(run, "path string, " + ", ".join(f"{f} {t}" for f, t in _FIELDS.items()) + ", error string")
