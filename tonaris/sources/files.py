"""File sources: PCM files to SAMPLES, container indexes without decoding, and a PCM writer."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonaris.functions.scalars import ogg_crc


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below ``path`` as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def sniff(content) -> F.Column:
    """Container by magic bytes in the header, else null."""
    head = F.hex(F.substring(content, 1, 16))
    riff = head.rlike("^(52494646|52463634|42573634).{8}57415645")
    return (
        F.when(riff, "wav").when(head.startswith("664C6143"), "flac").when(head.startswith("4F676753"), "ogg").when(head.startswith("1A45DFA3"), "webm")
        .when(head.rlike("^.{8}66747970"), "m4a").when(head.startswith("494433"), "mp3").when(head.rlike("^FFF[0189]"), "aac").when(head.rlike("^FF[EF][2-7A-F]"), "mp3")
    )


def parse_wav(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and (frames, 2) samples: PCM of 8 to 32 bits, float of 32 or 64 bits; mono feeds both sides, more channels than two are cut to two."""
    if data[:4] not in (b"RIFF", b"RF64", b"BW64") or data[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at, fmt, body = 12, None, b""
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", data, at + 8)
            if fmt[0] == 0xFFFE and size >= 26:
                fmt = (struct.unpack_from("<H", data, at + 32)[0], *fmt[1:])
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if fmt is None:
        raise ValueError("no format chunk")
    kind, channels, rate, _, _, bits = fmt
    width = bits // 8
    if not channels or not width:
        raise ValueError(f"{channels} channels of {bits} bits")
    body = body[: len(body) // (width * channels) * width * channels]
    if kind == 3:
        x = np.frombuffer(body, f"<f{width}").astype(float)
    elif bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(body, f"<i{width}") / float(1 << (bits - 1))
    x = x.reshape(-1, channels)
    return rate, np.repeat(x, 2, axis=1) if channels == 1 else x[:, :2]


def read_wav(table: DataFrame, chunk: int = 1 << 16, errors: bool = False) -> DataFrame:
    """SAMPLES with path and rate from wave files, in chunks. ``errors``: a column of that name too, and a row for each file that
    can't be read, which else gives none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rate, x = parse_wav(bytes(data or b""))
                except (ValueError, TypeError, struct.error) as e:
                    if errors:
                        yield pd.DataFrame({"path": [path], "rate": pd.array([None], "Int32"), "n": pd.array([None], "Int64"), "frame": pd.array([None], "Int64"), "l": [None], "r": [None], "error": [str(e)]})
                    continue
                for lo in range(0, len(x), chunk):
                    part = x[lo : lo + chunk]
                    yield pd.DataFrame({"path": path, "rate": rate, "n": len(x), "frame": np.arange(lo, lo + len(part)), "l": part[:, 0], "r": part[:, 1]} | ({"error": None} if errors else {}))

    return table.select("path", "content").mapInPandas(run, "path string, rate int, n long, frame long, l double, r double" + (", error string" if errors else ""))


def encode_wav(x: np.ndarray, rate: int) -> bytes:
    """16-bit stereo PCM of samples in [-1, 1]; others are clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.floor(x * 32768 + 0.5), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def ogg_pages(data: bytes) -> Iterator[tuple[int, int, int, bool]]:
    """Offset, granule, sequence number and whether the checksum holds, of every page."""
    at = data.find(b"OggS")
    while 0 <= at and at + 27 <= len(data):
        n = data[at + 26]
        end = at + 27 + n + sum(data[at + 27 : at + 27 + n])
        if end > len(data):
            return
        granule, _, seq, crc = struct.unpack_from("<qIII", data, at + 6)
        yield at, granule, seq, crc == ogg_crc(data[at:end])
        at = data.find(b"OggS", end)


def adts_frames(data: bytes) -> Iterator[tuple[int, int]]:
    """Offset and first sample (1024 a frame) of every ADTS frame, an ID3v2 tag skipped."""
    at, sample = 0, 0
    if data[:3] == b"ID3" and len(data) >= 10:
        at = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9])
    while at + 7 <= len(data) and data[at] == 0xFF and data[at + 1] & 0xF6 == 0xF0:
        size = (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
        if size < 7 or at + size > len(data):
            return
        yield at, sample
        at, sample = at + size, sample + 1024


#: Elements that hold others, and those that stand right below a segment or at the top.
MASTERS = frozenset({0x1A45DFA3, 0x18538067, 0x1F43B675, 0x1C53BB6B, 0x1654AE6B, 0xAE, 0xBB, 0xB7, 0x1549A966})
IN_SEGMENT = frozenset({0x114D9B74, 0x1549A966, 0x1F43B675, 0x1654AE6B, 0x1C53BB6B, 0x1941A469, 0x1043A770, 0x1254C367})
AT_TOP = frozenset({0x1A45DFA3, 0x18538067})


def ebml_elements(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """Offset, id, payload size and depth of every EBML element, master elements walked into.

    An element of unknown size ends where one begins that can't be in it: a segment at the next top one, others at the next
    of a segment's own. Its payload size is what is left of the element around it.
    """
    at, open_ = 0, []  # id, end, whether the end is known
    while at < len(data):
        while open_ and at >= open_[-1][1]:
            open_.pop()
        n = 9 - data[at].bit_length() if data[at] else 9
        body = at + n
        if n > 4 or body >= len(data):
            return
        ident = int.from_bytes(data[at:body])
        while open_ and not open_[-1][2] and ident in (AT_TOP if open_[-1][0] == 0x18538067 else AT_TOP | IN_SEGMENT):
            open_.pop()
        hi = open_[-1][1] if open_ else len(data)
        m = 9 - data[body].bit_length() if data[body] else 9
        if m > 8 or body + m > hi:
            return
        size = int.from_bytes(data[body : body + m]) & ((1 << 7 * m) - 1)
        known = size != (1 << 7 * m) - 1
        end = body + m + size if known else hi
        yield at, ident, end - body - m, len(open_)
        if ident in MASTERS:
            open_.append((ident, min(hi, end), known))
            at = body + m
        else:
            at = end


def index(table: DataFrame, kind: str) -> DataFrame:
    """Seek index of container files: path, offset, position (granule, first sample or element id), one row for each page, frame or element."""
    walk = {"ogg": lambda d: ((o, g) for o, g, _, ok in ogg_pages(d) if ok), "aac": adts_frames, "webm": lambda d: ((o, i) for o, i, _, _ in ebml_elements(d))}[kind]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = list(walk(bytes(data)))
                if rows:
                    yield pd.DataFrame({"path": path, "offset": [r[0] for r in rows], "position": [r[1] for r in rows]})

    return table.select("path", "content").mapInPandas(run, "path string, offset long, position long")
