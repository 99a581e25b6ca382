"""Scalar functions: packet timing, clocks, durations, checksums."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def packet_samples(toc: Column, second: Column) -> Column:
    """Samples at 48 kHz of an Opus packet from its first two bytes as integers (null: missing); -1 if it can't be timed."""
    config = F.shiftright(toc, 3).bitwiseAND(F.lit(31))
    size = config.bitwiseAND(F.lit(3))
    per = (
        F.when(config >= 16, F.element_at(F.array(*map(F.lit, (120, 240, 480, 960))), size + 1))
        .when(config >= 12, F.when(config.bitwiseAND(F.lit(1)) == 1, 960).otherwise(480))
        .otherwise(F.element_at(F.array(*map(F.lit, (480, 960, 1920, 2880))), size + 1))
    )
    code = toc.bitwiseAND(F.lit(3))
    total = per * F.when(code == 0, 1).when(code < 3, 2).otherwise(second.bitwiseAND(F.lit(63)))
    return F.when(toc.isNull() | total.isNull() | (total <= 0) | (total > 5760), -1).otherwise(total).cast("int")


def clock(seconds: Column) -> Column:
    """m:ss or h:mm:ss; a null or negative time is --:--."""
    s = F.floor(seconds).cast("long")
    h, m = F.expr("1") * F.floor(s / 3600), F.floor(s / 60) % 60
    short = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    long = F.concat(h.cast("long").cast("string"), F.lit(":"), F.lpad(m.cast("long").cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    return F.when(seconds.isNull() | (seconds < 0), "--:--").when(s >= 3600, long).otherwise(short)


def duration_ns(total_frames: Column, source_samples: Column, source_rate: Column) -> Column:
    """Nanoseconds from the source's own samples if its rate is known, else from 48 kHz frames, else 0; whole numbers only."""
    billion = F.lit(1_000_000_000).cast("decimal(38,0)")
    from_source = (source_samples.cast("decimal(19,0)") * billion / source_rate).cast("decimal(38,6)")
    from_frames = (total_frames.cast("decimal(19,0)") * billion / F.lit(48_000)).cast("decimal(38,6)")
    return F.floor(F.when((source_samples > 0) & (source_rate > 0), from_source).when(total_frames > 0, from_frames).otherwise(F.lit(0).cast("decimal(38,6)"))).cast("long")


@functools.cache
def _crc_steps() -> tuple[int, ...]:
    """What eight shifts make of each leading byte."""
    out = []
    for b in range(256):
        crc = b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        out.append(crc)
    return tuple(out)


def ogg_crc(page: bytes) -> int:
    """CRC-32 of an Ogg page (polynomial 04c11db7, not reflected), its checksum field counted as zero."""
    crc, steps = 0, _crc_steps()
    for b in page[:22] + b"\0\0\0\0" + page[26:]:
        crc = (crc << 8 & 0xFFFFFFFF) ^ steps[crc >> 24 ^ b]
    return crc


def fnv1a(data: bytes) -> int:
    """64-bit FNV-1a."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h
