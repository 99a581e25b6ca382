"""Scalar functions for display, bytes, lacing and parameter maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of bars.
FULL, EMPTY = "█", "░"


def percent(part: Column, whole: Column) -> Column:
    """Whole percent within [0, 100]; 0 if the whole is unknown."""
    p = F.floor(part / whole * 100 + 0.5)
    return F.when(whole.isNull() | (whole <= 0), 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), p))).cast("int")


def duration_label(seconds: Column, clock: Column) -> Column:
    """A clock, or --:-- if the time is unknown."""
    return F.when(seconds.isNull() | (seconds <= 0), "--:--").otherwise(clock)


def state_name(state: Column) -> Column:
    return F.when(state.isin("playing", "paused", "stopped"), state).otherwise("idle")


def display_name(title: Column, path: Column) -> Column:
    """The title, else the path's last part."""
    return F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)/*$", 1))


def clip(text: Column, width: int) -> Column:
    """At most ``width`` characters, the last one an ellipsis if some are cut."""
    if width <= 0:
        return F.lit("")
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, width - 1), F.lit("…")))


def bar(share: Column, width: int) -> Column:
    """A bar of ``width`` cells filled to a share in [0, 1]."""
    n = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * width + 0.5).cast("int")
    return F.concat(F.repeat(F.lit(FULL), n), F.repeat(F.lit(EMPTY), F.lit(width) - n))


def meter_bar(level: Column, width: int) -> Column:
    """A bar filled to the root of a level, so that quiet passages show."""
    return bar(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), level))), width)


def _byte(data: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, 1)), 16, 10).cast("long")


def little_endian(data: Column, at: int, size: int) -> Column:
    """Unsigned little-endian number of ``size`` bytes (1 to 7) at an offset of a binary column; null if the bytes are not there."""
    out = None
    for k in range(size):
        part = F.shiftleft(_byte(data, at + k), 8 * k)
        out = part if out is None else out + part
    return F.when(F.octet_length(data) >= at + size, out)


def signed(value: Column, bits: int) -> Column:
    """Two's complement of an unsigned number of so many bits."""
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def synchsafe(data: Column, at: int) -> Column:
    """Size of 28 bits in the low seven of four bytes."""
    out = None
    for k in range(4):
        part = F.shiftleft(_byte(data, at + k).bitwiseAND(F.lit(127)), 7 * (3 - k))
        out = part if out is None else out + part
    return out


def laced_sizes(table: Column) -> Column:
    """Packet sizes from a page's segment table (array of 0 to 255): a packet ends at a segment below 255; what is open at the end has no size."""
    start = F.struct(F.array().cast("array<int>").alias("sizes"), F.lit(0).alias("open"))
    step = lambda s, x: F.when(x == 255, F.struct(s["sizes"].alias("sizes"), (s["open"] + 255).alias("open"))).otherwise(F.struct(F.concat(s["sizes"], F.array(s["open"] + x)).alias("sizes"), F.lit(0).alias("open")))
    return F.aggregate(table, start, step, lambda s: s["sizes"])


def with_defaults(given: Column, defaults: dict[str, str]) -> Column:
    """A map of parameters with defaults for what it lacks; keys that are no parameter go."""
    known = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    own = F.map_filter(F.coalesce(given, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*defaults) & v.isNotNull())
    return F.map_concat(F.map_filter(known, lambda k, v: ~F.map_contains_key(own, k)), own)


def canonical_frames(total: Column, rate: Column, to: int = 48_000) -> Column:
    """Frames at ``to`` that so many samples at a rate are, if that is a whole number; else null (unknown)."""
    scaled = total * to
    return F.when((rate <= 0) | (total <= 0), None).when(rate == to, total).when(scaled % rate == 0, F.floor(scaled / rate).cast("long"))


def source_samples(frame: Column, rate: Column, of: int = 48_000) -> Column:
    """The sample at a rate in which a frame at ``of`` begins."""
    return F.floor((frame * rate - (frame * rate) % of) / of).cast("long")
