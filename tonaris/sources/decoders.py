"""Decoders as a registry: by extension, by content, by name; files and table functions that use it."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tonaris.sources.containers import ogg_packets, probe
from tonaris.sources.files import adts_frames, ebml_elements, files, parse_wav, sniff

#: Bytes at a file's start that a decoder may look at.
HEADER = 4096


@dataclass(frozen=True)
class Decoder:
    """``match`` tells whether it claims a header; ``open`` gives rate and (frames, 2) samples, or is None if only the header is read."""

    name: str
    extensions: tuple[str, ...]
    weight: int
    match: Callable[[bytes], bool]
    open: Callable[[bytes], tuple[int, np.ndarray]] | None = None


@dataclass
class Decoders:
    """The highest weight wins, ties go to the last registered; of two of one name the last counts."""

    rows: list[Decoder] = field(default_factory=list)

    def _best(self, fits: Callable[[Decoder], bool]) -> Decoder | None:
        found = [(d.weight, i, d) for i, d in enumerate(self.rows) if fits(d)]
        return max(found, key=lambda x: x[:2])[2] if found else None

    def by_name(self, name: str) -> Decoder:
        found = [d for d in self.rows if d.name == name]
        if not found:
            raise ValueError(f"unknown codec {name!r} (available: {', '.join(sorted(d.name for d in self.rows))})")
        return found[-1]

    def by_content(self, header: bytes) -> Decoder | None:
        return self._best(lambda d: d.match(header))

    def of(self, path: str, header: bytes) -> Decoder:
        """The extension's decoder unless another one claims the content; else the one that claims it."""
        dot = path.rsplit("/", 1)[-1].rfind(".")
        ext = path.rsplit("/", 1)[-1][dot:].lower() if dot >= 0 else ""
        named, claimed = self._best(lambda d: ext in d.extensions), self.by_content(header)
        chosen = named if named and claimed in (None, named) else claimed
        if chosen is None:
            raise ValueError(f"no decoder for {path}")
        return chosen


def _starts(*magic: bytes) -> Callable[[bytes], bool]:
    return lambda h: h.startswith(magic)


#: Decoders that read samples here, and those of which only headers are read.
DEFAULT = Decoders([
    Decoder("opus", (".opus", ".ogg"), 90, _starts(b"OggS")), Decoder("flac", (".flac",), 90, _starts(b"fLaC")),
    Decoder("wav", (".wav",), 90, lambda h: h[:4] in (b"RIFF", b"RF64", b"BW64") and h[8:12] == b"WAVE", parse_wav),
    Decoder("mp3", (".mp3",), 90, lambda h: h[:3] == b"ID3" or len(h) > 1 and h[0] == 255 and h[1] & 0xE6 == 0xE2), Decoder("m4a", (".m4a", ".mp4"), 90, lambda h: h[4:8] == b"ftyp"),
    Decoder("aac", (".aac",), 90, lambda h: len(h) > 1 and h[0] == 255 and h[1] & 0xF6 == 0xF0), Decoder("webm-opus", (".webm", ".weba"), 90, _starts(b"\x1a\x45\xdf\xa3")),
])


def decode(table: DataFrame, decoders: Decoders = DEFAULT, name: str = "", chunk: int = 1 << 16) -> DataFrame:
    """SAMPLES with path, codec and rate of files (path, content), each by the decoder that its name and content ask for, or by a named one.

    A file that can't be read has one row with an ``error``. An unknown name fails before any file is read.
    """
    if name:
        decoders.by_name(name)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                codec = None
                try:
                    data = bytes(data if data is not None else b"")
                    d = decoders.by_name(name) if name else decoders.of(path, data[:HEADER])
                    codec = d.name
                    if d.open is None:
                        raise ValueError(f"{codec} is not decoded here")
                    rate, x = d.open(data)
                except (ValueError, TypeError, IndexError, struct.error) as e:
                    none = pd.array([None], "Int64")
                    yield pd.DataFrame({"path": [path], "codec": [codec], "rate": none, "frame": none, "l": [None], "r": [None], "error": [str(e)]})
                    continue
                for lo in range(0, len(x), chunk):
                    part = x[lo : lo + chunk]
                    yield pd.DataFrame({"path": path, "codec": codec, "rate": rate, "frame": np.arange(lo, lo + len(part)), "l": part[:, 0], "r": part[:, 1], "error": None})

    return table.select("path", "content").mapInPandas(run, "path string, codec string, rate long, frame long, l double, r double, error string")


def kernels_of(table: DataFrame) -> DataFrame:
    """KERNELS (name, tap, l, r) of wave files: a file's base name without its extension, one row for each frame."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return decode(table, name="wav").filter("error IS NULL").select(name.alias("name"), F.col("frame").alias("tap"), "l", "r")


def probe_files(table: DataFrame) -> DataFrame:
    """What the headers of files (path, content) tell, the kind taken from their content; other kinds come back with an error."""
    return probe(table.withColumn("kind", F.coalesce(sniff(F.col("content")), F.lit("none"))))


def scan(spark: SparkSession, folders: list[str], single: list[str], extensions: list[str]) -> DataFrame:
    """``pos, path`` of a queue: single files first, as given and whatever their extension, then the files below folders that have one of the extensions (in any case), by path; repeats go."""
    given = spark.createDataFrame([(0, i, p) for i, p in enumerate(single)], "part int, at int, path string")
    found = None
    for i, folder in enumerate(folders):
        one = files(spark, folder).select(F.lit(i + 1).alias("part"), F.lit(0).alias("at"), F.regexp_replace("path", "^file:", "").alias("path"))
        found = one if found is None else found.unionByName(one)
    if found is not None:
        ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
        given = given.unionByName(found.filter(ext.isin(*[e.lower() for e in extensions])))
    clean = F.regexp_replace(F.regexp_replace("path", r"/(\./)+", "/"), "//+", "/")
    first = given.withColumn("_clean", clean).groupBy("_clean").agg(F.min(F.struct("part", "at", "path")).alias("_f")).select("_f.*")
    ordered = first.orderBy("part", "at", "path").select("path")
    return ordered.select((F.monotonically_increasing_id()).alias("pos"), "path")


def register_functions(spark: SparkSession) -> None:
    """Table functions over a binary column for SQL: ogg_packets, adts_frames and ebml_elements."""

    @udtf(returnType="serial long, page long, granule long, size long")
    class Packets:
        def eval(self, content: bytes):
            yield from ((serial, seq, granule, len(p)) for serial, seq, granule, p in ogg_packets(bytes(content or b"")))

    @udtf(returnType="offset long, sample long")
    class Frames:
        def eval(self, content: bytes):
            yield from adts_frames(bytes(content or b""))

    @udtf(returnType="offset long, id long, size long, depth int")
    class Elements:
        def eval(self, content: bytes):
            yield from ebml_elements(bytes(content or b""))

    for name, f in (("ogg_packets", Packets), ("adts_frames", Frames), ("ebml_elements", Elements)):
        spark.udtf.register(name, f)
