"""Shared helpers: durable intermediate tables, Arrow maps, a vectorised byte tokeniser.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``; only A-Z are lower-cased. A word's
identity in the numpy code is a 64-bit polynomial hash of its bytes.
"""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_RE = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a local one in local mode, else an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = sc._jsc.sc().getCheckpointDir()
        if not where.isDefined() and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = where.get() if where.isDefined() else tempfile.mkdtemp(prefix="tonaris-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def materialise(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files every executor can read.

    ``instead_of`` is an earlier such table that nobody reads after this one is written; its files go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tonaris/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).deleteOnExit(p)
    if instead_of is not None:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(instead_of._written_to)
        old.getFileSystem(conf).delete(old, True)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _place(columns: list[str], name: str) -> int:
    """Where a column is: by its exact name, else by its name in any case."""
    same = [i for i, c in enumerate(columns) if c == name] or [i for i, c in enumerate(columns) if c.lower() == name.lower()]
    if not same:
        raise ValueError(f"no column {name} among {columns}")
    return same[0]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """These columns only; others may have the same names in another case."""
    at = [_place(df.columns, n) for n in names]
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names, strict=True)])


def aside(df: DataFrame, *needed: str) -> DataFrame:
    """``df`` with its columns in place, the needed ones by these names and all others by names that clash with nothing."""
    at = {_place(df.columns, n): n for n in needed}
    return df.toDF(*[at.get(i, f"_own{i}") for i in range(len(df.columns))])


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one RecordBatch to one RecordBatch or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def unit_hash(*cols: str | Column, seed: int = 0) -> Column:
    """A reproducible number in [0, 1) for each row."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def word_count(text: Column) -> Column:
    """Number of words: each word becomes one x, white space goes."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD_RE, "x"), WHITE, "")).cast("long")


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is the empty text."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive runs of whole texts of about ``size`` bytes."""
    lo = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes, cut behind white space, so that no word is cut and nothing is lost."""
    lo = 0
    while len(text) - lo > size:
        gap = _GAP.search(text, lo + size)
        if gap is None:
            break
        yield text[lo : gap.end()]
        lo = gap.end()
    yield text[lo:] if lo else text


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32
_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    back = pow(_MULT, -1, 1 << 64)
    both = []
    for m in (_MULT, back):
        p = np.full(n, m, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    return both[0], both[1]


class RangeHash:
    """Hash of any byte range of a buffer from prefix sums of a polynomial modulo 2^64."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(20, int(len(data)).bit_length())
        up, self._down = _powers(size)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64, out=self._sum[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sum[ends] - self._sum[starts]) * self._down[starts])


class Tokens:
    """Words of several texts: byte ranges in ``data`` and, for each text, its first word and count."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.data = _TO_LOWER[raw] if lower else raw
        white = np.ones(len(raw) + 1, bool)
        white[1:] = _IS_WHITE[raw]
        flips = np.flatnonzero(white[1:] != white[:-1])
        self.starts, self.ends = flips[0::2], flips[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_starts = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.searchsorted(self.starts, self.text_starts)
        self.first, self.count = bounds[:-1], np.diff(bounds)

    def hashes(self) -> np.ndarray:
        return RangeHash(self.data).of(self.starts, self.ends)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and how many each text has; long texts are read in pieces."""
    found, count = [], []
    for lo, hi in slices(texts):
        if hi - lo == 1:
            own = [Tokens([p]).hashes() for p in pieces(texts[lo])]
            found += own
            count.append(np.array([sum(map(len, own))]))
        else:
            t = Tokens(texts[lo:hi])
            found.append(t.hashes())
            count.append(t.count)
    return np.concatenate(found or [np.zeros(0, np.uint64)]), np.concatenate(count or [np.zeros(0, np.int64)])


def segment_sum(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs, empty runs being 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[first + count] - total[first]
