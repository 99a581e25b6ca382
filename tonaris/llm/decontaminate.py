"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised: A-Z lower-cased, runs of other ASCII characters than letters and digits
become one space; all other bytes stay. An item of L bytes has a budget of k errors (``errors`` of its length)
and is split into k + 1 pieces. If the item occurs in a text with at most k edits, at least one piece occurs
unchanged; so exact piece hits (hashed windows at every byte of the text, then compared) name the places at
which Myers' bit-parallel distance decides. A long text is read in parts that overlap by the longest item and its errors.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tonaris.llm.common import CHUNK_BYTES, RangeHash, aside, map_arrow, materialise, pick, slices, texts_of

#: Error budget as a share of the item's length.
ERRORS = 0.05
#: Bytes of test items that one pass over the texts looks for; larger benchmarks take several passes.
SHARD_BYTES = 8 << 20
#: Bytes of normalised text whose windows are hashed at a time.
WINDOW = 4 << 20
#: Widths of the windows that find pieces; an item of any length matches anywhere in a text, inside words as well.
_WIDTHS = (16, 8, 4, 2, 1)
_FOLD = np.full(256, 32, np.uint8)
for _lo, _hi, _to in ((48, 58, 48), (97, 123, 97), (65, 91, 97), (128, 256, 128)):
    _FOLD[_lo:_hi] = np.arange(_to, _to + _hi - _lo)


def normalise(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All normalised texts in one buffer, each between zero bytes, and the offset at which each begins (one more: the end)."""
    raw = np.frombuffer(b"\x00" + b"\x00".join(t.replace(b"\x00", b" ") for t in texts) + b"\x00", np.uint8)
    data = _FOLD[raw]
    edge = raw == 0
    data[edge] = 0
    blank = data == 32
    quiet = blank | edge
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & quiet[:-1])  # no space after a space or at the start
    data = data[keep]
    at = np.flatnonzero(data == 0)
    trailing = at[1:][data[at[1:] - 1] == 32] - 1
    if len(trailing):
        data = np.delete(data, trailing)
        at = np.flatnonzero(data == 0)
    return data, np.concatenate([at[:-1] + 1, [at[-1] + 1]])


def normalised_parts(text: bytes, size: int) -> Iterator[bytes]:
    """The normalised text in parts, from ``size`` bytes of the text each; a space at the end of one is held until something follows."""
    pending, quiet = False, True
    for lo in range(0, len(text), size):
        data = _FOLD[np.frombuffer(text, np.uint8, min(size, len(text) - lo), lo)]
        blank = data == 32
        keep = np.ones(len(data), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        keep[0] = not (blank[0] and quiet)
        part = data[keep].tobytes()
        if not part:
            continue
        part = b" " + part if pending else part
        pending = part.endswith(b" ")
        quiet = pending
        yield part[:-1] if pending else part


def budget(length: int, errors: float) -> int:
    """Errors allowed in an item: a share of its length, with pieces of at least 4 bytes."""
    return max(0, min(int(length * errors), length // 4 - 1))


def myers(pattern: bytes, text: bytes) -> int:
    """Smallest edit distance of ``pattern`` to any substring of ``text``, bit-parallel over the pattern."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(xh | plus)), plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(xv | up)), up & xv
        best = min(best, score)
    return best


class Matcher:
    """Pieces of a set of items, hashed by their first bytes."""

    def __init__(self, items: list[tuple[object, bytes]], errors: float = ERRORS):
        self.items = []
        heads: dict[int, list[tuple[bytes, int, int]]] = {}
        for item_id, text in items:
            data, _ = normalise([text])
            body = data[1:-1].tobytes()
            if not body:
                continue
            k = budget(len(body), errors)
            n = len(self.items)
            self.items.append((item_id, body, k))
            cuts = [i * len(body) // (k + 1) for i in range(k + 2)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                width = next(w for w in _WIDTHS if w <= hi - lo)
                heads.setdefault(width, []).append((body[lo:hi], n, lo))
        #: Bytes that the place of a hit and what surrounds it take at most.
        self.reach = max((len(body) + 2 * k for _, body, k in self.items), default=1)
        self.by_width = {}
        for width, pieces in heads.items():
            one = np.frombuffer(b"".join(p[:width] for p, _, _ in pieces), np.uint8)
            starts = np.arange(len(pieces)) * width
            h = RangeHash(one).of(starts, starts + width)
            order = np.argsort(h, kind="stable")
            filter_ = np.zeros(1 << 20, bool)
            filter_[(h >> np.uint64(44)).astype(np.int64)] = True
            self.by_width[width] = (h[order], [pieces[i] for i in order], filter_)

    def find(self, texts: list[bytes]) -> list[dict[int, int]]:
        """For each text, item_id -> edit distance of the items that occur in it within their budgets."""
        if not self.by_width:
            return [{} for _ in texts]
        if len(texts) != 1 or len(texts[0]) <= CHUNK_BYTES:
            return self._find(*normalise(texts))
        best: dict[int, int] = {}
        carried = b""
        for part in normalised_parts(texts[0], CHUNK_BYTES):
            whole = carried + part
            for item_id, d in self._find(np.frombuffer(b"\x00" + whole + b"\x00", np.uint8), np.array([1, len(whole) + 2]))[0].items():
                best[item_id] = min(d, best.get(item_id, d))
            carried = whole[-self.reach :]
        return [best]

    def _find(self, data: np.ndarray, at: np.ndarray) -> list[dict[int, int]]:
        """``find`` in normalised texts as ``normalise`` returns them."""
        found: list[dict[int, int]] = [{} for _ in at[1:]]
        raw = data.tobytes()
        tried: set[tuple[int, int, int]] = set()
        for begin in range(0, len(data), WINDOW):
            ranges = RangeHash(data[begin : begin + WINDOW + _WIDTHS[0]])
            for width, (hashes, pieces, filter_) in self.by_width.items():
                starts = np.arange(max(0, min(WINDOW, len(data) - begin - width + 1)))
                h = ranges.of(starts, starts + width)
                likely = np.flatnonzero(filter_[(h >> np.uint64(44)).astype(np.int64)])
                lo = np.searchsorted(hashes, h[likely], "left")
                hi = np.searchsorted(hashes, h[likely], "right")
                some = hi > lo
                for p, a, b in zip((likely[some] + begin).tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
                    for piece, n, offset in pieces[a:b]:
                        if raw.startswith(piece, p):
                            self._verify(raw, at, p, n, offset, found, tried)
        return found

    def _verify(self, raw: bytes, at: np.ndarray, p: int, n: int, offset: int, found: list[dict[int, int]], tried: set) -> None:
        item_id, body, k = self.items[n]
        doc = int(np.searchsorted(at, p, "right")) - 1
        if found[doc].get(item_id) == 0:
            return
        start = p - offset
        if (key := (doc, n, start)) in tried:
            return
        tried.add(key)
        lo, hi = max(int(at[doc]), start - k), min(int(at[doc + 1]) - 1, start + len(body) + k)
        window = raw[lo:hi]
        d = 0 if body in window else myers(body, window)
        if d <= k:
            found[doc][item_id] = min(d, found[doc].get(item_id, d))


def _shards(benchmark: DataFrame) -> Iterator[list[tuple[object, bytes]]]:
    """Items (item_id, text) in shards of bounded size, one at a time on the driver."""
    shard, size = [], 0
    for row in benchmark.filter("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        text = row["text"].encode()
        if shard and size + len(text) > SHARD_BYTES:
            yield shard
            shard, size = [], 0
        shard.append((row["item_id"], text))
        size += len(text)
    if shard:
        yield shard


def find_leaks(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """All columns of ``docs``, ``items`` (item_ids found in the text, sorted, null last), ``distance`` (the smallest edit distance, else null) and ``contaminated``.

    Columns of these names, in any case, are replaced. Null and empty texts and items never match; items that differ only in
    normalisation match alike. Benchmark: (item_id, text), ids of any type. Items travel to the texts in shards of at most
    ``SHARD_BYTES``, of which the driver holds two at most. One shard is one pass over the texts; with more, each pass
    writes what it found to the shared folder, and ``docs`` must give its rows in the same order when it is read again.
    """
    taken = {"items", "distance", "contaminated"}
    names, inner = [c for c in docs.columns if c.lower() not in taken], aside(docs, "text")
    inner = inner.select([i for i, c in zip(inner.columns, docs.columns, strict=True) if c.lower() not in taken])
    known = pick(benchmark, "item_id", "text")
    kind, shards = known.schema["item_id"].dataType, _shards(known)
    first, second = next(shards, []), next(shards, None)
    if second is None:
        found = _search(inner, Matcher(first, errors), kind)
    else:
        rows, parts = inner.withColumn("_row", F.monotonically_increasing_id()), None
        for shard in itertools.chain([first, second], shards):
            hits = _search(rows.select("_row", "text"), Matcher(shard, errors), kind).filter(F.size("items") > 0).select("_row", "items", "distance")
            hits = materialise(hits, "hits")
            parts = hits if parts is None else parts.union(hits)
        whole = parts.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.min("distance").alias("distance"))
        found = rows.join(whole, "_row", "left").drop("_row").withColumn("items", F.coalesce("items", F.array().cast(f"array<{kind.simpleString()}>")))
    return found.withColumn("contaminated", F.size("items") > 0).toDF(*names, "items", "distance", "contaminated")


def _search(docs: DataFrame, matcher: Matcher, kind: DataType) -> DataFrame:
    """``docs`` with items and distance of one pass."""
    names, arrow = docs.columns, to_arrow_type(kind)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, hits = texts_of(b.column(names.index("text"))), []
        for lo, hi in slices(texts):
            hits += matcher.find(texts[lo:hi])
        items = [sorted(hit, key=lambda i: (i is None, i)) for hit in hits]
        best = [min(hit.values(), default=None) for hit in hits]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(items, pa.list_(arrow)), pa.array(best, pa.int32())], [*names, "items", "distance"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, run, f"{schema}, items array<{kind.simpleString()}>, distance int")


def decontaminate(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS) -> DataFrame:
    """Rows of ``docs`` in whose text no item of the benchmark occurs within its error budget; all columns stay as they are, whatever their names."""
    inner = aside(docs, "text")
    return find_leaks(inner, benchmark, errors).filter("NOT contaminated").select(inner.columns).toDF(*docs.columns)
