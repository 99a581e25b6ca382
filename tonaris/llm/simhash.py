"""SimHash near-dedup by tiled exact comparison.

Fingerprints are compared in blocks with numpy exclusive-or and bit counts. Tiles are keyed by the
population counts of a fingerprint's segments: two fingerprints within a radius have counts whose
differences add up to at most that radius, so tile pairs beyond it are skipped without loss. The number
of segments follows from the number of distinct fingerprints, so that tiles keep their size as the
input grows. Equal fingerprints are one node, and a comparison of two blocks returns a spanning forest of
its links, so a group of copies never turns into all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonaris.llm.common import aside, map_arrow, materialise, mix, pick, pieces, texts_of, word_hashes
from tonaris.llm.components import connected_components, join_components
from tonaris.llm.tiles import Forest, pack, pairs

SEED = 42
#: Fingerprints in a block, and the mean number of them in a tile that is aimed at.
BLOCK = 2048
#: Min-hashes in a bucket key, and the chance that two sets at the threshold share no bucket.
GRIP, MISS = 6, 1e-4
#: Bands of distance in which candidates are verified.
BANDS = 2
#: 64-bit words of the fingerprints that decide on near-duplicate candidates.
LONG = 64
#: Pairs in which one text has at most this many distinct shingles are compared by their sets instead.
SHORT = 64
#: For longer texts, by how much the rate of differing bits is at most above ``radius_for``'s, as an even number of shingles has ties.
TIES = 0.003
_STRIDE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Shingles of ``width`` of these words, repeats included; fewer words: the whole sequence; none: no shingle."""
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [joined]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[s:e] for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, piece by piece; the last words of a piece go before the next."""
    words, begun = [], False
    for piece in pieces(text):
        words += piece.translate(_LOWER).split()
        if len(words) >= width:
            begun = True
            yield _hashed(shingles(words, width))
            words = words[len(words) - width + 1 :]
    if not begun:
        yield _hashed(shingles(words, width))


def _hashed(parts: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), np.uint64, len(parts))


def fingerprint(text: bytes, width: int = 3, words: int = 1) -> list[int]:
    """Fingerprint of the shingles of a text, each as often as it occurs."""
    return majority(hashes(text, width), words)


def majority(parts: Iterable[np.ndarray], words: int) -> list[int]:
    """``words`` 64-bit words from runs of hashes; a bit is 1 if over half the hashes have it. Words after the first mix a hash with
    their number, so fewer words are a prefix of more."""
    step, ones, n = max(1, (1 << 14) // words), np.zeros(64 * words, np.int64), 0
    for first in parts:
        n += len(first)
        for lo in range(0, len(first), step):
            h = np.repeat(first[lo : lo + step, None], words, axis=1)
            h[:, 1:] = mix(h[:, 1:] + np.arange(1, words, dtype=np.uint64) * _STRIDE)
            bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
            for at in range(0, len(bits), 255):  # eight counts of a byte each are added at once
                ones += bits[at : at + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(ones * 2 > n, bitorder="little").view(np.uint64).tolist()


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1) -> DataFrame:
    """All columns of ``docs`` but text, and ``fp`` (array of signed 64-bit words), for every row; null and blank texts have fingerprint zero."""
    own = docs.drop("fp", "text")
    names = own.columns

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[x - (1 << 64) if x >> 63 else x for x in fingerprint(t, width, words)] for t in texts_of(b.column(len(names)))]
        return pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(rows, pa.list_(pa.int64()))], [*names, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return map_arrow(docs.select(*names, "text"), run, f"{schema}, fp array<long>")


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The set of each text's shingles of ``width`` words as sorted 64-bit hashes; fewer words: the whole sequence; none: empty."""
    h, count = word_hashes(texts)
    steps = mix(np.arange(1, width + 1, dtype=np.uint64) * _STRIDE) | np.uint64(1)
    out, at = [], 0
    for n in count.tolist():
        own, at = h[at : at + n], at + n
        few = min(n, width)
        made = sum((own[k : n - few + k + 1] * steps[k] for k in range(1, few)), own[: n - few + 1] * steps[0]) if n else own
        out.append(np.unique(mix(made)))
    return out


class Buckets:
    """Bucket keys of a set: in each of ``bands`` bands, a hash of its smallest elements under ``GRIP`` random orders.

    Sets of Jaccard similarity j share the bucket of a band with probability j to the power of ``GRIP``; the number of bands
    follows from ``MISS``, the chance that two sets at the threshold share none.
    """

    def __init__(self, similarity: float):
        self.bands = max(1, math.ceil(math.log(MISS) / math.log(1 - min(similarity, 1 - 1e-9) ** GRIP)))
        rng = np.random.default_rng(SEED)
        self.times = rng.integers(1 << 31, size=self.bands * GRIP, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.plus = rng.integers(1 << 32, size=self.bands * GRIP, dtype=np.uint32)
        self.join = rng.integers(1 << 62, size=(self.bands, GRIP), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, x: np.ndarray) -> np.ndarray:
        low, small = np.full(len(self.times), 0xFFFFFFFF, np.uint32), (x >> np.uint64(32)).astype(np.uint32)
        for lo in range(0, len(small), 2048):
            np.minimum(low, (small[lo : lo + 2048, None] * self.times + self.plus).min(axis=0), out=low)
        joined = (low.astype(np.uint64).reshape(self.join.shape) * self.join).sum(axis=1, dtype=np.uint64)
        return mix(joined + np.arange(self.bands, dtype=np.uint64) * _STRIDE).view(np.int64)


def _set_prints(width: int, words: int, similarity: float):
    """Arrow function: the columns it gets but text, and of the set of shingles its size ``n``, 128-bit hash ``k1, k2``, fingerprint ``fp`` and buckets ``tiles``."""
    buckets = Buckets(similarity)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts_of(b.column(b.num_columns - 1)), width)
        keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
        fps = [np.array(majority([x], words), np.uint64).view(np.int64) for x in sets]
        tiles = [buckets.keys(x) if len(x) else np.zeros(0, np.int64) for x in sets]
        made = [pa.array([len(x) for x in sets], pa.int32()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(fps, pa.list_(pa.int64())), pa.array(tiles, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], "n", "k1", "k2", "fp", "tiles"])

    return run


def _sets_and_long(width: int):
    """Arrow function from (id, text): id, ``set`` and, for more than ``SHORT`` shingles, ``long``, a fingerprint of ``LONG`` words."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts_of(b.column(1)), width)
        long = [np.array(majority([x], LONG), np.uint64).view(np.int64) if len(x) > SHORT else None for x in sets]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array(long, pa.list_(pa.int64()))], ["id", "set", "long"])

    return run


def _segments(n: int, bits: int, radius: int) -> int:
    """Segments of a fingerprint whose counts key a tile: enough for tiles of about ``BLOCK`` of n fingerprints."""
    if radius > bits // 16:
        return 1
    s = 1
    while s < 16 and n / (2.0 * math.sqrt(bits / s)) ** s > BLOCK:
        s *= 2
    return s


def _tile(words: int, segments: int, grain: int):
    """Tile key: population counts of the segments as digits of a number to base 256 (one digit: the whole, in steps of ``grain``)."""
    if segments == 1:
        return F.floor(sum([F.bit_count(F.col("fp")[k]) for k in range(1, words)], F.bit_count(F.col("fp")[0])) / grain).cast("long")
    key, size = F.lit(0).cast("long"), 64 * words // segments
    for s in range(segments):
        word, at = divmod(s * size, 64)
        part = F.shiftrightunsigned(F.col("fp")[word], at).bitwiseAND(F.lit((1 << size) - 1 if size < 64 else -1))
        key = key * F.lit(1 << (60 // segments)) + F.bit_count(part)
    return key


def _near_tiles(packs: DataFrame, segments: int, radius: int) -> DataFrame:
    """Pairs of tile keys that differ by at most ``radius`` in all."""
    base = 1 << (60 // segments) if segments > 1 else 0
    moves = [(0, 0)]
    for s in range(segments):
        unit = base ** (segments - 1 - s) if segments > 1 else 1
        moves = [(m + d * unit, used + abs(d)) for m, used in moves for d in range(-radius, radius + 1) if used + abs(d) <= radius]
    steps = F.array(*[F.lit(m).cast("long") for m, _ in sorted(set(moves))])
    return packs.select("tile").distinct().select("tile", F.explode(F.transform(steps, lambda d: F.col("tile") + d)).alias("other"))


class _Blocks:
    """Two blocks of a batch of work, or one against itself, as arrays: ids, fingerprints and, if given, components."""

    def __init__(self, b: pa.RecordBatch, r: int):
        self.same, sides = b.column(2)[r].as_py(), [b.column(c)[r].values for c in (0, 1)]
        field = lambda name: [x.field(name).to_numpy(zero_copy_only=False) for x in sides]
        self.ids = field("id")
        self.fps = [x.field("fp").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(x), -1) for x in sides]
        self.component = field("component") if sides[0].type.get_field_index("component") >= 0 else None
        self.every = self.ids[0] if self.same else np.concatenate(self.ids)
        #: What is added to an index into the second block for one into ``every``.
        self.shift = 0 if self.same else len(self.ids[0])

    def near(self, words: int, radius: int):
        """Index pairs at most ``radius`` bits apart over the first ``words`` words, and these distances, a slab at a time.

        Both sides are sorted by population count, and a slab only meets the part whose counts are within the radius of its own.
        """
        x, y = self.fps
        ones = [np.bitwise_count(v[:, :words]).sum(axis=1, dtype=np.int64) for v in (x, y)]
        at, to = (np.argsort(p, kind="stable") for p in ones)
        px, py, x, y = ones[0][at], ones[1][to], x[at], y[to]
        step = max(1, (1 << 19) // max(1, len(y)))
        for lo in range(0, len(x), step):
            hi = min(lo + step, len(x))
            first, last = np.searchsorted(py, px[lo] - radius), np.searchsorted(py, px[hi - 1] + radius, "right")
            d = np.zeros((hi - lo, last - first), np.uint16)
            for k in range(words):
                d += np.bitwise_count(x[lo:hi, k, None] ^ y[None, first:last, k])
            i, j = np.nonzero(d <= radius)
            d, i, j = d[i, j], at[i + lo], to[j + first]
            if self.same:
                once = i < j
                i, j, d = i[once], j[once], d[once]
            yield i, j, d

    def further(self, i: np.ndarray, j: np.ndarray, d: np.ndarray, words: int) -> np.ndarray:
        """Distances over all words from those over the first ``words``."""
        d = d.astype(np.int32)
        for k in range(words, self.fps[0].shape[1]):
            d += np.bitwise_count(self.fps[0][i, k] ^ self.fps[1][j, k])
        return d


def _each(compare):
    """An Arrow function of batches of block pairs from one that appends to lists of ends, a block pair at a time."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        a_of, b_of = [], []
        for r in range(b.num_rows):
            compare(_Blocks(b, r), a_of, b_of)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (a_of, b_of)], ["a", "b"])

    return run


def _put(forest: Forest, every: np.ndarray, a_of: list, b_of: list) -> None:
    i, j = forest.edges()
    a_of.append(every[i])
    b_of.append(every[j])


def _forest(words: int, radius: int):
    """A spanning forest of the links of at most ``radius`` bits."""

    def compare(blocks: _Blocks, a_of: list, b_of: list) -> None:
        forest = Forest(len(blocks.every))
        for i, j, _ in blocks.near(words, radius):
            forest.union(i, j + blocks.shift)
        _put(forest, blocks.every, a_of, b_of)

    return _each(compare)


def _long_tree(words: int, wide: int, radius: int):
    """Pairs that join all that pairs of at most ``radius`` bits over all words do, close ones first, among pairs of at most ``wide`` bits over the first ``words``."""

    def compare(blocks: _Blocks, a_of: list, b_of: list) -> None:
        forest = Forest(len(blocks.every))
        for bound in (radius // 2, radius):
            for i, j, d in blocks.near(words, wide):
                apart = forest.label[i] != forest.label[j + blocks.shift]
                i, j = i[apart], j[apart]
                close = blocks.further(i, j, d[apart], words) <= bound
                i, j = i[close], j[close]
                chosen = forest.tree(i, j + blocks.shift)
                a_of.append(blocks.ids[0][i[chosen]])
                b_of.append(blocks.ids[1][j[chosen]])

    return _each(compare)


def _long_pairs(words: int, wide: int, above: int, radius: int):
    """Every pair of nodes of different components with more than ``above`` and at most ``radius`` bits over all words, and at most ``wide`` over the first ``words``."""

    def compare(blocks: _Blocks, a_of: list, b_of: list) -> None:
        for i, j, d in blocks.near(words, wide):
            apart = blocks.component[0][i] != blocks.component[1][j]
            i, j = i[apart], j[apart]
            d = blocks.further(i, j, d[apart], words)
            unsure = (d > above) & (d <= radius)
            a_of.append(blocks.ids[0][i[unsure]])
            b_of.append(blocks.ids[1][j[unsure]])

    return _each(compare)


def near_pairs(nodes: DataFrame, words: int, radius: int, compare=None, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` that ``compare`` finds in pairs of blocks of distinct fingerprints (id, fp, optionally component); by default
    a spanning forest of each pair's links of at most ``radius`` bits.

    Pairs of tiles in which no two fingerprints are within ``radius`` bits over the first ``words`` words are skipped. If the
    radius is so wide that single counts would hardly rule out any, a tile has a range of counts as wide as it.
    """
    segments = _segments(nodes.count(), 64 * words, radius)
    grain = radius + 1 if radius > 4 * words else 1
    packs = materialise(pack(nodes.withColumn("tile", _tile(words, segments, grain)), "id", nodes.columns, block), "packs")
    work = pairs(packs, _near_tiles(packs, segments, 1 if grain > 1 else radius)).select("a", "b", "same").repartition(max(8, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return map_arrow(work, compare or _forest(words, radius), "a long, b long")


def simhash_groups(docs: DataFrame, width: int = 3, words: int = 1, radius: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: the smallest doc_id reachable over links of at most ``radius`` bits.

    Texts without words (null, empty, blank) have fingerprint zero and link like any other. Null doc_ids keep a row and
    don't count as smallest id of a component unless all its ids are null. Repeated rows stay repeated.
    """
    own = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    prints = materialise(fingerprints(own, width, words), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")).withColumn("id", F.xxhash64("fp") if words > 1 else F.col("fp")[0]), "nodes")
    component = connected_components(near_pairs(nodes.select("id", "fp"), words, radius))
    lows = component.join(nodes.select(F.col("id").alias("node"), "low"), "node")
    low = lows.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = lows.select("node", "component").join(low, "component").select(F.col("node").alias("id"), "component_id")
    found = nodes.join(linked, "id", "left").select(F.col("fp").alias("_fp"), F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("low")).alias("component_id"))
    return prints.join(found, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def radius_for(similarity: float, bits: int, width_sd: float = 0.0) -> int:
    """Bits by which fingerprints of texts with this Jaccard similarity differ, on average plus ``width_sd`` standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + width_sd * math.sqrt(bits * p * (1 - p)))


def _jaccard(least: float):
    """Arrow function: of pairs (a, b, x, y) those (a, b) whose sets x and y are as similar as asked."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(b.num_rows, bool)
        x, y = (b.column(c) for c in (2, 3))
        for r in range(b.num_rows):
            one, two = (c[r].values.to_numpy(zero_copy_only=False) for c in (x, y))
            if min(len(one), len(two)) >= least * max(len(one), len(two)):
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep[r] = common >= least * (len(one) + len(two) - common) - 1e-9
        return pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in b.columns[:2]], ["a", "b"])

    return run


def _verified(unsure: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes whose sets (id, set) are as similar as asked."""
    x, y = (sets.select(F.col("id").alias(end), F.col("set").alias(name)) for end, name in (("a", "_x"), ("b", "_y")))
    both = unsure.join(x, "a").join(y, "b")
    return map_arrow(both.select("a", "b", "_x", "_y"), _jaccard(similarity), "a long, b long")


def _alike_sets(least: float):
    """A spanning forest of the pairs of sets (id, set) in two blocks whose Jaccard similarity is ``least`` or more."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        a_of, b_of = [], []
        for r in range(b.num_rows):
            same, (x, y) = b.column(2)[r].as_py(), [b.column(c)[r].values for c in (0, 1)]
            ids = [s.field("id").to_numpy(zero_copy_only=False) for s in (x, y)]
            sizes = [s.field("set").value_lengths().to_numpy(zero_copy_only=False) for s in (x, y)]
            flat = [s.field("set").flatten().to_numpy(zero_copy_only=False) for s in (x, y)]
            order = np.argsort(flat[1], kind="stable")
            postings, owner = flat[1][order], np.repeat(np.arange(len(ids[1])), sizes[1])[order]
            every, shift = (ids[0], 0) if same else (np.concatenate(ids), len(ids[0]))
            forest = Forest(len(every))
            ends = np.cumsum(sizes[0])
            for i, (lo, hi) in enumerate(zip((ends - sizes[0]).tolist(), ends.tolist(), strict=True)):
                first, last = (np.searchsorted(postings, flat[0][lo:hi], side) for side in ("left", "right"))
                met = np.concatenate([owner[f:t] for f, t in zip(first.tolist(), last.tolist(), strict=True)])
                common = np.bincount(met, minlength=len(ids[1]))
                j = np.flatnonzero((common > 0) & (common >= least * (sizes[0][i] + sizes[1] - common) - 1e-9)) + shift
                forest.union(np.full(len(j), i), j)
            _put(forest, every, a_of, b_of)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (a_of, b_of)], ["a", "b"])

    return run


def _open_pairs(met: DataFrame, component: DataFrame, payload: DataFrame, compare, block: int) -> DataFrame:
    """Links ``a, b`` that ``compare`` finds in buckets (tile, id) whose nodes are not all of one component (node, component).

    ``payload`` has id and an array ``fp`` or ``set`` of the nodes to compare. A component that has over ``block`` rows in a
    bucket gets blocks of its own there, which meet all others but not each other; so a bucket full of copies costs its rows
    times those not yet joined to them.
    """
    what = payload.columns[1]
    labelled = met.join(payload.select("id"), "id").join(component.withColumnRenamed("node", "id"), "id", "left").select("tile", "id", F.coalesce("component", "id").alias("component"))
    some = labelled.groupBy("tile").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo <> _hi").select("tile")
    rows = materialise(labelled.join(some, "tile"), "open")
    piles = rows.groupBy("tile", "component").count().filter(F.col("count") > block).select("tile", "component", F.lit(True).alias("_big"))
    rows = rows.join(piles, ["tile", "component"], "left").withColumn("pile", F.when(F.col("_big"), F.col("component")))
    rows = rows.withColumnsRenamed({"tile": "bucket"}).withColumn("tile", F.xxhash64("bucket", "pile")).join(payload, "id")
    packs = materialise(pack(rows, "id", ["id", "component", what], block, ["bucket", "pile"]), "packs")
    left, right = (packs.select("bucket", F.col("pile").alias(f"_p{k}"), F.col("tile").alias(f"_t{k}"), F.col("block").alias(f"_b{k}")) for k in "ab")
    apart = "(_ta < _tb OR _ta = _tb AND _ba <= _bb) AND NOT (_pa IS NOT NULL AND _pa <=> _pb)"
    work = left.join(right, "bucket").filter(apart).select("_ta", "_ba", "_tb", "_bb")
    for k in "ab":
        work = work.join(packs.select(F.col("tile").alias(f"_t{k}"), F.col("block").alias(f"_b{k}"), F.col("rows").alias(k)), [f"_t{k}", f"_b{k}"])
    work = work.select("a", "b", ((F.col("_ta") == F.col("_tb")) & (F.col("_ba") == F.col("_bb"))).alias("same"))
    work = work.repartition(max(8, int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return map_arrow(work, compare, "a long, b long").distinct()


def near_dedup(docs: DataFrame, width: int = 5, similarity: float = 0.8, words: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id (then smallest text).

    Two texts link if the Jaccard similarity of their sets of ``width``-word shingles is ``similarity`` or more; texts with equal
    sets (by 128-bit hashes) are one node. Nodes are compared within buckets (``Buckets``), first each with the smallest node it
    shares one with, then those of different components, block by block: sets of at most ``SHORT`` shingles with others exactly,
    longer ones by fingerprints of ``LONG`` words, whose radius pairs at the threshold exceed with a chance of about 0.05 %.
    Every link is verified on the sets unless verified links join it already: first those that would join all close
    nodes, then the others in bands of rising distance. Texts without words are a group of their own. Null doc_ids come
    last in the choice of the row that stays. All columns stay, whatever their names. ``docs`` must give its rows in the
    same order when it is read again, as stored tables do.
    """
    wide, high = (radius_for(similarity, 64 * w, 3.3) + math.ceil(64 * w * TIES) for w in (words, LONG))
    low, few = radius_for(similarity, 64 * LONG, -2.6), math.floor(SHORT / similarity + 1e-9)
    rows = aside(docs, "doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    ids = rows.select("_row", F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"), "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ids.drop("text").schema)
    prints = materialise(map_arrow(ids, _set_prints(width, words, similarity), f"{kinds}, n int, k1 long, k2 long, fp array<long>, tiles array<long>"), "fingerprints")
    first = F.struct(F.col("_doc").isNull(), F.col("_doc"), F.col("_text"), F.col("_row"))
    nodes = prints.groupBy("k1", "k2", "n").agg(F.min(first).alias("first"), F.any_value("fp").alias("fp"), F.any_value("tiles").alias("tiles"))
    nodes = materialise(nodes.select(F.monotonically_increasing_id().alias("id"), "n", "first", "fp", "tiles"), "nodes")
    slots = nodes.select("id", F.explode("tiles").alias("tile"))
    shared = slots.groupBy("tile").agg(F.min("id").alias("least"), F.count("*").alias("_n")).filter("_n > 1").select("tile", "least")
    met = materialise(slots.join(shared, "tile"), "met")
    some = met.groupBy("id").agg(F.min("least").alias("least"))
    texts = rows.select("_row", "text").join(nodes.select("id", F.col("first._row").alias("_row")).join(some, "id"), "_row").select("id", "text")
    sets = materialise(map_arrow(texts, _sets_and_long(width), "id long, set array<long>, long array<long>"), "sets")
    component = materialise(connected_components(_verified(_likely(some, nodes, wide), sets, similarity)), "components")
    met = met.select("tile", "id")
    short = _open_pairs(met, component, sets.filter(F.size("set") <= few).select("id", "set"), _alike_sets(similarity), BLOCK)
    component = join_components(component, short)
    long = sets.filter("long IS NOT NULL").select("id", F.col("long").alias("fp"))
    component = join_components(component, _verified(_open_pairs(met, component, long, _long_tree(words, wide, low), BLOCK), sets, similarity))
    steps = [-1, *(low + (high - low) * k // BANDS for k in range(1, BANDS + 1))]
    for above, radius in zip(steps, steps[1:], strict=False):
        unsure = materialise(_open_pairs(met, component, long, _long_pairs(words, wide, above, radius), BLOCK), "unsure")
        component = join_components(component, _verified(unsure, sets, similarity))
    grouped = nodes.join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    keep = grouped.groupBy("component").agg(F.min("first").alias("_f")).select(F.col("_f._row").alias("_row"))
    return rows.join(keep, "_row", "left_semi").drop("_row").toDF(*docs.columns)


def _likely(stars: DataFrame, nodes: DataFrame, wide: int) -> DataFrame:
    """Pairs ``a, b`` of each node (id) and the smallest one it met (least) but those whose fingerprints rule them out."""
    prints = nodes.select("id", "n", "fp")
    both = stars.filter("id <> least").join(prints, "id").join(prints.select(F.col("id").alias("least"), F.col("n").alias("m"), F.col("fp").alias("gp")), "least")
    apart = F.aggregate(F.zip_with("fp", "gp", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.filter((F.least("n", "m") <= SHORT) | (apart <= wide)).select(F.col("id").alias("a"), F.col("least").alias("b"))
