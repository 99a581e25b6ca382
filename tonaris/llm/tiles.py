"""Tiles: rows packed by a tile key into blocks of bounded size, and pairs of blocks to compare.

A tile that holds more rows than ``size`` is cut into several blocks, so no task sees more than two blocks
at a time, however many rows share a key. Block pairs, not row pairs, are dealt out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonaris.llm.common import materialise


#: Large tiles up to this many (12 bytes each) are broadcast; above, rows and tiles meet by tile and salt.
BROADCAST_TILES = 500_000
SALTS = 64


def pack(rows: DataFrame, order: str, columns: list[str], size: int, also: list[str] | None = None) -> DataFrame:
    """``tile, block, rows`` from rows with a long ``tile``; ``order`` is a column whose hash picks the block; ``also``: columns that a tile's rows share.

    Rows are dealt out by tile and block, never by tile alone, so no task gets a whole large tile.
    """
    large = rows.groupBy("tile").count().filter(F.col("count") > size).select("tile", F.ceil(F.col("count") / size).alias("_n"))
    large = materialise(large, "large-tiles")
    if large.count() <= BROADCAST_TILES:
        cut = rows.join(F.broadcast(large), "tile", "left")
    else:
        large = large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        cut = rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit(3), order), F.lit(SALTS)).cast("int")).join(large, ["tile", "_salt"], "left")
    block = F.pmod(F.xxhash64(order), F.coalesce("_n", F.lit(1)).cast("long")).cast("int")
    return cut.withColumn("block", block).repartition("tile", "block").groupBy("tile", "block", *(also or [])).agg(F.collect_list(F.struct(*columns)).alias("rows"))


def pairs(packs: DataFrame, tiles: DataFrame | None = None) -> DataFrame:
    """Every unordered pair of blocks (a block with itself included) of one tile, or of tiles named in ``tiles`` (tile, other; both orders or one).

    Columns tile (of a), a, b (rows of each block) and same (true for a block with itself).
    """
    meta = packs.select("tile", "block")
    other = meta.select(F.col("tile").alias("other"), F.col("block").alias("other_block"))
    left = meta.withColumn("other", F.col("tile")) if tiles is None else meta.join(tiles, "tile")
    work = left.join(other, "other").filter("other > tile OR (other = tile AND other_block >= block)")
    work = work.select("tile", "block", "other", "other_block").distinct() if tiles is not None else work
    own = packs.select("tile", "block", F.col("rows").alias("a"))
    others = packs.select(F.col("tile").alias("other"), F.col("block").alias("other_block"), F.col("rows").alias("b"))
    joined = work.join(own, ["tile", "block"]).join(others, ["other", "other_block"])
    return joined.select("tile", "a", "b", ((F.col("tile") == F.col("other")) & (F.col("block") == F.col("other_block"))).alias("same"))


class Forest:
    """Labels of nodes 0..n-1 under unions given as index arrays; many links of one group cost little."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        """Link i[k] and j[k] for all k."""
        while True:
            a, b = self.label[i], self.label[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            high, low = np.maximum(a, b), np.minimum(a, b)
            # each high root takes its lowest partner; roots are then shortened until stable
            parent = np.arange(len(self.label))
            np.minimum.at(parent, high, low)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            self.label = parent[self.label]

    def tree(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """As ``union``; returns which of the links joined two groups, so that they alone make the same groups."""
        at, chosen = np.arange(len(i)), [np.zeros(0, np.int64)]
        while True:
            a, b = self.label[i[at]], self.label[j[at]]
            open_ = a != b
            if not open_.any():
                return np.concatenate(chosen)
            at, a, b = at[open_], a[open_], b[open_]
            high, low = np.maximum(a, b), np.minimum(a, b)
            parent = np.arange(len(self.label))
            np.minimum.at(parent, high, low)
            least = np.flatnonzero(parent[high] == low)
            chosen.append(at[least[np.unique(high[least], return_index=True)[1]]])
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            self.label = parent[self.label]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """A star for each group: its nodes but the root, and their roots."""
        i = np.flatnonzero(self.label != np.arange(len(self.label)))
        return i, self.label[i]
