"""Embedding near-dedup by randomised-rotation binary codes.

Every unit vector is rotated by a random orthogonal matrix and stored as the signs of its coordinates with
a correction factor, <code, vector>. The code of one vector and the other vector give an unbiased estimate of
their inner product and a confidence bound; a pair is computed exactly in double precision only if the bound
reaches the threshold. Pairs are formed inside buckets of equal code bands (several independent bands; their
number follows from the wanted recall), cut into blocks of bounded size; a pair is counted in the first band
it shares. Equal vectors are one node with a multiplicity, and each pair of blocks returns link counts and a
spanning forest, so groups of copies never turn into all their pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonaris.llm.common import map_arrow, materialise, mix, pick
from tonaris.llm.components import connected_components
from tonaris.llm.tiles import Forest, pack, pairs

#: Rows of a block.
BLOCK = 1024
#: Standard deviations of the estimate's error that the confidence bound allows for.
EPSILON = 4.0


def plan_bands(n: int, threshold: float, recall: float, block: int = BLOCK) -> tuple[int, int]:
    """Bits in a band and number of bands: buckets of about ``block`` rows or 6 bits, and this recall at the threshold."""
    same = 1 - math.acos(threshold) / math.pi
    bits = min(24, max(6, math.ceil(math.log2(max(1, n / block)))))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same**bits))


def rotations(dim: int, count: int, seed: int = 8) -> np.ndarray:
    """``count`` random orthogonal matrices."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def codes(v: np.ndarray, rots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of every rotation (n, all bits) and, of the first rotation, <code, vector> with code = signs / sqrt(dim)."""
    parts = [v @ r for r in rots]
    return np.concatenate([p > 0 for p in parts], axis=1), np.abs(parts[0]).sum(axis=1) / math.sqrt(v.shape[1])


def estimate(v: np.ndarray, signs: np.ndarray, factor: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of rows of ``v`` with the vectors behind ``signs``, and the bound on the error."""
    dim = v.shape[1]
    code = np.where(signs[:, :dim], 1.0, -1.0) / math.sqrt(dim)
    got = (v @ rot) @ code.T / factor[None, :]
    error = EPSILON * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, dim - 1))
    return got, error


def _usable():
    return F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)


def _banded(dim: int, bits: int, bands: int):
    """Map of nodes to a row for each band: tile, label, id, weight, vector, its sign bits and correction factor.

    A tile is a hash of label, band and bucket; the label travels with the row and is compared again.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        v = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        signs, factor = codes(unit(v), rotations(dim, math.ceil(bits * bands / dim)))
        weights = 1 << np.arange(bits, dtype=np.int64)
        label = mix(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) << np.uint64(8)
        tiles = []
        for k in range(bands):  # the lowest 8 bits hold the band
            bucket = (signs[:, k * bits : (k + 1) * bits] @ weights).astype(np.uint64)
            tiles.append((mix(label + bucket + np.uint64(1)) << np.uint64(8) | np.uint64(k)).view(np.int64))
        at = np.tile(np.arange(b.num_rows), bands)
        packed = np.packbits(signs, axis=1)
        own = pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array([c.tobytes() for c in packed], pa.binary()), pa.array(factor)], ["id", "label", "weight", "vector", "code", "factor"])
        rest = own.take(pa.array(at))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tiles)), *rest.columns], ["tile", *rest.schema.names])

    return run


def _compare(dim: int, bits: int, bands: int, threshold: float):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rots = rotations(dim, 1)
        total = dim * math.ceil(bits * bands / dim)
        ids_out, links_out, root_out = [], [], []
        for r in range(b.num_rows):
            ids, label, weight, vec, sign, factor = [], [], [], [], [], []
            for c in (0, 1):
                rows = b.column(c)[r].values
                ids.append(rows.field("id").to_numpy(zero_copy_only=False))
                label.append(rows.field("label").to_numpy(zero_copy_only=False))
                weight.append(rows.field("weight").to_numpy(zero_copy_only=False))
                v = unit(rows.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                bits_of = np.frombuffer(b"".join(rows.field("code").to_pylist()), np.uint8).reshape(len(v), -1)
                vec.append(v)
                sign.append(np.unpackbits(bits_of, axis=1, count=total).astype(bool))
                factor.append(rows.field("factor").to_numpy(zero_copy_only=False))
            same, band, n = b.column(2)[r].as_py(), b.column(3)[r].as_py(), len(ids[0])
            got, error = estimate(vec[0], sign[1], factor[1], rots[0])
            i, j = np.nonzero((got + error[None, :] >= threshold) & (label[0][:, None] == label[1][None, :]))
            if same:
                i, j = i[i < j], j[i < j]
            own = slice(band * bits, (band + 1) * bits)
            first = (sign[0][i, own] == sign[1][j, own]).all(axis=1)
            for k in range(band):  # pairs that share an earlier band belong to that
                at = slice(k * bits, (k + 1) * bits)
                first &= (sign[0][i, at] != sign[1][j, at]).any(axis=1)
            i, j = i[first], j[first]
            exact = np.concatenate([np.einsum("ij,ij->i", vec[0][i[lo : lo + 65536]], vec[1][j[lo : lo + 65536]]) for lo in range(0, len(i), 65536)] or [np.empty(0)])
            i, j = i[exact >= threshold], j[exact >= threshold]
            every = ids[0] if same else np.concatenate(ids)
            shift = 0 if same else n
            forest = Forest(len(every))
            forest.union(i, j + shift)
            links = np.bincount(i, weight[1][j], len(every)) + np.bincount(j + shift, weight[0][i], len(every))
            hit = np.flatnonzero(links)
            ids_out.append(every[hit])
            links_out.append(links[hit].astype(np.int64))
            root_out.append(every[forest.label[hit]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (ids_out, links_out, root_out)], ["id", "links", "root"])

    return run


def embedding_groups(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.9995, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of (vec_id, embedding, label).

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine in double precision is
    ``threshold`` or more; pairs at the threshold are found with probability ``recall``, nearer ones with a higher one, and
    equal vectors surely. Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    Repeated rows are vectors of their own. component_id is the smallest vec_id reachable (nulls only if there is no other); a
    row is kept if its vec_id is that. Each length of vectors that occurs is searched by itself. Extra columns are left out,
    an empty table gives an empty one.
    """
    own = pick(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    rows = own.withColumn("dim", F.when(_usable(), F.size("embedding")))
    usable = rows.filter("dim IS NOT NULL")
    nodes = usable.groupBy("label", "embedding", "dim").agg(F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("id"), "label", "weight", F.col("embedding").alias("vector"), "low", "dim")
    nodes = materialise(nodes, "vectors")
    found = None
    for dim, biggest in sorted(map(tuple, nodes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count")).toLocalIterator())):
        part = _links(nodes.filter(F.col("dim") == dim), dim, biggest, threshold, recall, block)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = materialise(found, "links")
    component = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    lows = component.join(nodes.select(F.col("id").alias("node"), "low"), "node")
    low = lows.groupBy("component").agg(F.min("low").alias("_low"))
    linked = lows.select("node", "component").join(low, "component").select(F.col("node").alias("id"), "_low")
    all_nodes = nodes.join(links, "id", "left").join(linked, "id", "left")
    all_nodes = all_nodes.select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("_low", "low").alias("component_id"))
    # vectors with null or non-finite components have no dim and so no node; the others meet theirs by value
    out = rows.withColumn("_key", F.when(F.col("dim").isNotNull(), F.col("embedding")))
    out = out.join(all_nodes, (F.col("_key") == F.col("_vector")) & (F.col("label") == F.col("_label")), "left")
    component_id = F.when(F.col("dim").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept"))


def _links(nodes: DataFrame, dim: int, biggest: int, threshold: float, recall: float, block: int) -> DataFrame:
    """``id, links, root`` among nodes of one length, ``biggest`` of them at most with one label."""
    bits, bands = plan_bands(biggest, threshold, recall, block)
    banded = map_arrow(nodes.select("id", "label", "weight", "vector"), _banded(dim, bits, bands), f"tile long, id long, label long, weight long, vector {nodes.schema['vector'].dataType.simpleString()}, code binary, factor double")
    packs = materialise(pack(banded, "id", ["id", "label", "weight", "vector", "code", "factor"], block), "packs")
    work = pairs(packs).select("a", "b", "same", F.pmod("tile", F.lit(256)).cast("int").alias("band"))
    work = work.repartition(max(8, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return map_arrow(work, _compare(dim, bits, bands, threshold), "id long, links long, root long")
