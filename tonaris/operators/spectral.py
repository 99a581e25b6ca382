"""Real spectra of vectors: forward and inverse transforms and products of spectra, as Arrow batches of arrays.

A spectrum of a vector of ``size`` (a power of two, at least 2) values has size / 2 + 1 bins, as arrays ``re`` and ``im``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _checked(size: int) -> int:
    if size < 2 or size & (size - 1):
        raise ValueError(f"the size of a transform is a power of two of at least 2, not {size}")
    return size


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of an array column cut or padded with zeros to ``size``; null rows and values are zeros."""
    out = np.zeros((len(column), size))
    for i, row in enumerate(column):
        if row.is_valid:
            v = row.values.to_numpy(zero_copy_only=False)[:size].astype(np.float64)
            out[i, : len(v)] = np.nan_to_num(v, posinf=0.0, neginf=0.0)
    return out


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1)))


def _mapped(df: DataFrame, columns: list[str], fn, names: list[str]) -> DataFrame:
    """``df`` without ``columns``, and arrays that ``fn`` makes of them."""
    rest = [c for c in df.columns if c not in {*columns, *names}]

    def run(batches):
        for b in batches:
            made = fn(*(b.column(len(rest) + i) for i in range(len(columns))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *map(_lists, made)], [*rest, *names])

    own = df.select(*rest)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema] + [f"{n} array<double>" for n in names]
    return df.select(*rest, *columns).mapInArrow(run, ", ".join(kinds))


def spectrum(df: DataFrame, column: str, size: int) -> DataFrame:
    """The forward transform of an array column: ``re`` and ``im`` in its place; shorter vectors are padded with zeros."""
    _checked(size)

    def fn(x):
        z = np.fft.rfft(_matrix(x, size), axis=1)
        return z.real, z.imag

    return _mapped(df, [column], fn, ["re", "im"])


def inverse(df: DataFrame, size: int, name: str = "x") -> DataFrame:
    """The inverse transform of ``re`` and ``im``, scaled by 1 / size, as the array ``name``."""
    _checked(size)

    def fn(re, im):
        return (np.fft.irfft(_matrix(re, size // 2 + 1) + 1j * _matrix(im, size // 2 + 1), size, axis=1),)

    return _mapped(df, ["re", "im"], fn, [name])


def product(re: Column, im: Column, re2: Column, im2: Column, conjugate: bool = False) -> tuple[Column, Column]:
    """Bin by bin product of two spectra given as arrays; ``conjugate``: with the second's conjugate."""
    sign = -1.0 if conjugate else 1.0
    n = F.sequence(F.lit(0), F.size(re) - 1)
    at = lambda a, i: F.get(a, i)
    real = F.transform(n, lambda i: at(re, i) * at(re2, i) - F.lit(sign) * at(im, i) * at(im2, i))
    imag = F.transform(n, lambda i: F.lit(sign) * at(re, i) * at(im2, i) + at(im, i) * at(re2, i))
    return real, imag


def total(a: Column, b: Column) -> Column:
    """Bin by bin sum of two arrays."""
    return F.zip_with(a, b, lambda x, y: x + y)
