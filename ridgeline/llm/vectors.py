"""What the vector operators share: whole-number vectors, and a bounded k-means that places index lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components from this many steps on in magnitude are an error: sums of their products would not fit in 64 bits.
LARGEST = 1 << 24


def whole_numbers(vectors: DataFrame, vec_col: str, keep: list[Column], scale: int = 256) -> DataFrame:
    """``keep`` and ``q`` array<int>: floor(scale * x), x as double, of the vectors without null or non-finite components.

    Null vectors and those with such components are left out; a vector may be empty.
    """
    usable = F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    steps = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale))
    fits = F.when(F.exists(steps, lambda x: F.abs(x) >= LARGEST), F.raise_error(F.lit(f"a component has {LARGEST} steps or more"))).otherwise(steps)
    return vectors.filter(usable).select(*keep, fits.cast("array<int>").alias("q"))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A column of lists, all of ``dims`` numbers, as a matrix of 64-bit integers."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(a), dims)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, without rounding: by doubles if every partial sum fits in them."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    if x.shape[1] * int(np.abs(x).max()) * int(np.abs(y).max()) < 1 << 53:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T


def lloyd(x: np.ndarray, k: int, rounds: int = 5, seed: int = 0) -> np.ndarray:
    """At most ``k`` integer centroids of the rows of ``x``, from rows drawn by a seed; empty clusters go."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].astype(np.float64)
    for _ in range(rounds):
        near = (0.5 * (c * c).sum(1) - x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = total[n > 0] / n[n > 0, None]
    return np.unique(np.floor(c).astype(np.int64), axis=0)
