"""What the operators on vectors share: which vectors count, and their rows as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole-number components are held to this size either way, so that squares and their sums stay whole in 64 bits.
LIMIT = 1 << 24


def is_finite(vector: Column) -> Column:
    """Whether a vector isn't null and holds neither null nor a component that isn't finite. One without components is finite."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column whose lists are of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, within LIMIT."""
    return np.clip(np.floor(x * scale), -LIMIT, LIMIT).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exact: in doubles as long as every partial sum is below 2**53, else in 64-bit integers."""
    most = lambda x: int(np.abs(x).max(initial=0))
    if most(a) * most(b) * max(1, a.shape[1]) < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a @ b.T


def usual_length(rows: DataFrame, column: str) -> int:
    """The most frequent length of a column of vectors, the smaller of equally frequent ones; 0 if there is no row. One row for each length is compared."""
    sizes = rows.groupBy(F.size(column).alias("size")).count()
    first = sizes.orderBy(F.col("count").desc(), "size").first()
    return first["size"] if first else 0
