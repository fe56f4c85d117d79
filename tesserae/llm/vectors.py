"""Vectors as blocks of bounded size, shared by operators 2 and 6."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """(id, dim, vector as doubles): rows without nulls and non-finite components; all-zero vectors only if asked for."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    if not zero:
        fine &= F.exists(v, lambda x: x != 0)
    return df.where(fine).select(F.col(key).cast("long").alias("id"), F.size(v).alias("dim"), v.alias("vector"))


def slot(key: Column | str, count: Column | int, salt: int) -> Column:
    """A number from 0 to count - 1 by a hash of the key."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.greatest(F.lit(1), F.lit(count) if isinstance(count, int) else count)).cast("int")


def matrix(flat: np.ndarray, rows: int) -> np.ndarray:
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k entries of least score, ties to the smaller id."""
    order = np.lexsort((ids, scores), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
