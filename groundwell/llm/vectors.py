"""Vectors as the search operators take them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) without null keys and without vectors that are null, empty, zero or hold null or non-finite parts."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix; unequal lengths are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    if not len(sizes):
        return np.empty((0, 0))
    if (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return np.asarray(column.flatten()).reshape(len(sizes), -1)
