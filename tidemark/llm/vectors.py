"""Integer vectors that the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(x: Column) -> Column:
    """Whether an array<double> is there and holds finite components only."""
    return x.isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))


def integers(rows: DataFrame, vector: str, scale: int, **columns: Column) -> DataFrame:
    """The given columns and v (array of long): floor(scale * x) of every component. Rows of unusable vectors are left out."""
    out = rows.select(*[c.alias(name) for name, c in columns.items()], F.col(vector).cast("array<double>").alias("_x")).filter(usable(F.col("_x")))
    return out.select(*columns, F.transform("_x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def extent(rows: DataFrame) -> tuple[int, int, float]:
    """Rows of `integers`, the length of the longest vector and the largest component's size."""
    peak = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    count, width, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(peak)).first()
    return count, width or 0, most or 0.0


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list array as int64, shorter vectors filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out
