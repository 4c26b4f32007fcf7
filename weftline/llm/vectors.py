"""What the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """Neither null, empty nor zero, and every component a finite number."""
    c = F.col(vec)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0)


def dimension(df: DataFrame, vec: str) -> int:
    """The commonest number of components among usable vectors (the smallest of equally common ones); 0 if there are none."""
    row = df.where(usable(vec)).groupBy(F.size(vec).alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return row[0] if row else 0


def matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float32) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), dtype)
