"""What the vector operators share: which vectors count, and one row for equal ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str = "embedding") -> Column:
    """True for vectors that are not null or empty, hold only finite numbers and not only zeros."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def usable_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Distinct (vec_id, embedding) of the usable vectors with an id; single precision stays so, all else is double.

    Arithmetic is in double precision (``matrix``); only what is stored and shuffled stays small.
    """
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    return df.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("embedding")).distinct()


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as one matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().astype(np.float64, copy=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))
