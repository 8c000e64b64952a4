"""Vector arithmetic as Column expressions, and Arrow helpers for the numpy path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column, y: Column) -> Column:
    """Sum of products from left to right in double precision; null if the widths differ."""
    total = F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(x) == F.size(y), total)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def defect(x: Column, dims: int = 0) -> Column:
    """Why ``x`` can't be used: ``null``, ``too short``, ``not finite``, ``zero``; null if it can. ``dims`` 0 keeps all."""
    kept = F.slice(x, 1, dims) if dims else x
    bad = F.exists(kept, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        F.when(x.isNull() | (F.size(x) == 0), "null")
        .when(F.lit(bool(dims)) & (F.size(x) < dims), "too short")
        .when(bad, "not finite")
        .when(~F.exists(kept, lambda v: v != 0), "zero")
    )


def normalized(x: Column, dims: int = 0) -> Column:
    """The first ``dims`` values (all if 0) scaled to length one, as floats; null where ``defect`` names a reason."""
    kept = F.slice(x, 1, dims) if dims else x
    # the length is an element of an outer array, so it is worked out once and not for every value
    scaled = F.transform(F.array(norm(kept)), lambda length: F.transform(kept, lambda v: (v.cast("double") / length).cast("float")))
    return F.when(defect(x, dims).isNull(), scaled[0])


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow column of equally long float lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
