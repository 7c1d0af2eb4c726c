"""Vector columns of Arrow batches as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_length(df: DataFrame, column: str) -> int:
    """The most frequent length of the vectors (the greater one of equally
    frequent ones); 0 without vectors.  Vectors of other lengths are no points of the
    same space."""
    sizes = df.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return int(top["d"]) if top else 0


def matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """``(mask, x)``: which rows hold ``d`` finite numbers, and those rows as doubles."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ok = size == d
    if ok.all():
        x = flat.reshape(-1, d)
    else:
        own = np.maximum(size, 0)
        begin = np.cumsum(own) - own
        x = flat[begin[ok][:, None] + np.arange(d)]
    good = np.isfinite(x).all(1)
    mask = ok.copy()
    mask[ok] = good
    return mask, x if good.all() else x[good]
