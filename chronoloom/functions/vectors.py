"""Vectors in array columns: sums in aggregations, matrices in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components that one aggregation sums side by side.
SIDE_BY_SIDE = 64


def width_of(rows: DataFrame, col: str = "x") -> int:
    """The length of the vectors, 1 where there are none."""
    return rows.agg(F.max(F.size(col))).first()[0] or 1


def summed(rows: DataFrame, keys: list[str], weight: Column, vector: str, width: int, *more: Column) -> DataFrame:
    """keys, x: the sum of weight * vector in each group, and further aggregates.

    Components are summed as columns, so that the aggregation combines on the
    map side and no row is made for a component. Vectors that are wider than
    SIDE_BY_SIDE go in pieces of that length.
    """
    v = F.col(vector)
    if width <= SIDE_BY_SIDE:
        sums = rows.groupBy(*keys).agg(*[F.sum(weight * v[i]).alias(f"_{i}") for i in range(width)], *more)
        return sums.select(*keys, F.array(*[f"_{i}" for i in range(width)]).alias("x"), *sums.columns[len(keys) + width :])
    starts = list(range(0, width, SIDE_BY_SIDE))
    pieces = F.array(*[F.struct(F.lit(at).alias("at"), F.slice(v, at + 1, SIDE_BY_SIDE).alias("v")) for at in starts])
    flat = rows.select(*keys, weight.alias("_w"), F.explode(pieces).alias("_p")).select(*keys, "_w", "_p.*")
    sums = flat.groupBy(*keys, "at").agg(*[F.sum(F.col("_w") * F.get("v", F.lit(i))).alias(f"_{i}") for i in range(SIDE_BY_SIDE)])
    parts = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", F.array(*[f"_{i}" for i in range(SIDE_BY_SIDE)]).alias("v")))).alias("p"))
    out = parts.select(*keys, F.slice(F.flatten(F.transform("p", lambda p: p["v"])), 1, width).alias("x"))
    return out.join(rows.groupBy(*keys).agg(*more), keys) if more else out


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of equal length as one matrix, without a Python object for each."""
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel()))


def map_batches(rows: DataFrame, fn: Callable[[pa.RecordBatch, Any], Iterator[dict[str, pa.Array]]], shared: Any, shape: str) -> DataFrame:
    """fn over Arrow batches that are not empty, with one broadcast value of a
    size that does not depend on the data (weights)."""
    value = rows.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for cols in fn(batch, value.value):
                    yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return rows.mapInArrow(run, shape)
