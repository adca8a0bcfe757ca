"""Every row of one table against every row of another of the same batch, in bounded blocks.

A batch is hashed into groups small enough to hold as matrices; most batches are one group.
A task gets one group of each side and returns a reduction of the block (partial row and
column sums), so no pair is ever written out and no large batch is held whole anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

ROWS_PER_BLOCK = 16_384


def block_reduce(
    left: DataFrame,
    right: DataFrame,
    key: str,
    reduce: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    rows_per_block: int = ROWS_PER_BLOCK,
    batch: str = "batch",
) -> DataFrame:
    """Apply `reduce(left_block, right_block)` to every pair of blocks of a batch.

    `key` names the unique key column on both sides, `batch` the column that holds together the
    rows that meet. The work is rows times batch size: a row is copied only where the other side
    of its batch exceeds one block. The group of a row depends on its key and the sizes of its
    batch alone, so a recomputed task sees the same blocks.
    """
    def sizes(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(batch).agg(F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias(name))

    blocks = sizes(left, "n_left").join(sizes(right, "n_right"), batch)

    def grouped(side: DataFrame, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        group = F.pmod(F.xxhash64(key), F.col(n_own)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))
        # Fresh aliases: both sides may come from one table and must not share columns.
        columns = [F.col(c).alias(c) for c in side.columns]
        return side.join(blocks, batch).select(*columns, group.alias(own), copies.alias(other))

    ship_package(left.sparkSession)
    a = grouped(left, "bi", "n_left", "bj", "n_right").groupBy(batch, "bi", "bj")
    b = grouped(right, "bj", "n_right", "bi", "n_left").groupBy(batch, "bi", "bj")
    return a.cogroup(b).applyInArrow(reduce, schema)


def to_matrix(column: pa.ChunkedArray | pa.Array, dim: int | None = None) -> np.ndarray:
    """A list<float> column as a float64 matrix. Rows of another length are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, dim or 0))
    if column.null_count:
        raise ValueError("a vector is NULL")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    width = dim or int(sizes[0])
    if (sizes != width).any():
        raise ValueError("vectors differ in length")
    return values.reshape(-1, width)
