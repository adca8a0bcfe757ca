"""The scaled similarity matrix of batches of two embedding tables and the contrastive loss on it."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, normalize
from .blocks import ROWS_PER_BLOCK, block_reduce, to_matrix

ENTRIES_PER_STEP = 4_000_000
_PARTIAL = "side string, id {key}, n bigint, total double, low double, high double, mass double"


def similarity_summary(texts: DataFrame, images: DataFrame, logit_scale: float = 0.0,
                       rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Row and column statistics of `texts @ images.T * exp(logit_scale)` of each batch.

    Both inputs are (batch, id, vector); only rows of one batch meet. The matrix of a batch
    exists only block by block inside tasks; what leaves a block is one partial per row and
    column: (side, id, n, mean, low, high, logsumexp), side "text" or "image". The inputs are
    read more than once, so write them first if they come from an encoder.
    """
    key = texts.schema["id"].dataType.simpleString()
    partial = block_reduce(
        texts.select("batch", "id", F.col("vector").alias("vec")),
        images.select("batch", "id", F.col("vector").alias("vec")),
        "id", _block_statistics(math.exp(logit_scale), ENTRIES_PER_STEP), _PARTIAL.format(key=key), rows_per_block,
    )
    # exp() is taken relative to the largest entry of the whole row or column. The window
    # and the grouping share one shuffle on (side, id).
    peak = F.max("high").over(Window.partitionBy("side", "id"))
    return (
        partial.withColumn("peak", peak)
        .groupBy("side", "id")
        .agg(
            F.sum("n").alias("n"),
            (F.sum("total") / F.sum("n")).alias("mean"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            (F.first("peak") + F.log(F.sum(F.col("mass") * F.exp(F.col("high") - F.col("peak")))))
            .alias("logsumexp"),
        )
    )


def _block_statistics(scale: float, entries: int):
    def reduce(texts: pa.Table, images: pa.Table) -> pa.Table:
        rows = to_matrix(texts.column("vec")) if texts.num_rows else np.empty((0, 1))
        columns = to_matrix(images.column("vec")) if images.num_rows else np.empty((0, 1))
        text_side = _Statistics(len(rows) if len(columns) else 0)
        image_side = _Statistics(len(columns) if len(rows) else 0)
        step = max(1, entries // max(1, len(columns)))
        for start in range(0, len(rows) if len(columns) else 0, step):
            logits = rows[start:start + step] @ columns.T * scale
            text_side.add(slice(start, start + step), logits)
            image_side.add(slice(None), logits.T)
        parts = [s.table(side, ids.column("id").slice(0, len(s.n)))
                 for s, side, ids in ((text_side, "text", texts), (image_side, "image", images))
                 if "id" in ids.column_names]
        return pa.concat_tables(parts)

    return reduce


class _Statistics:
    """Running count, sum, extremes and exp-sum per matrix row."""

    def __init__(self, size: int):
        self.n = np.zeros(size, np.int64)
        self.total, self.mass = np.zeros(size), np.zeros(size)
        self.low, self.high = np.full(size, np.inf), np.full(size, -np.inf)

    def add(self, where: slice, logits: np.ndarray) -> None:
        high = np.maximum(self.high[where], logits.max(axis=1))
        self.mass[where] *= np.exp(self.high[where] - high)
        self.mass[where] += np.exp(logits - high[:, None]).sum(axis=1)
        self.high[where] = high
        self.low[where] = np.minimum(self.low[where], logits.min(axis=1))
        self.total[where] += logits.sum(axis=1)
        self.n[where] += logits.shape[1]

    def table(self, side: str, ids: pa.ChunkedArray) -> pa.Table:
        names = pa.array([side] * len(ids), pa.string())
        return pa.table({"side": names, "id": ids, "n": self.n, "total": self.total,
                         "low": self.low, "high": self.high, "mass": self.mass})


def contrastive_loss(pairs: DataFrame, logit_scale: float = 0.0,
                     rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Symmetric cross-entropy of matching pairs against the rest of their batch: (batch, loss).

    `pairs` is (batch, id, text, image) with one vector of each kind; both are scaled to unit
    length first. A batch's loss is the mean over its rows and over its columns of
    logsumexp - diagonal, halved.
    """
    unit = pairs.select("batch", "id", normalize(F.col("text")).alias("text"), normalize(F.col("image")).alias("image"))
    summary = similarity_summary(
        unit.select("batch", "id", F.col("text").alias("vector")),
        unit.select("batch", "id", F.col("image").alias("vector")),
        logit_scale, rows_per_block,
    )
    diagonal = unit.select("batch", "id", (dot(F.col("text"), F.col("image")) * math.exp(logit_scale)).alias("own"))
    return summary.join(diagonal, "id").groupBy("batch").agg(F.avg(F.col("logsumexp") - F.col("own")).alias("loss"))
