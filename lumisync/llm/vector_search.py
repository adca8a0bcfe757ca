"""Exact top-k search by inner product with a vector-approximation file.

The file holds one byte per component: the number of its cell in an even grid between the least
and the greatest value of the dimension. A scan of the file bounds every score from both sides.
Every task names the k-th best lower bound of its rows; what does not reach the greatest of these
is dropped before anything is ranked, so few rows of a query meet in one task, however many tasks
there were. The rows of the k best lower bounds are read exactly first; with the k-th exact score known,
only rows whose upper bound reaches it are read as well, and then the result is certain.

The query set is worked off in blocks of bounded size. Rows of equal vectors tie for every
query, so beyond the k + 1 smallest ids of a vector none can rank; they are cut before the scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import map_arrow
from .tables import materialize, read_table

CELLS = 256
SCALE = 1024
TOP = 10
BLOCK_QUERIES = 2_048
PACK_ROWS = 4_096
STEP_QUERIES = 256

_PACKS = "size int, ids binary, cells binary"
_ARROW_PACKS = pa.schema([("size", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary())])
_BOUNDS = "query_id long, vec_id long, lower double, upper double, kth double"
_ARROW_BOUNDS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64()),
                           ("kth", pa.float64())])
LARGEST_SQUARE = 2.0 ** 62


def whole_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): components as floor(scale * x). Rows without id or vector, and those with
    a null or non-finite component, are left out; of several vectors of one id the smallest counts.
    Vectors whose sum of squares reaches 2^62 are left out too, for their products may not fit a long."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(F.when(F.abs(x.cast("double")) * scale < LARGEST_SQUARE, x.cast("double") * scale)))
    vector = F.transform(whole, lambda x: x.cast("long"))
    square = F.aggregate(whole, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    small = F.coalesce(square < LARGEST_SQUARE * (1 - 1e-9), F.lit(False))
    kept = rows.where(F.col("vec_id").isNotNull() & finite & small).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    return kept.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k greatest inner products of each query.

    Both sides are `(vec_id, vector)` with whole numbers and one row per id, which a written
    table should hold. A query is not compared with the row of its own id nor with vectors of
    another length; ties go to the smaller id; with fewer rows all are returned.
    """
    spark = vectors.sparkSession
    by_id = Window.partitionBy("vector").orderBy("vec_id")
    able = materialize(vectors.withColumn("copy", F.row_number().over(by_id)).where(F.col("copy") <= k + 1).drop("copy"), "vectors")
    grid = _grid(able)
    file = materialize(map_arrow(able, _packer(grid), _PACKS), "cells")

    n_blocks = math.ceil(queries.count() / BLOCK_QUERIES)
    bounds = None
    for block in range(n_blocks):
        chosen = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == block).collect()  # about BLOCK_QUERIES
        shared = spark.sparkContext.broadcast(_by_size((r.vec_id, r.vector) for r in chosen))
        scanned = map_arrow(file, _scanner(shared, grid, k), _BOUNDS)
        bounds = scanned if bounds is None else bounds.union(scanned)
    if bounds is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    scanned = materialize(bounds, "scanned")
    reached = scanned.groupBy("query_id").agg(F.max("kth").alias("reached"))
    bounds = scanned.join(reached, "query_id").where("reached is null or upper >= reached").drop("kth", "reached")
    best = Window.partitionBy("query_id").orderBy(F.desc("lower"), "vec_id")
    bounds = materialize(bounds.withColumn("order", F.row_number().over(best)), "bounds")

    first = materialize(_exact(bounds.where(F.col("order") <= k), able, queries), "exact")
    certain = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    certain = certain.select("query_id", F.when(F.col("n") >= k, F.col("least")).alias("least"))
    open_rows = bounds.where(F.col("order") > k).join(certain, "query_id").where("least is null or upper >= least")
    scores = first.union(_exact(open_rows, able, queries))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (scores.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _grid(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: where the grid of each dimension starts and how wide its cells are."""
    ends = (vectors.select(F.size("vector").alias("size"), F.posexplode("vector").alias("at", "x"))
            .groupBy("size", "at").agg(F.min("x").alias("low"), F.max("x").alias("high")))
    by_size: dict[int, list] = {}
    for row in ends.collect():  # one row per dimension
        by_size.setdefault(row.size, []).append((row.at, row.low, row.high))
    grid = {}
    for size, found in by_size.items():
        _, low, high = (np.array(c, np.float64) for c in zip(*sorted(found)))
        grid[size] = low, (high - low + 1) / CELLS
    return grid


def _by_size(rows: Iterable[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    grouped: dict[int, list] = {}
    for key, vector in rows:
        grouped.setdefault(len(vector), []).append((key, vector))
    return {size: (np.array([k for k, _ in found], np.int64), np.array([v for _, v in found], np.float64).reshape(len(found), size))
            for size, found in grouped.items()}


def _packer(grid):
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK_ROWS):
                rows = batch.slice(at, PACK_ROWS).to_pylist()
                packs = []
                for size, (ids, values) in _by_size((r["vec_id"], r["vector"]) for r in rows).items():
                    cells = np.zeros(values.shape, np.uint8)
                    if size:
                        low, width = grid[size]
                        cells = np.clip((values - low) // width, 0, CELLS - 1).astype(np.uint8)
                    packs.append({"size": size, "ids": ids.tobytes(), "cells": cells.tobytes()})
                yield pa.RecordBatch.from_pylist(packs, schema=_ARROW_PACKS)

    return pack


def _scanner(shared, grid, k: int):
    """For each query the rows of the task whose upper bound reaches its k-th best lower bound there."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                size, ids = row["size"], np.frombuffer(row["ids"], np.int64)
                if size not in shared.value:
                    continue
                query_ids, queries = shared.value[size]
                low, width = grid.get(size, (np.zeros(0), np.zeros(0)))
                cells = np.frombuffer(row["cells"], np.uint8).reshape(len(ids), size)
                middles = low + (cells + 0.5) * width
                for at in range(0, len(query_ids), STEP_QUERIES):
                    step = queries[at:at + STEP_QUERIES]
                    reach = np.abs(step) @ (width / 2)
                    reach += 1e-6 * (reach + np.abs(step) @ np.abs(low + 0.5 * CELLS * width)) + 1  # for rounding
                    scores = step @ middles.T
                    scores[query_ids[at:at + STEP_QUERIES, None] == ids[None, :]] = -np.inf
                    for j, (values, r) in enumerate(zip(scores, reach)):
                        old_ids, old = kept.get((size, at + j), (ids[:0], values[:0]))
                        kept[size, at + j] = _reaching(np.concatenate([old_ids, ids]), np.concatenate([old, values]), r, k)
        for (size, j), (ids, values) in kept.items():
            if len(ids):
                query_ids, queries = shared.value[size]
                low, width = grid.get(size, (np.zeros(0), np.zeros(0)))
                reach = np.abs(queries[j]) @ (width / 2)
                reach += 1e-6 * (reach + np.abs(queries[j]) @ np.abs(low + 0.5 * CELLS * width)) + 1
                kth = [np.partition(values, -k)[-k] - reach if len(ids) >= k else None]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ids), query_ids[j])), pa.array(ids), pa.array(values - reach), pa.array(values + reach),
                    pa.array(kth * len(ids), pa.float64())], schema=_ARROW_BOUNDS)

    return scan


def _reaching(ids: np.ndarray, values: np.ndarray, reach: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All bounds of a query are equally wide, so a row can rank if its middle is within twice the
    reach of the k-th best middle."""
    there = values > -np.inf
    if there.sum() > k:
        there &= values >= np.partition(values, -k)[-k] - 2 * reach
    return ids[there], values[there]


def _exact(rows: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    own = queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    both = rows.select("query_id", "vec_id").join(vectors, "vec_id").join(own, "query_id")
    score = F.aggregate(F.zip_with("query", "vector", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    return both.select("query_id", "vec_id", score.alias("score"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of `embeddings` for every row whose id is divisible by 100."""
    vectors = materialize(whole_vectors(read_table(spark, sf_dir, "embeddings")), "whole")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


_ORACLE = """
with vectors as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v
    from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select q.vec_id as query_id, r.vec_id, cast(list_dot_product(q.v, r.v) as bigint) as score
    from vectors q join vectors r on q.vec_id <> r.vec_id
    where q.vec_id % 100 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 10
"""

QUERIES = {"op5_exact_topk": op5_exact_topk}
ORACLES = {"op5_exact_topk": _ORACLE}
