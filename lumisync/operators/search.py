"""Exact cosine search: one query, many queries, full ranking."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import parquet
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import ZERO_TOLERANCE, dot, is_match, is_zero, norm, vector_literal
from ..session import fresh_dir, map_arrow, parallelism, spread
from ..sources.files import is_uri, read_bytes, strip_file_scheme
from .blocks import to_matrix

# So many bytes of queries, and so many results of all queries, does a task hold at a time.
BLOCK_BYTES = 32 << 20
BLOCK_RESULTS = 2_000_000
# Smaller blocks share a file of about so many bytes, which is opened once for all of them.
FILE_BYTES = 4 << 20
# With several blocks of queries, a task goes through them once for so many bytes of its rows.
STRETCH_BYTES = 64 << 20
SEED_ROWS = 4_096  # rows of the store that give the first bounds of a large search
SLOT_ROWS = 100_000  # candidates of one query that one task ranks
# From so many queries on, scoring a row costs far more than sending it to another task.
SPREAD_QUERIES = 16_384
SCORES_PER_STEP = 4_000_000
TILE_QUERIES, TILE_ROWS = 128, 2_048  # scored at a time, so that the scores stay near the core
ARROW_MAX_LIMIT = 100_000
# Every task hands on its best rows. More of them than this are cut in parallel before the
# final merge, which is one task.
MERGE_ROWS = 1_000_000


def score_all(store: DataFrame, query: Sequence[float], vector: str = "vector") -> DataFrame:
    """Add `score`, the cosine with the query; NULL for a zero vector."""
    length = math.sqrt(sum(float(x) ** 2 for x in query))  # once, not once per row
    column = F.col(vector)
    score = F.try_divide(dot(column, vector_literal(query)), norm(column) * F.lit(length))
    return store.withColumn("score", score)


def full_ranking(store: DataFrame, query: Sequence[float], key: str = "path",
                 vector: str = "vector") -> DataFrame:
    """Every row by descending score, ties by descending key."""
    scored = score_all(store, query, vector).select(key, "score")
    return scored.orderBy(F.desc_nulls_last("score"), F.desc(key))


def search(store: DataFrame, query: Sequence[float], limit: int = 10, key: str = "path",
           vector: str = "vector", use_arrow: bool | None = None) -> DataFrame:
    """The `limit` best rows: (key, score, total_images).

    Zero vectors mark failed inputs and never match, nor do NULL vectors or scores that are
    no numbers; the test is on stored rows only, so a tiny query matches. Only positive scores
    count; ties go to the smaller key; a vector of another length is an error. Both ways of
    scoring follow these rules. `total_images` counts the whole store, failed rows included.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    if use_arrow is None:
        use_arrow = limit <= ARROW_MAX_LIMIT
    rows = store.select(key, vector).where(F.col(vector).isNotNull())
    if use_arrow and 0 < limit <= ARROW_MAX_LIMIT:
        schema = rows.select(key).schema.add("score", "double")
        candidates = map_arrow(rows, _topk_task(np.array(query, np.float64), limit, key), schema)
    else:
        candidates = (
            score_all(rows.where(~is_zero(F.col(vector))), query, vector)
            .where(is_match(F.col("score"))).select(key, "score")
        )
    handed_on = rows.rdd.getNumPartitions() * limit
    if handed_on > MERGE_ROWS:
        candidates = _thin(candidates, limit, key, math.ceil(handed_on / MERGE_ROWS))
    best = candidates.orderBy(F.desc("score"), key).limit(limit)
    total = store.agg(F.count("*").alias("n")).scalar()
    return best.withColumn("total_images", total)


def _thin(candidates: DataFrame, limit: int, key: str, slots: int) -> DataFrame:
    """Cut the lists of many tasks to `slots` lists of `limit`. Every slot keeps its best `limit`
    rows, so nothing is lost."""
    slot = F.pmod(F.xxhash64(key), F.lit(slots))
    order = Window.partitionBy("__slot").orderBy(F.desc("score"), F.asc(key))
    ranked = candidates.withColumn("__slot", slot).withColumn("__place", F.row_number().over(order))
    return ranked.where(F.col("__place") <= limit).drop("__slot", "__place")


def search_rounded(store: DataFrame, query: Sequence[float], limit: int = 5,
                   key: str = "path", vector: str = "vector") -> DataFrame:
    """As `search`, scores rounded to three decimals after the positive test."""
    best = search(store, query, limit, key, vector)
    return best.select(key, F.round("score", 3).alias("score"))


def numbered(results: DataFrame, key: str = "path") -> DataFrame:
    """Add the rank from 1 and the three-decimal label to one result list (at most k rows)."""
    order = Window.orderBy(F.desc("score"), F.asc(key))
    return results.withColumn("rank", F.row_number().over(order)).withColumn(
        "label", F.format_string("%.3f", "score"))


def _topk_task(query: np.ndarray, limit: int, key: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, top = _QueryBlock(query[None, :]), _RunningTopK(1, limit)
        for batch in batches:
            top.add(batch.column(0), to_matrix(batch.column(1), len(query)), block)
        best = top.shrink()
        if best is not None:
            found = pa.table({key: best.column("__key"), "score": best.column("score")})
            yield from found.combine_chunks().to_batches()

    return run


class _QueryBlock:
    """Query vectors with their lengths, scored against blocks of rows."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.norms = _lengths(vectors)
        with np.errstate(invalid="ignore"):
            self.unit = (vectors / self.norms[:, None]).astype(np.float32)  # NaN without a length
        # Bound on the rounding error of a float32 dot product of unit vectors.
        self.slack = (vectors.shape[1] + 8) * 2.4e-7

    def exact(self, rows: np.ndarray, row_norms: np.ndarray, row: np.ndarray,
              query: np.ndarray) -> np.ndarray:
        """Cosines of chosen pairs in double, summed in one fixed order.

        A matrix product may round equal vectors differently depending on where they
        stand in the block. Ties must be ties, so survivors are scored again like this.
        """
        out = np.empty(len(row))
        step = max(1, SCORES_PER_STEP // max(1, rows.shape[1]))
        for start in range(0, len(row), step):
            r, q = row[start:start + step], query[start:start + step]
            dots = np.einsum("ij,ij->i", rows[r], self.vectors[q])
            out[start:start + step] = dots / (row_norms[r] * self.norms[q])
        return out


def _without_hopeless_copies(keys: pa.Array, rows: np.ndarray, limit: int) -> tuple[pa.Array, np.ndarray]:
    """Drop rows that no query can ever rank in its first `limit`.

    Equal vectors score equally and the smaller key wins, so of any number of copies in
    a batch only the `limit` smallest keys can appear in a result. A vector that fills a
    third of the store then costs no more than any other.
    """
    if len(rows) <= limit:
        return keys, rows
    bits = np.ascontiguousarray(rows).view(np.uint64)
    mix = np.arange(1, bits.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mark = ((bits ^ (bits >> np.uint64(29))) * mix).sum(axis=1)
    _, group, sizes = np.unique(mark, return_inverse=True, return_counts=True)
    if sizes.max() <= limit:
        return keys, rows
    keep = np.ones(len(rows), bool)
    for crowd in np.flatnonzero(sizes > limit):
        members = np.flatnonzero(group == crowd)
        members = members[(bits[members] == bits[members[0]]).all(axis=1)]
        order = pa.compute.sort_indices(keys.take(pa.array(members))).to_numpy()
        keep[members[order[limit:]]] = False
    return keys.filter(pa.array(keep)), rows[keep]


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", vectors, vectors))


class _StoreRows:
    """Rows of the store that a query may find, made ready once for any number of blocks of queries.

    Rows that pass the all-zero test have no cosine with any query, nor have those with an entry
    that is no finite number; they are left out, and so are hopeless copies.
    """

    def __init__(self, keys: pa.Array, rows: np.ndarray, limit: int):
        norms = _lengths(rows)
        short = np.flatnonzero(norms <= ZERO_TOLERANCE * np.sqrt(rows.shape[1]))
        usable = np.isfinite(norms)
        usable[short[(np.abs(rows[short]) <= ZERO_TOLERANCE).all(axis=1)]] = False
        if not usable.all():
            keys, rows = keys.filter(pa.array(usable)), rows[usable]
        self.keys, self.rows = _without_hopeless_copies(keys, rows, limit)
        self.norms = _lengths(self.rows)
        self.unit = (self.rows / self.norms[:, None]).astype(np.float32)


def batch_search(store: DataFrame, queries: DataFrame, limit: int = 10, key: str = "path",
                 vector: str = "vector", query_key: str = "query_id",
                 block_bytes: int = BLOCK_BYTES, block_results: int = BLOCK_RESULTS) -> DataFrame:
    """The `limit` best rows for each query: (query_key, rank, key, score).

    `queries` is (query_key, query_vec) with unique keys; NULL vectors find nothing. They are
    written first, dealt by hash into blocks of about `block_bytes` of vectors; small blocks share a
    file. The store is read once, for any number of queries: a task holds a stretch of its rows and
    goes through the blocks with it, one at a time. It holds at most about `block_results` results; beyond that it hands
    on what it has and remembers each query's bound, which later rows must reach.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    rows = store.select(F.col(key).alias("__key"), F.col(vector).alias("__vec")).where("__vec is not null")
    asked = _written(queries.select(F.col(query_key).alias("__qid"), F.col("query_vec").alias("__qvec"))
                     .where("__qvec is not null").withColumn("__floor", F.lit(0.0)))
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("__qvec")).alias("dim"),
                     F.sum(F.octet_length(F.col("__qid").cast("string"))).alias("ids")).first()
    n_bytes = size.n * (size.dim or 0) * 8 + (size.ids or 0)
    blocks = max(1, math.ceil(n_bytes / block_bytes))
    files = min(blocks, max(1, math.ceil(n_bytes / FILE_BYTES)))
    tasks, cores = rows.rdd.getNumPartitions(), parallelism(store.sparkSession)
    large = tasks * size.n * limit > MERGE_ROWS
    if large:
        # Bounds from a few rows: what lies below the best of these is in no result.
        seeds = _QueryFiles(_written(rows.limit(SEED_ROWS)), 1)
        asked = map_arrow(spread(asked), _floor_task(seeds, limit), asked.schema)
    if large or blocks > 1:
        asked = _written(asked.repartition(files, "__qid"))
    if size.n >= SPREAD_QUERIES and tasks < 4 * cores:
        rows, tasks = rows.repartition(cores), cores  # failed rows and few files leave cores idle
    out = rows.select("__key").schema.add("score", "double").add("__qid", asked.schema["__qid"].dataType)
    candidates = map_arrow(rows, _many_topk_task(_QueryFiles(asked, files, math.ceil(blocks / files)), limit, block_results), out)
    ranked = _ranked(candidates, limit, math.ceil(tasks * limit / SLOT_ROWS))
    return ranked.select(F.col("__qid").alias(query_key), "rank", F.col("__key").alias(key), "score")


def _ranked(candidates: DataFrame, limit: int, slots: int) -> DataFrame:
    """The `limit` best candidates of each query with their rank. With several slots, those of a query
    are cut in parallel first, so that one task never ranks what all tasks of a large store hand on."""
    order = [F.desc("score"), F.asc("__key")]
    if slots > 1:
        part = Window.partitionBy("__qid", "__slot").orderBy(*order)
        dealt = candidates.withColumn("__slot", F.pmod(F.xxhash64("__key"), F.lit(slots)))
        candidates = dealt.withColumn("__place", F.row_number().over(part)).where(F.col("__place") <= limit)
    rank = F.row_number().over(Window.partitionBy("__qid").orderBy(*order))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= limit)


def _written(rows: DataFrame) -> DataFrame:
    target = fresh_dir(rows.sparkSession, "queries")
    rows.write.parquet(target)
    return rows.sparkSession.read.schema(rows.schema).parquet(target)


class _QueryFiles:
    """Written queries as blocks that a task reads by itself, one after the other.

    A block is one of `parts` equal shares of a file; one `file` stands for all that were written.
    """

    def __init__(self, asked: DataFrame, files: int, parts: int = 1):
        found = sorted(strip_file_scheme(f) for f in asked.inputFiles())
        self.files, self.parts = [[f] for f in found] if files > 1 else [found], parts
        self.blocks = [(file, part) for file in range(len(self.files)) for part in range(parts)]
        self.id_type = to_arrow_type(asked.schema[0].dataType)  # of the id, or the key of a store
        self.last: tuple[int, tuple] | None = None
        self.opened: tuple[int, pa.Table | None] | None = None

    def table(self, file: int) -> pa.Table | None:
        """The rows of a file as they were written; the last one read is kept."""
        if self.opened is None or self.opened[0] != file:
            tables = [parquet.read_table(pa.BufferReader(read_bytes(f if is_uri(f) else unquote(f)))) for f in self.files[file]]
            self.opened = file, pa.concat_tables(tables) if tables else None
        return self.opened[1]

    def read(self, block: int) -> tuple[pa.Array, _QueryBlock, np.ndarray] | None:
        """The ids, the vectors and the first bounds of a block; the last one read is kept."""
        if self.last is None or self.last[0] != block:
            (file, part), found = self.blocks[block], None
            if (table := self.table(file)) is not None:
                first, end = (table.num_rows * p // self.parts for p in (part, part + 1))
                table = table.slice(first, end - first)
            if table is not None and table.num_rows:
                ids = table.column("__qid").cast(self.id_type).combine_chunks()
                found = ids, _QueryBlock(to_matrix(table.column("__qvec"))), table.column("__floor").to_numpy()
            self.last = block, found
        return self.last[1]


class _RunningTopK:
    """The best rows per query seen so far in one task."""

    def __init__(self, n_queries: int, limit: int):
        self.limit = limit
        self.floor = np.zeros(n_queries)
        self.found: list[pa.Table] = []
        self.pending = 0

    def add(self, keys: pa.Array, rows: np.ndarray, block: _QueryBlock) -> None:
        self.add_ready(_StoreRows(keys, rows, self.limit), block)

    def add_ready(self, store: _StoreRows, block: _QueryBlock) -> None:
        for start in range(0, len(store.rows), TILE_ROWS):
            at, hits, many = slice(start, start + TILE_ROWS), [], False
            for first in range(0, len(self.floor), TILE_QUERIES):
                row, query, crowded = self._passing(store, at, block, slice(first, first + TILE_QUERIES))
                many |= crowded
                if len(row):
                    exact = block.exact(store.rows, store.norms, row, query)
                    hit = (exact > 0) & (exact >= self.floor[query])
                    hits.append((row[hit], exact[hit], query[hit]))
            row, exact, query = map(np.concatenate, zip(*hits)) if hits else ([], [], [])
            if len(row):
                self.found.append(pa.table({"__key": store.keys.take(pa.array(row)), "score": exact, "q": query}))
                self.pending += len(row)
            if many or self.pending > 2 * self.limit * len(self.floor):
                self.shrink()

    def _passing(self, store: _StoreRows, at: slice, block: _QueryBlock, asked: slice) -> tuple[np.ndarray, np.ndarray, bool]:
        """Pairs of a row and a query of a tile that may be among the best, and if bounds were too low to tell much."""
        scores = block.unit[asked] @ store.unit[at].T  # cosines in float32; NaN for queries without length
        bound = (self.floor[asked] - block.slack).astype(np.float32)
        some = np.flatnonzero(scores.max(axis=1) >= bound)
        if len(some) < len(scores):
            scores, bound = scores[some], bound[some]
        width = scores.shape[1]
        passing = scores >= bound[:, None]
        crowded = width > self.limit and np.count_nonzero(passing) > 4 * self.limit * len(some)
        if crowded:
            place = width - self.limit
            best = np.partition(scores, place, axis=1)[:, place]
            passing &= scores >= (best - 2 * block.slack)[:, None]
        pair = np.flatnonzero(passing)
        return at.start + pair % width, asked.start + some[pair // width], crowded

    def shrink(self) -> pa.Table | None:
        if not self.found:
            return None
        table = pa.concat_tables(self.found).sort_by(
            [("q", "ascending"), ("score", "descending"), ("__key", "ascending")]).combine_chunks()
        query = table.column("q").to_numpy()
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        sizes = np.diff(np.r_[starts, len(query)])
        place = np.arange(len(query)) - np.repeat(starts, sizes)
        last = np.flatnonzero(place == self.limit - 1)
        self.floor[query[last]] = table.column("score").to_numpy()[last]
        table = table.filter(pa.array(place < self.limit))
        self.found, self.pending = [table], 0
        return table

    def result(self, query_ids: pa.Array) -> pa.Table | None:
        table = self.shrink()
        if table is None:
            return None
        ids = query_ids.take(table.column("q").combine_chunks())
        return pa.table({"__key": table.column("__key"), "score": table.column("score"), "__qid": ids})


def _floor_task(seeds: _QueryFiles, limit: int):
    """Queries with the score of their `limit`-th best of the written seeds as their bound."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, table = None, seeds.table(0)
        for batch in batches:
            if table is not None and table.num_rows and batch.num_rows:
                vectors = to_matrix(batch.column(1))
                if store is None:
                    store = _StoreRows(table.column("__key").combine_chunks(), to_matrix(table.column("__vec"), vectors.shape[1]), limit)
                elif store.rows.shape[1] != vectors.shape[1]:
                    raise ValueError("vectors differ in length")
                top = _RunningTopK(len(vectors), limit)
                top.add_ready(store, _QueryBlock(vectors))
                top.shrink()
                batch = batch.set_column(2, batch.schema.field(2), pa.array(top.floor))
            yield batch

    return run


def _many_topk_task(queries: _QueryFiles, limit: int, most_results: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: list[_RunningTopK | None] = [None] * len(queries.blocks)
        held = 0

        def hand_on(block: int, ids: pa.Array) -> Iterator[pa.RecordBatch]:
            result = tops[block].result(ids)
            tops[block].found, tops[block].pending = [], 0  # the bounds stay
            if result is not None:
                yield from result.combine_chunks().to_batches()

        for stretch in _stretches(batches, 0 if len(tops) == 1 else STRETCH_BYTES):
            store = None
            for block in range(len(tops)):
                if (found := queries.read(block)) is None:
                    continue
                ids, vectors, bounds = found
                width = vectors.vectors.shape[1]
                if store is None:
                    store = _StoreRows(stretch.column(0).combine_chunks(), to_matrix(stretch.column(1), width), limit)
                elif store.rows.shape[1] != width:
                    raise ValueError("vectors differ in length")
                if tops[block] is None:
                    tops[block] = _RunningTopK(len(ids), limit)
                    tops[block].floor = bounds.copy()
                held -= tops[block].pending
                tops[block].add_ready(store, vectors)
                held += tops[block].pending
                if held > most_results:
                    held -= tops[block].pending
                    yield from hand_on(block, ids)
        for block, top in enumerate(tops):
            if top is not None and top.found:
                yield from hand_on(block, queries.read(block)[0])

    return run


def _stretches(batches: Iterable[pa.RecordBatch], n_bytes: int) -> Iterator[pa.Table]:
    """Consecutive batches together, up to about `n_bytes`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if held and sum(b.nbytes for b in held) >= n_bytes:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)
