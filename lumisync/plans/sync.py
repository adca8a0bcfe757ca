"""Bring a vector store in step with a snapshot, embedding only what changed."""

from __future__ import annotations

import math
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import DELETED, MODIFIED, NEW, UNCHANGED, classify
from ..operators.embed import embed
from ..operators.encoders import ColumnEncoder, Encoder
from ..schemas import STORE
from ..session import fresh_dir, parallelism, scratch
from ..sources.store import VectorStore

ROWS_PER_EMBED_TASK = 20_000
# Tombstones of a store, and the changed keys of one group of buckets that is written anew, go
# to every task: up to so many bytes of path text.
BROADCAST_KEY_BYTES = 64 << 20
DEAD_SHARE = 0.25  # of the rows; with more tombstones the buckets are written anew
MAX_PARTS = 32  # folders of a bucket; with more it is written anew
GROWTH = 4  # the store is dealt into more buckets when they are so many times their size


@dataclass
class SyncStats:
    new: int
    modified: int
    deleted: int
    unchanged: int
    total: int
    failed: int  # new and modified rows that could not be embedded
    elapsed: float


def concat_rows(kept: DataFrame, added: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return kept.unionByName(added)


def sync(
    store: VectorStore, current: DataFrame, encoder: Encoder | ColumnEncoder,
    rows_per_task: int = ROWS_PER_EMBED_TASK, broadcast_key_bytes: int = BROADCAST_KEY_BYTES,
    root: str | None = None,
) -> SyncStats:
    """One pass: classify, embed new and modified rows, drop deleted ones, publish.

    `current` is a snapshot (path, mtime), unique by path; the encoder reads `path`.
    Nothing is written when nothing changed. A small change adds its rows and tombstones; a
    large one writes the buckets anew that it or a tombstone touches. With `root`, `current`
    lists that folder only, and stored rows outside of it stay as they are.
    """
    with scratch(store.spark):
        return _sync(store, current, encoder, rows_per_task, broadcast_key_bytes, root)


def _sync(store: VectorStore, current: DataFrame, encoder: Encoder | ColumnEncoder,
          rows_per_task: int, broadcast_key_bytes: int, root: str | None) -> SyncStats:
    started = time.perf_counter()
    head = store.current()
    diff = _written_diff(store, current, head, root)
    counts = _counts(diff)
    stats = SyncStats(counts["new"], counts["modified"], counts["deleted"],
                      counts["unchanged"], counts["total"], 0, 0.0)
    if not (stats.new or stats.modified or stats.deleted):
        return stats
    n_rows = (head.n_rows if head else 0) + stats.new - stats.deleted
    n_kept = n_rows - stats.new - stats.modified
    if n_kept and head.dim != encoder.dim:
        raise ValueError(f"the store holds vectors of {head.dim} entries, the encoder makes {encoder.dim}")

    n_buckets = store.buckets_for(n_rows, encoder.dim)
    if head and n_buckets < GROWTH * head.n_buckets:
        n_buckets = head.n_buckets
    diff = diff.withColumn("bucket", store.bucket(F.col("path"), n_buckets))
    # What could not be embedded is counted while the rows are written.
    written = Observation("written")
    added = _embedded(diff, encoder, counts, rows_per_task).observe(written, F.count("error").alias("failed"))
    gone = diff.where(F.col("status").isin(MODIFIED, DELETED))
    n_gone, gone_bytes = stats.modified + stats.deleted, counts["changed_bytes"] or 0
    added_to, gone_from = _changed_buckets(diff)
    touched = added_to | gone_from
    is_small = head is not None and head.n_buckets == n_buckets and n_kept > 0 and (
        head.dead_bytes + gone_bytes <= broadcast_key_bytes
        and head.n_dead + n_gone <= DEAD_SHARE * n_rows
        and all(len(head.parts.get(b, ())) < MAX_PARTS for b in touched))

    if is_small:
        folder = store.stage(added, head, encoder.dim)
        parts = {b: list(listed) for b, listed in head.parts.items()}
        for b in added_to:
            parts[b] = [*parts.get(b, ()), f"{folder}/bucket={b}"]
        dead = [*head.dead, store.stage_tombstones(gone, head)] if n_gone else head.dead
        state = {"dead": dead, "n_dead": head.n_dead + n_gone, "dead_bytes": head.dead_bytes + gone_bytes,
                 "dead_buckets": {*head.dead_buckets, *gone_from}}
    else:
        rewritten = set(head.dead_buckets) | touched if head and head.n_buckets == n_buckets else set(range(n_buckets))
        kept = _kept(store, head, gone, rewritten, n_buckets, broadcast_key_bytes)
        folder = store.stage(concat_rows(kept, added) if kept is not None else added, head, encoder.dim)
        filled = added_to if kept is None else _buckets(
            store.spark.read.schema("path string, bucket int").parquet(f"{store.root}/{folder}"))
        parts = {b: listed for b, listed in (head.parts if head else {}).items() if b not in rewritten}
        parts |= {b: [f"{folder}/bucket={b}"] for b in filled}
        state = {}
    stats.failed = written.get["failed"] if added_to else 0
    store.publish(head, encoder.dim, parts, n_rows, n_buckets, **state)
    stats.elapsed = time.perf_counter() - started
    return stats


def stats_frame(spark: SparkSession, stats: SyncStats) -> DataFrame:
    schema = "new long, modified long, deleted long, unchanged long, total long, failed long, elapsed double"
    return spark.createDataFrame([tuple(asdict(stats).values())], schema)


def _written_diff(store: VectorStore, current: DataFrame, head, root: str | None) -> DataFrame:
    """The classification as a table: later steps read it several times, and it must not
    change between them if the file tree does."""
    stored = store.read(head=head).select("path", "mtime")
    if root is not None:
        below = F.startswith("path", F.lit(root.rstrip("/") + "/"))
        current, stored = current.where(below), stored.where(below)
    diff = classify(current, stored)
    target = fresh_dir(store.spark, "diff")
    diff.write.parquet(target)
    return store.spark.read.schema(diff.schema).parquet(target)


def _counts(diff: DataFrame) -> dict:
    def count(*statuses: str):
        return F.count(F.when(F.col("status").isin(*statuses), 1))
    return diff.agg(
        count(NEW).alias("new"), count(MODIFIED).alias("modified"),
        count(DELETED).alias("deleted"), count(UNCHANGED).alias("unchanged"),
        count(NEW, MODIFIED, UNCHANGED).alias("total"),
        F.sum(F.when(F.col("status").isin(MODIFIED, DELETED), F.octet_length("path") + 32))
        .alias("changed_bytes"),
    ).first().asDict()


def _changed_buckets(diff: DataFrame) -> tuple[set[int], set[int]]:
    """The buckets that rows are added to, and those that rows go from: at most as many as the store has."""
    found = diff.where(F.col("status") != UNCHANGED).groupBy("bucket").agg(
        F.bool_or(F.col("status").isin(NEW, MODIFIED)).alias("added"),
        F.bool_or(F.col("status").isin(MODIFIED, DELETED)).alias("gone")).collect()
    return {r.bucket for r in found if r.added}, {r.bucket for r in found if r.gone}


def _buckets(rows: DataFrame) -> set[int]:
    """The bucket numbers of some rows: at most as many as the store has."""
    return {r.bucket for r in rows.select("bucket").distinct().collect()}


def _embedded(diff: DataFrame, encoder, counts: dict, rows_per_task: int) -> DataFrame:
    """Embed the work set. The cheap (path, mtime) rows are spread evenly, in bucket order,
    before the encoder, so the vectors go straight from it into the writer; but not where the
    encoder takes pixels."""
    work = diff.where(F.col("status").isin(NEW, MODIFIED)).select("path", "mtime", "bucket")
    n_work = counts["new"] + counts["modified"]
    tasks = max(1, min(n_work, 2 * parallelism(diff.sparkSession)), math.ceil(n_work / rows_per_task))
    if isinstance(encoder, Encoder) and encoder.takes_pixels:
        # The image source deals out the files; pixels stay where they are read, vectors are put together by bucket.
        vectors = embed(work, "path", encoder).select(*STORE.names, "bucket")
        parts = max(1, math.ceil(n_work / rows_per_task))
        return vectors.repartition(parts, "bucket", F.pmod(F.xxhash64("path"), F.lit(parts)))
    spread = work.repartitionByRange(tasks, F.col("bucket"), F.xxhash64("path"))
    return embed(spread, "path", encoder).select(*STORE.names, "bucket")


def _kept(store: VectorStore, head, gone: DataFrame, rewritten: set[int], n_buckets: int,
          broadcast_key_bytes: int) -> DataFrame | None:
    """The stored rows of the buckets to be written anew, without the changed keys.

    Buckets are taken in groups whose changed keys fit the broadcast, so each bucket is read once
    and no vector is shuffled, however many keys changed. A single bucket's keys are not divided:
    they are bounded by the size of a bucket.
    """
    if head is None or not head.parts:
        return None
    old = store.bucket(F.col("path"), head.n_buckets)
    sizes = {r.bucket: r.size for r in gone.groupBy(old.alias("bucket")).agg(
        F.sum(F.octet_length("path") + 32).alias("size")).collect()}
    wanted = sorted(set(head.parts) & rewritten if head.n_buckets == n_buckets else set(head.parts))
    groups, room = [], 0
    for bucket in wanted:
        size = sizes.get(bucket, 0)
        if not groups or size > room:
            groups.append(set())
            room = broadcast_key_bytes
        groups[-1].add(bucket)
        room -= size
    kept = None
    for group in groups:
        keys = gone.where(old.isin(sorted(group))).select("path")
        rows = store.read(group, head).join(F.broadcast(keys), "path", "left_anti")
        kept = rows if kept is None else kept.union(rows)
    if kept is None:
        return None
    return kept.withColumn("bucket", store.bucket(F.col("path"), n_buckets)).select(*STORE.names, "bucket")
