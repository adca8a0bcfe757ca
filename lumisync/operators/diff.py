"""Snapshot comparison: one full outer join on the path classifies every key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEW, DELETED, MODIFIED, UNCHANGED = "new", "deleted", "modified", "unchanged"
IMAGES_PER_SECOND = 280  # fixed value: planning speed of the dry run


def classify(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, status, mtime, stored_mtime) for every path on either side.

    Both inputs are snapshots, (path, mtime) with unique paths. A key counts as present
    by its path, so a NULL mtime does not turn it into a missing one.
    """
    c = current.select(F.col("path").alias("c_path"), F.col("mtime").alias("mtime"))
    o = stored.select(F.col("path").alias("o_path"), F.col("mtime").alias("stored_mtime"))
    status = (
        F.when(F.col("o_path").isNull(), NEW)
        .when(F.col("c_path").isNull(), DELETED)
        .when(F.col("mtime").eqNullSafe(F.col("stored_mtime")), UNCHANGED)
        .otherwise(MODIFIED)
    )
    return c.join(o, F.col("c_path") == F.col("o_path"), "full_outer").select(
        F.coalesce("c_path", "o_path").alias("path"), status.alias("status"),
        "mtime", "stored_mtime",
    )


def new_keys(current: DataFrame, stored: DataFrame) -> DataFrame:
    return current.join(stored.select("path"), "path", "left_anti").select("path")


def deleted_keys(current: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.join(current.select("path"), "path", "left_anti").select("path")


def _common(current: DataFrame, stored: DataFrame) -> DataFrame:
    old = stored.select("path", F.col("mtime").alias("stored_mtime"))
    return current.select("path", "mtime").join(old, "path")


def common_keys(current: DataFrame, stored: DataFrame) -> DataFrame:
    return current.join(stored.select("path"), "path", "left_semi").select("path")


def modified_keys(current: DataFrame, stored: DataFrame) -> DataFrame:
    same = F.col("mtime").eqNullSafe(F.col("stored_mtime"))
    return _common(current, stored).where(~same).select("path")


def unchanged_keys(current: DataFrame, stored: DataFrame) -> DataFrame:
    same = F.col("mtime").eqNullSafe(F.col("stored_mtime"))
    return _common(current, stored).where(same).select("path")


def work_set(diff: DataFrame) -> DataFrame:
    """New and modified paths with their current mtimes."""
    return diff.where(F.col("status").isin(NEW, MODIFIED)).select("path", "mtime")


def summarize(diff: DataFrame) -> DataFrame:
    """One row of counts; `total` is the number of current files."""
    def count(status: str):
        return F.count(F.when(F.col("status") == status, 1))
    return diff.agg(
        count(NEW).alias("new"), count(MODIFIED).alias("modified"),
        count(DELETED).alias("deleted"), count(UNCHANGED).alias("unchanged"),
        F.count(F.when(F.col("status") != DELETED, 1)).alias("total"),
    )


def dry_run(diff: DataFrame, per_second: float = IMAGES_PER_SECOND) -> DataFrame:
    """What a sync would do, and how long the embedding would take. Writes nothing."""
    to_embed = F.col("new") + F.col("modified")
    return summarize(diff).select(
        F.col("total").alias("found"),
        (F.col("unchanged") + F.col("modified") + F.col("deleted")).alias("stored"),
        "unchanged", "new", "modified", F.col("deleted").alias("removed"),
        to_embed.alias("to_embed"), (to_embed / F.lit(float(per_second))).alias("estimated_seconds"),
    )


def keep_by_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose path is listed; an empty list keeps nothing."""
    return rows.join(keys.select("path"), "path", "left_semi")


def throughput(items, seconds):
    """Items per second; NULL for zero seconds."""
    return F.try_divide(items.cast("double"), seconds)
