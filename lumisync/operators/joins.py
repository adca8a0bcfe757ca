"""Joins and numbering that hold with hot keys and tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh_dir, parallelism

HOT_SHARE = 1000  # a key of more than a thousandth of the rows is hot; so there are fewer than a thousand hot keys


def written(rows: DataFrame, label: str) -> DataFrame:
    """The rows as a table of the shared folder."""
    target = fresh_dir(rows.sparkSession, label)
    rows.write.parquet(target)
    return rows.sparkSession.read.schema(rows.schema).parquet(target)


def look_up(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Left join of `rows`, a written table, with `found`, which has one row for each key; keys are not null.

    Any key may hold most of the rows: hot keys are joined by broadcast, and there are fewer than
    `HOT_SHARE` of them; the others by a shuffle in which no key is hot.
    """
    least = rows.count() / HOT_SHARE
    few = F.broadcast(written(rows.groupBy(*on).count().where(F.col("count") > least).select(*on), "hot-keys"))
    by_broadcast = rows.join(few, on, "left_semi").join(F.broadcast(found.join(few, on, "left_semi")), on, "left")
    by_shuffle = rows.join(few, on, "left_anti").join(found, on, "left")
    return by_broadcast.unionByName(by_shuffle)


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """Add the place of each row in an order, from 0, without bringing the rows together in one task.

    The order is total if its columns are unique. Rows are dealt by ranges and sorted; the driver sees one
    count for each range.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    table = written(dealt.withColumns({"__range": F.spark_partition_id(), "__at": at}), "ranges")
    total, starts = 0, []
    for row in table.groupBy("__range").count().orderBy("__range").collect():
        starts.append((row["__range"], total))
        total += row["count"]
    offsets = spark.createDataFrame(starts, "__range int, __start long")
    placed = table.join(F.broadcast(offsets), "__range")
    return placed.withColumn(name, F.col("__start") + F.col("__at")).drop("__range", "__at", "__start")
