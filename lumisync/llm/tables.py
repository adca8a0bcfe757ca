"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_dir, scratch

BROADCAST_KEYS = 1_000_000  # up to so many keys of 16 bytes go to every executor instead of a shuffle of all rows
HOT_SHARE = 1000  # a key of more than a thousandth of the rows is hot; so there are fewer than a thousand hot keys
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python by the thousand where the session has Spark's default of ten thousand:
    texts are long, and a batch is held several times over on either side."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(rows: DataFrame, label: str) -> DataFrame:
    """Write rows to the shared folder and read them back: the lineage ends in files that
    outlive any executor."""
    spark = rows.sparkSession
    small_batches(spark)
    path = fresh_dir(spark, label)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def settle(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """As `materialize`, but the intermediate tables that `make` and its rows need are deleted."""
    small_batches(spark)
    path = fresh_dir(spark, label)
    with scratch(spark):
        rows = make()
        rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    """The number of partitions that the session deals its shuffles to; a cluster sets it by its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of an id's decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def without(rows: DataFrame, keys: DataFrame, on: dict[str, Column]) -> DataFrame:
    """The rows that match none of `keys`, a written table; `on` gives the row's value for each of
    its columns, and null matches null."""
    few = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    condition = F.lit(True)
    for name, value in on.items():
        condition = condition & value.eqNullSafe(keys[name])
    return rows.join(few, condition, "left_anti")


def look_up(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Left join of `rows`, a written table, with `found`, which has one row for each key; keys are not null.

    Any key may hold most of the rows: hot keys are joined by broadcast, and there are fewer than
    `HOT_SHARE` of them; the others by a shuffle in which no key is hot.
    """
    least = rows.count() / HOT_SHARE
    hot = materialize(rows.groupBy(*on).count().where(F.col("count") > least).select(*on), "hot-keys")
    few = F.broadcast(hot)
    by_broadcast = rows.join(few, on, "left_semi").join(F.broadcast(found.join(few, on, "left_semi")), on, "left")
    by_shuffle = rows.join(few, on, "left_anti").join(found, on, "left")
    return by_broadcast.unionByName(by_shuffle)


def arrow_slices(batches: Iterable[pa.RecordBatch], column: str, n_bytes: int) -> Iterator[pa.Table]:
    """Consecutive rows, each slice with about `n_bytes` in a text column, or one longer row by itself."""
    held, size = [], 0
    for batch in batches:
        first = 0
        for at, length in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if size and size + (length or 0) > n_bytes:
                held.append(batch.slice(first, at - first))
                yield pa.Table.from_batches(held)
                held, size, first = [], 0, at
            size += (length or 0) + 1
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)
